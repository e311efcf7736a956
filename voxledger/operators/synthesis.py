"""From window scores to a verdict per clip: aggregates, intervals, category, wording."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxledger import constants as K
from voxledger.functions.numbers import col, fixed, named, round_dp, round_sql
from voxledger.functions.ordered import SEG, ordered, seg_of, with_cuts, with_segments

CLIP = ["clip_id"]
SIGNALS = {"vocoder": "vocoder_score", "spectral": "spectral_score", "prosody": "prosody_score"}
DOCUMENT_PART = 4096


def combined_suspicion() -> Column:
    return round_dp(" + ".join(f"{w}D * {c}" for c, w in K.COMBINED_WEIGHTS.items()), 1)


def flag_windows(windows: DataFrame) -> DataFrame:
    """Add ``combined_score`` (1 decimal, tested after rounding) and ``is_suspicious``."""
    return windows.withColumn("combined_score", combined_suspicion()).withColumn(
        "is_suspicious",
        F.expr(f"combined_score >= {K.SUSPICION_COMBINED}D OR spectral_score >= {K.SUSPICION_SPECTRAL}D"),
    )


def topk_mean(df: DataFrame, by: Sequence[str], score: Column | str, k: Column, out: str) -> DataFrame:
    """Mean of the ``k`` largest scores per group; ``k`` may use the group size ``n``.

    Scores have one decimal, so they are counted per tenth first: a group is at
    most about a thousand rows whatever its size, and sums are exact integers.
    """
    counts = (
        df.select(*by, F.rint(col(score) * 10.0).cast("long").alias("_v"))
        .groupBy(*by, "_v")
        .agg(F.count(F.lit(1)).alias("_w"))
    )
    return (
        _take_top(counts, by, k)
        .groupBy(*by)
        .agg(round_dp(F.sum(F.col("_v") * F.col("_t")) / F.lit(10.0) / F.sum("_t"), 1).alias(out))
    )


def _take_top(counts: DataFrame, by: Sequence[str], k: Column) -> DataFrame:
    group = Window.partitionBy(*by)
    before = group.orderBy(F.desc("_v")).rowsBetween(Window.unboundedPreceding, -1)
    return (
        counts.select("*", F.sum("_w").over(group).alias("n"), F.sum("_w").over(before).alias("_before"))
        .withColumn("_k", k)
        .withColumn("_t", F.expr("greatest(0, least(_w, _k - coalesce(_before, 0)))"))
    )


def signal_scores(windows: DataFrame) -> DataFrame:
    """Clip-level vocoder (top quartile), spectral (top two) and prosody (mean) scores in one job.

    Also the window count, and the flag and boundary counts where the windows
    carry them, so that a verdict reads the windows once for all of these.
    """
    extra = [c for c in ("is_suspicious", "boundary_detected") if c in windows.columns]
    pairs = ", ".join(f"'{n}', {c}" for n, c in SIGNALS.items())
    counts = (
        windows.selectExpr("clip_id", *extra, f"stack({len(SIGNALS)}, {pairs}) AS (signal, score)")
        .groupBy("clip_id", "signal", F.expr("CAST(rint(score * 10D) AS BIGINT)").alias("_v"))
        .agg(F.count(F.lit(1)).alias("_w"), *[F.expr(f"count_if({c})").alias(c) for c in extra])
    )
    k = F.expr(
        "CASE signal WHEN 'vocoder' THEN greatest(1, floor(n / 4)) WHEN 'spectral' THEN least(2, n) ELSE n END"
    )
    top = _take_top(counts, ["clip_id", "signal"], k)
    means = [
        round_dp(f"sum(_v * _t) FILTER (WHERE signal = '{n}') / 10D / sum(_t) FILTER (WHERE signal = '{n}')", 1).alias(n)
        for n in SIGNALS
    ]
    names = {"is_suspicious": "n_flagged", "boundary_detected": "n_boundaries"}
    tallies = [F.expr(f"sum({c}) FILTER (WHERE signal = 'prosody')").alias(names[c]) for c in extra]
    return top.groupBy("clip_id").agg(F.max("n").alias("n_windows"), *means, *tallies)


def merge_intervals(
    df: DataFrame, by: Sequence[str], start: str, end: str, tol: float = K.INTERVAL_TOLERANCE,
    extra: dict[str, Column] | None = None,
) -> DataFrame:
    """Union of intervals whose gap to everything before is at most ``tol``; ``extra`` aggregates go along."""
    d = with_cuts(df, by, start) if SEG not in df.columns else df
    d = ordered(d, by, [start, end], maxes={"_reach": end})
    fresh = F.col("_reach").isNull() | (F.col(start) > F.col("_reach") + F.lit(tol))
    d = ordered(d.withColumn("_new", fresh.cast("int")), by, [start, end], sums={"island": "_new"})
    return (
        d.groupBy(*by, "island")
        .agg(
            F.min(start).alias("t_start"),
            F.max(end).alias("t_end"),
            F.count(F.lit(1)).alias("n_windows"),
            *[c.alias(n) for n, c in (extra or {}).items()],
            seg_of(d, F.max),
        )
        .withColumn("duration_sec", round_dp(F.col("t_end") - F.col("t_start"), 2))
    )


def suspect_intervals(windows: DataFrame) -> DataFrame:
    """Merged intervals of the flagged windows, before lone-flag suppression."""
    d = with_segments(windows, CLIP, "window_id")
    return merge_intervals(flag_windows(d).where("is_suspicious"), CLIP, "start_time", "end_time")


def composite_score() -> Column:
    raw = " + ".join(f"{c} * {w}D" for c, w in K.COMPOSITE_WEIGHTS.items())
    return F.expr(f"greatest(1D, least(99D, {round_sql(raw, 1)}))")


def with_empty_defaults(clips: DataFrame) -> DataFrame:
    """Clips without windows score 10 on every signal."""
    counts = [c for c in ("n_windows", "n_flagged", "n_boundaries") if c in clips.columns]
    return clips.fillna({**{s: 10.0 for s in SIGNALS}, **{c: 0 for c in counts}})


def boundary_times(windows: DataFrame) -> DataFrame:
    """Midpoint of every boundary window."""
    return windows.where("boundary_detected").select(
        "clip_id", "window_id", round_dp("(start_time + end_time) / 2D", 2).alias("t"),
        *([SEG] if SEG in windows.columns else []),
    )


def lone_flag() -> Column:
    """A single flagged window in an otherwise calm clip does not count."""
    return F.expr("n_flagged = 1 AND composite < 46 AND model < 20 AND n_boundaries = 0")


def synthesise(windows: DataFrame, models: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(verdict per clip, suspect intervals).

    ``models`` has one row per clip: ``clip_id, model, duration_sec``.
    """
    clips, intervals = _verdicts(windows, models)
    return clips, intervals.join(clips.where("suppressed").select("clip_id"), "clip_id", "left_anti")


def suspect_regions(windows: DataFrame, models: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row per suspect interval with the named verdict columns of its clip."""
    clips, intervals = _verdicts(windows, models)
    at = intervals.select("clip_id", "t_start", "t_end", F.col("duration_sec").alias("interval_sec"))
    return at.join(clips.where("NOT suppressed").select("clip_id", *columns), "clip_id")


def _verdicts(windows: DataFrame, models: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(verdict per clip, intervals before suppression).

    Windows are aggregated first; only one row per clip is joined.  A suppressed
    clip has exactly one flagged window and so exactly one interval.
    """
    d = flag_windows(with_segments(windows, CLIP, "window_id"))
    intervals = merge_intervals(d.where("is_suspicious"), CLIP, "start_time", "end_time")
    spans = intervals.groupBy("clip_id").agg(
        F.count(F.lit(1)).alias("_ni"), F.expr("sum(t_end - t_start)").alias("_span")
    )
    clips = with_empty_defaults(models.join(signal_scores(d), "clip_id", "left")).join(spans, "clip_id", "left")
    clips = (
        clips.withColumn("composite", composite_score())
        .withColumn("suppressed", lone_flag())
        .withColumns(
            {
                "n_intervals": F.expr("if(suppressed, 0L, coalesce(_ni, 0L))"),
                "span_sec": F.expr("if(suppressed, 0D, coalesce(_span, 0D))"),
                "n_flagged": F.expr("if(suppressed, 0L, n_flagged)"),
            }
        )
        .withColumns(
            {
                "span_ratio": F.expr("span_sec / greatest(duration_sec, 0.1D)"),
                "flag_ratio": F.expr("coalesce(n_flagged / nullif(n_windows, 0), 0D)"),
            }
        )
        .withColumn("category", category())
    )
    label, confidence = label_confidence()
    clips = clips.withColumns(
        {"label": label, "confidence": confidence, "category_label": named("category", K.CATEGORY_LABELS)}
    ).drop("_ni", "_span")
    return clips, intervals


def category() -> Column:
    """Evidence consensus over clip-level columns."""
    synthetic = (
        "(composite >= 32 AND model >= 60 AND (vocoder >= 27 OR prosody >= 12)) "
        "OR (composite >= 32 AND span_ratio >= 0.40D) OR (composite >= 34 AND flag_ratio >= 0.35D)"
    )
    spliced = (
        "(n_boundaries > 0 AND composite >= 28) "
        "OR (n_intervals > 0 AND composite >= 32 AND span_ratio BETWEEN 0.05D AND 0.65D) "
        "OR (n_intervals > 0 AND composite >= 32 AND spectral >= 45 AND span_ratio <= 0.65D)"
    )
    return F.expr(f"CASE WHEN {synthetic} THEN '{K.SYNTHETIC}' WHEN {spliced} THEN '{K.SPLICED}' ELSE '{K.AUTHENTIC}' END")


def label_confidence() -> tuple[Column, Column]:
    spliced = f"category = '{K.SPLICED}'"
    label = F.expr(
        f"CASE WHEN composite >= 70 THEN 'DEEPFAKE' WHEN {spliced} THEN 'SUSPICIOUS' "
        "WHEN composite >= 40 THEN 'UNCERTAIN' ELSE 'REAL' END"
    )
    confidence = F.expr(
        "CASE WHEN composite >= 85 THEN 'HIGH' "
        f"WHEN composite >= 20 OR {spliced} THEN 'MEDIUM' ELSE 'HIGH' END"
    )
    return label, confidence


def gap_rows(df: DataFrame, key: str, names: Sequence[str], threshold: float) -> DataFrame:
    """One row per two present score columns at least ``threshold`` apart: names, scores, delta.

    The fixed list of column pairs is tested inside the row and only the hits
    are exploded; no rows are paired.
    """
    pairs = [(i, j) for i in range(len(names)) for j in range(i + 1, len(names))]
    tests = [f"if(abs({names[i]} - {names[j]}) >= {threshold}D, {n}, NULL)" for n, (i, j) in enumerate(pairs)]
    hits = df.select(key, *names, F.explode(F.expr(f"filter(array({', '.join(tests)}), n -> n IS NOT NULL)")).alias("_n"))
    label, score = ", ".join(f"'{n}'" for n in names), ", ".join(names)
    left, right = (", ".join(str(p[k]) for p in pairs) for k in (0, 1))
    d = hits.selectExpr(key, f"array({score}) AS _s", f"get(array({left}), _n) AS _i", f"get(array({right}), _n) AS _j")
    d = d.selectExpr(key, "_i", "_j", "get(_s, _i) AS _x", "get(_s, _j) AS _y")
    return d.selectExpr(
        key, f"get(array({label}), if(_x > _y, _i, _j)) AS high", f"get(array({label}), if(_x > _y, _j, _i)) AS low",
        "greatest(_x, _y) AS score_high", "least(_x, _y) AS score_low", "abs(_x - _y) AS delta",
    )


def signal_disagreements(clips: DataFrame) -> DataFrame:
    """One row per pair of signals that diverge, with its message."""
    rows = gap_rows(clips, "clip_id", list(K.SIGNAL_NAMES), K.SIGNAL_GAP)
    high, low = named("high", K.SIGNAL_NAMES), named("low", K.SIGNAL_NAMES)
    note = F.when(
        F.col("high") == "spectral",
        " A spectral-only spike without prosody/vocoder elevation is characteristic of a splice point "
        "rather than fully synthetic speech.",
    ).otherwise("")
    return rows.select(
        "clip_id",
        high.alias("signal_high"),
        low.alias("signal_low"),
        round_dp("score_high", 1).alias("score_high"),
        round_dp("score_low", 1).alias("score_low"),
        round_dp("delta", 1).alias("delta"),
        F.concat(
            high, F.lit(" scored "), fixed("score_high", 0), F.lit("% while "),
            low, F.lit(" scored "), fixed("score_low", 0), F.lit("% — a "),
            fixed("delta", 0), F.lit("% divergence."), note,
        ).alias("message"),
    )


def first_values(df: DataFrame, value: Column, order: str, k: int, out: str) -> DataFrame:
    """The first ``k`` values per clip as an array; every task passes on at most ``k`` rows of a clip."""
    place = F.row_number().over(Window.partitionBy(*CLIP).orderBy(order))
    d = df.withColumn("_i", place).where(F.col("_i") <= k)
    return d.groupBy("clip_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("_i", value.alias("v")))), lambda r: r["v"]).alias(out)
    )


def splice_only_message(windows: DataFrame) -> DataFrame:
    """Clips with boundaries but calm vocoder and prosody; names the first three start times."""
    calm = windows.where("boundary_detected AND vocoder_score < 45 AND prosody_score < 45")
    at = first_values(calm, F.concat(fixed("start_time", 1), F.lit("s")), "window_id", 3, "at")
    return at.select(
        "clip_id",
        F.lit(K.SIGNAL_NAMES["spectral"]).alias("signal_high"),
        F.lit("Vocoder Artifacts + Prosody [HEURISTICS]").alias("signal_low"),
        F.concat(
            F.lit("Spectral boundary markers detected at "), F.array_join("at", ", "),
            F.lit(
                " without corresponding vocoder or prosody elevation. This pattern strongly suggests a "
                "SPLICE POINT in a natural recording rather than fully synthetic speech."
            ),
        ).alias("message"),
    )


def with_interval_texts(clips: DataFrame, intervals: DataFrame, boundaries: DataFrame, k: int = 4) -> DataFrame:
    """Add ``ivs`` and ``marks``, the first ``k`` intervals and boundary times of a clip as texts; null where there are none."""
    span = F.concat(F.col("t_start").cast("string"), F.lit("s–"), F.col("t_end").cast("string"), F.lit("s"))
    ivs = first_values(intervals, span, "t_start", k, "ivs")
    marks = first_values(boundaries, F.concat(F.col("t").cast("string"), F.lit("s")), "t", k, "marks")
    return clips.join(ivs, "clip_id", "left").join(marks, "clip_id", "left")


def interpretation(clips: DataFrame, intervals: DataFrame, windows: DataFrame) -> DataFrame:
    """One sentence per clip by category, naming up to three intervals and four boundaries."""
    d = with_interval_texts(clips, intervals, boundary_times(windows))
    return d.select("clip_id", "category", interpretation_text().alias("interpretation"))


def interpretation_text() -> Column:
    """The sentence from verdict columns and the lists ``ivs`` (its first three) and ``marks``."""
    index = F.concat(F.lit("(Anomaly Index: "), fixed("composite", 0), F.lit("%)"))
    markers = F.when(
        F.col("marks").isNotNull(),
        F.concat(F.lit(" Splice boundary markers were detected at: "), F.array_join("marks", ", "), F.lit(".")),
    ).otherwise("")
    synthetic = F.concat(
        F.lit("High-confidence synthetic audio detected "), index,
        F.lit(". The primary neural spoof classifier ("), fixed("model", 0),
        F.lit("%), vocoder artifact indicators ("), fixed("vocoder", 0),
        F.lit("%), and prosody analysis ("), fixed("prosody", 0),
        F.lit("%) collectively indicate the entire voice track was generated via TTS or voice cloning."),
    )
    spliced = F.concat(
        F.lit("Partial audio manipulation detected "), index,
        F.lit(". Suspicious segments localized at: ["), F.array_join(F.slice(F.coalesce("ivs", F.array().cast("array<string>")), 1, 3), ", "),
        F.lit("]."), markers,
        F.lit(
            " The spectral inconsistency indicator flagged abrupt acoustic environment changes "
            "characteristic of a recording splice."
        ),
    )
    authentic = F.concat(
        F.lit("Acoustic profile is consistent with natural unmanipulated human speech "), index,
        F.lit(". Pitch micro-variability ("), fixed("prosody", 0),
        F.lit("% prosody score), harmonic-to-noise ratios ("), fixed("vocoder", 0),
        F.lit(
            "% vocoder score), and spectral continuity are within natural human phonation ranges "
            "across all time windows."
        ),
    )
    return F.when(F.col("category") == K.SYNTHETIC, synthetic).when(F.col("category") == K.SPLICED, spliced).otherwise(authentic)


def timeline_axis(windows: DataFrame, clips: DataFrame) -> DataFrame:
    """Chart position of each window (midpoint, one decimal, halves up)."""
    ends = windows.groupBy("clip_id").agg(F.max("end_time").alias("last_end"))
    axis = clips.join(ends, "clip_id", "left").select(
        "clip_id", F.coalesce(F.nullif(F.col("duration_sec"), F.lit(0.0)), F.col("last_end"), F.lit(5.0)).alias("axis_end")
    )
    return axis


def timeline_points(windows: DataFrame) -> DataFrame:
    mid = (F.col("start_time") + F.col("end_time")) / F.lit(2.0)
    return windows.withColumn("t", F.floor(mid * 10.0 + 0.5) / F.lit(10.0))


def clip_documents(clips: DataFrame, windows: DataFrame, part_size: int = DOCUMENT_PART) -> DataFrame:
    """Nested document rows per ``(clip, part)``; a part holds at most ``part_size`` windows.

    An ordinary clip is one part.  A clip with more windows spans several rows,
    so no document is gathered from an unbounded group.
    """
    row = F.struct(
        "window_id", "start_time", "end_time", "vocoder_score", "spectral_score", "prosody_score",
        "combined_score", "boundary_detected", "is_suspicious",
    )
    parts = (
        flag_windows(windows)
        .groupBy("clip_id", F.floor(F.col("window_id") / part_size).alias("part"))
        .agg(F.array_sort(F.collect_list(row)).alias("suspicion_timeline"))
    )
    return clips.join(parts, "clip_id", "left")
