"""Clip preparation: framing, energy gating, trimming, levelling.

The unit is the frame row ``(clip_id, frame_id, n, xs, seg)``: ``frame_len``
samples as one array, the clip's last frame possibly shorter.  A clip is never
gathered; whatever a frame needs from its clip is an aggregate of frame rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxledger import constants as K
from voxledger.functions.numbers import fixed, present, round_dp
from voxledger.functions.ordered import SEG, attach, ordered, quantiles, seg_of, with_segments
from voxledger.functions.vectors import dot, scaled

CLIP = ["clip_id"]


def downmix(samples: DataFrame) -> DataFrame:
    """Mean over channels per sample position."""
    return samples.groupBy("clip_id", "seq").agg(F.avg("x").alias("x"))


def cap_duration(samples: DataFrame, max_seconds: int, sr: int = K.SAMPLE_RATE) -> DataFrame:
    """First ``max_seconds`` of each clip."""
    return samples.where(F.col("seq") < sr * max_seconds)


def frames_from_samples(samples: DataFrame, frame_len: int = K.GATE_FRAME) -> DataFrame:
    """Sample rows to frame rows; a frame holds at most ``frame_len`` samples."""
    d = with_segments(samples, CLIP, "seq")
    return (
        d.groupBy("clip_id", F.floor(F.col("seq") / frame_len).alias("frame_id"))
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.array_sort(F.collect_list(F.struct("seq", "x"))).alias("rows"),
            seg_of(d),
        )
        .select("clip_id", "frame_id", "n", F.col("rows.x").alias("xs"), SEG)
    )


def frames_from_blocks(blocks: DataFrame, frame_len: int = K.GATE_FRAME) -> DataFrame:
    """Block rows ``(clip_id, block_id, start, xs)`` to frame rows, without a shuffle.

    Block starts are multiples of ``frame_len``.
    """
    d = with_segments(blocks, CLIP, "start", step=frame_len)
    cuts = F.sequence(F.lit(0), F.floor((F.size("xs") - 1) / frame_len).cast("int"))
    return (
        d.where(F.size("xs") > 0)
        .select("clip_id", "start", SEG, "xs", F.explode(cuts).alias("i"))
        .select(
            "clip_id",
            (F.floor(F.col("start") / frame_len) + F.col("i")).alias("frame_id"),
            F.slice("xs", F.col("i") * frame_len + 1, F.lit(frame_len)).alias("xs"),
            SEG,
        )
        .withColumn("n", F.size("xs").cast("long"))
    )


def frame_energy(frames: DataFrame, frame_len: int = K.GATE_FRAME) -> DataFrame:
    """Sum of squares, RMS and dB per frame; ``full`` marks frames that are gated on."""
    ss = dot("xs", "xs")
    rms = F.sqrt(F.col("ss") / F.col("n"))
    return (
        frames.withColumn("ss", ss)
        .withColumn("rms", rms)
        .withColumn("rms_db", F.lit(20.0) * F.log10(F.greatest(F.col("rms"), F.lit(1e-10))))
        .withColumn("full", F.col("n") == frame_len)
    )


def energy_profile(frames: DataFrame) -> DataFrame:
    """One row per clip: level, spread, noise floor and gate threshold."""
    level = frames.groupBy("clip_id").agg(
        F.sum("n").alias("n_samples"),
        F.sum("ss").alias("clip_ss"),
        F.sum(F.col("full").cast("long")).alias("n_frames"),
        F.stddev_pop(F.when(F.col("full"), F.col("rms_db"))).alias("std_db"),
        seg_of(frames, F.max),
    )
    floor = quantiles(frames.where("full"), CLIP, "rms_db", {"noise_floor_db": K.GATE_FLOOR_QUANTILE})
    rms = F.sqrt(F.col("clip_ss") / F.col("n_samples"))
    return (
        level.join(floor, "clip_id", "left")
        .withColumn("global_db", F.lit(20.0) * F.log10(F.greatest(rms, F.lit(1e-10))))
        .withColumn("threshold_db", F.col("noise_floor_db") + K.GATE_MARGIN_DB)
    )


def with_activity(frames: DataFrame, profile: DataFrame) -> DataFrame:
    """Attach the profile to frames and add ``active``, ``n_active``, ``last_active``."""
    active = F.col("full") & (F.col("rms_db") >= F.col("threshold_db"))
    last = (F.col("frame_id") == F.col("n_frames") - 1) & active
    kept = [c for c in profile.columns if c not in ("clip_id", SEG)]
    # frames without their samples meet the profile once; what comes of it goes to the frames as one row per clip
    counts = attach(frames.select("clip_id", "frame_id", "full", "rms_db"), profile, CLIP).groupBy("clip_id").agg(
        *[F.first(c).alias(c) for c in kept], F.sum(active.cast("long")).alias("n_active"), F.max(last.cast("int")).alias("last_active")
    )
    return attach(frames, counts, CLIP).withColumn("active", active)


def gate_tier(
    trim_uniform: Column, trim_fallback: Column, min_samples: int = int(K.SAMPLE_RATE * K.TRIM_MIN_SECONDS)
) -> tuple[Column, Column]:
    """(tier, reject reason) from profile columns; trims are lengths left after trimming.

    Tier 0 keeps everything, 1 trims the edges of a uniform clip, 2 drops quiet
    frames, 3 trims the edges where gating would drop too much.
    """
    ratio = F.col("n_active") / F.nullif(F.col("n_frames"), F.lit(0))
    uniform = F.col("std_db") < K.GATE_UNIFORM_STD_DB
    tier = (
        F.when(F.col("n_frames") == 0, 0)
        .when(F.col("global_db") < K.GATE_SILENCE_DB, F.lit(None).cast("int"))
        .when(uniform & (trim_uniform >= min_samples), 1)
        .when(uniform, 0)
        .when(ratio >= K.GATE_MIN_ACTIVE, 2)
        .when(trim_fallback >= min_samples, 3)
    )
    return tier, F.when(tier.isNull(), F.lit("no_speech"))


def edge_bounds(
    frames: DataFrame,
    top_dbs: dict[str, float],
    frame_len: int = K.GATE_FRAME,
    trim_frame: int = K.TRIM_FRAME,
    trim_hop: int = K.TRIM_HOP,
) -> DataFrame:
    """Per clip and name: first and one-past-last sample within ``top_db`` of the loudest trim frame.

    Trim frames are centred on multiples of ``trim_hop`` over a zero-padded clip,
    so each is a sum of whole cells of ``trim_hop`` samples; cells are summed
    once and spread to the frames that contain them.
    """
    start = F.col("frame_id") * frame_len
    first, last = F.floor(start / trim_hop), F.floor((start + F.col("n") - 1) / trim_hop)
    lo = F.greatest(F.col("cell") * trim_hop, F.col("start"))
    hi = F.least((F.col("cell") + 1) * trim_hop, F.col("start") + F.col("n"))
    part = F.slice("xs", (lo - F.col("start") + 1).cast("int"), (hi - lo).cast("int"))
    cells = (
        frames.select("clip_id", SEG, "xs", "n", start.alias("start"), F.explode(F.sequence(first, last)).alias("cell"))
        .select("clip_id", SEG, "cell", (hi - lo).alias("m"), dot(part, part).alias("ss"))
        .groupBy("clip_id", "cell")
        .agg(F.sum("ss").alias("ss"), F.sum("m").alias("m"), seg_of(frames))
    )
    half = trim_frame // (2 * trim_hop)
    spread = F.sequence(F.greatest(F.lit(0), F.col("cell") - half + 1), F.col("cell") + half)
    energies = (
        cells.select("clip_id", SEG, "ss", F.when(F.col("m") > 0, F.col("cell")).alias("own"), "m", F.explode(spread).alias("f"))
        .groupBy("clip_id", "f")
        .agg(
            F.sqrt(F.sum("ss") / F.lit(float(trim_frame))).alias("rms"),
            seg_of(frames),
            F.sum(F.when(F.col("own") == F.col("f"), F.col("m")).otherwise(0)).alias("m"),
        )
        .withColumn("db", F.lit(20.0) * F.log10(F.greatest(F.col("rms"), F.lit(1e-5))))
    )
    d = ordered(energies, CLIP, ["f"], totals={"top": ("max", "db"), "len": ("sum", "m")})
    # the padded clip has 1 + floor(len / hop) frames
    d = d.where(F.col("f") <= F.floor(F.col("len") / trim_hop))
    aggs = []
    for name, top in top_dbs.items():
        loud = F.when(F.col("db") > F.col("top") - F.lit(float(top)), F.col("f"))
        aggs += [
            F.coalesce(F.min(loud) * trim_hop, F.lit(0)).alias(f"{name}_start"),
            F.least(F.max("len"), F.coalesce((F.max(loud) + 1) * trim_hop, F.lit(0))).alias(f"{name}_end"),
        ]
    return d.groupBy("clip_id").agg(*aggs)


def gate(
    frames: DataFrame,
    frame_len: int = K.GATE_FRAME,
    trim_frame: int = K.TRIM_FRAME,
    trim_hop: int = K.TRIM_HOP,
    min_samples: int = int(K.SAMPLE_RATE * K.TRIM_MIN_SECONDS),
) -> DataFrame:
    """Tiered speech gate: frames that stay, cut where a trim edge falls inside one.

    Adds ``tier``, ``reject_reason``, ``start`` (first kept sample); a rejected
    clip keeps one row without samples so that its reason is not lost.
    """
    frames = frame_energy(frames, frame_len)
    bounds = edge_bounds(
        frames, {"t1": K.TRIM_UNIFORM_DB, "t3": K.TRIM_FALLBACK_DB}, frame_len, trim_frame, trim_hop
    )
    profile = energy_profile(frames).join(bounds, "clip_id")
    d = with_activity(frames, profile)
    tier, reason = gate_tier(
        F.col("t1_end") - F.col("t1_start"), F.col("t3_end") - F.col("t3_start"), min_samples
    )
    start, end = F.col("frame_id") * frame_len, F.col("frame_id") * frame_len + F.col("n")
    lo = F.when(F.col("tier") == 1, F.col("t1_start")).when(F.col("tier") == 3, F.col("t3_start")).otherwise(start)
    hi = F.when(F.col("tier") == 1, F.col("t1_end")).when(F.col("tier") == 3, F.col("t3_end")).otherwise(end)
    keep = F.when(F.col("tier") == 2, F.when(F.col("full"), F.col("active")).otherwise(F.col("last_active") == 1)).otherwise(
        F.col("tier").isNotNull()
    )
    d = (
        d.withColumn("tier", tier)
        .withColumn("reject_reason", reason)
        .withColumn("lo", F.greatest(start, lo))
        .withColumn("hi", F.least(end, hi))
        .withColumn("m", F.when(keep, F.greatest(F.lit(0), F.col("hi") - F.col("lo"))).otherwise(F.lit(0)))
        .where((F.col("m") > 0) | (F.col("reject_reason").isNotNull() & (F.col("frame_id") == 0)))
    )
    cut = F.when(F.col("m") > 0, F.slice("xs", (F.col("lo") - start + 1).cast("int"), F.col("m").cast("int"))).otherwise(
        F.slice("xs", 1, 0)
    )
    return d.select(
        "clip_id", "frame_id", cut.alias("xs"), F.col("m").alias("n"), F.col("lo").alias("start"), SEG,
        "tier", "reject_reason", "n_samples", "n_frames", "n_active", "std_db", "noise_floor_db", "threshold_db",
        "global_db",
    )


def resequence(frames: DataFrame) -> DataFrame:
    """New contiguous sample positions for what is left: ``pos`` is the frame's first one."""
    d = ordered(frames, CLIP, ["frame_id"], sums={"_end": "n"})
    return d.withColumn("pos", F.col("_end") - F.col("n")).drop("_end")


def normalise_rms(frames: DataFrame, target: float = K.TARGET_RMS) -> DataFrame:
    """Scale each clip to ``target`` RMS and limit to [-1, 1]; near-silent clips stay."""
    d = ordered(
        frames.withColumn("_ss", dot("xs", "xs")),
        CLIP,
        ["frame_id"],
        totals={"_all": ("sum", "_ss"), "speech_samples": ("sum", "n")},
    )
    rms = F.sqrt(F.col("_all") / F.nullif(F.col("speech_samples"), F.lit(0)))
    gain = F.expr(f"if(source_rms > 1e-8D, {target}D / source_rms, NULL)")
    levelled = scaled("xs", gain, lambda x, k: F.greatest(F.lit(-1.0), F.least(F.lit(1.0), x * k)))
    return (
        d.withColumn("source_rms", rms)
        .withColumn("xs", F.when(F.col("source_rms") > 1e-8, levelled).otherwise(F.col("xs").cast("array<double>")))
        .drop("_ss", "_all")
    )


def envelope(frames: DataFrame, points: int = K.ENVELOPE_POINTS) -> DataFrame:
    """``points`` peak values per clip relative to the largest, as rows."""
    d = frames if "speech_samples" in frames.columns else ordered(
        frames, CLIP, ["frame_id"], totals={"speech_samples": ("sum", "n")}
    )
    size = F.greatest(F.lit(1), F.floor(F.col("speech_samples") / points))
    lo = F.greatest(F.col("point") * F.col("size"), F.col("pos"))
    hi = F.least((F.col("point") + 1) * F.col("size"), F.col("pos") + F.col("n"))
    part = F.slice("xs", (lo - F.col("pos") + 1).cast("int"), (hi - lo).cast("int"))
    ids = F.sequence(F.floor(F.col("pos") / F.col("size")), F.floor((F.col("pos") + F.col("n") - 1) / F.col("size")))
    peaks = (
        d.where(F.col("n") > 0)
        .withColumn("size", size)
        .select("clip_id", "pos", "n", "xs", "size", F.explode(ids).alias("point"))
        .where(F.col("point") < points)
        .select("clip_id", "point", F.array_max(F.transform(part, lambda x: F.abs(x))).alias("peak"))
        .groupBy("clip_id", "point")
        .agg(F.max("peak").alias("peak"))
    )
    top = F.max("peak").over(Window.partitionBy("clip_id"))  # at most `points` rows per clip
    return peaks.select(
        "clip_id", "point", round_dp(F.when(top > 0, F.col("peak") / F.nullif(top, F.lit(0.0))).otherwise(F.col("peak")), 3).alias("level")
    )


def split_rejects(clips: DataFrame, sr: int = K.SAMPLE_RATE, min_seconds: float = K.MIN_SPEECH_SECONDS) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejects) from clip rows with ``error, peak, reject_reason, speech_samples``."""
    speech = F.col("speech_samples") / F.lit(float(sr))
    reason = F.coalesce(
        F.col("error"),
        F.when(F.coalesce(F.col("peak"), F.lit(0.0)) == 0, F.lit("silent_or_empty")),
        F.col("reject_reason"),
        F.when(speech < min_seconds, F.lit("too_short")),
    )
    d = clips.withColumn("reason", reason)
    return d.where("reason IS NULL").drop("reason"), d.where("reason IS NOT NULL").select("clip_id", "reason")


def step_log(sr: int = K.SAMPLE_RATE, max_seconds: int | None = None) -> Column:
    """Ordered list of what was applied, from clip-level columns; ``max_seconds`` as the clips were cut to, if they were."""
    kept = fixed(F.col("speech_samples") / F.lit(float(sr)), 2)
    std = fixed("std_db", 1)
    share = fixed(F.col("n_active") / F.nullif(F.col("n_frames"), F.lit(0)) * 100.0, 0)
    gate_step = (
        F.when(F.col("n_frames") == 0, F.lit("VAD skipped: audio too short to frame"))
        .when(
            F.col("tier") == 1,
            F.format_string(
                "VAD tier1 (uniform-energy bypass): edge-trim applied. "
                f"%ss retained (energy_std=%sdB < {K.GATE_UNIFORM_STD_DB}dB, frame gating skipped)", kept, std,
            ),
        )
        .when(
            F.col("tier") == 0,
            F.format_string("VAD tier1 (uniform-energy bypass): full signal retained (energy_std=%sdB)", std),
        )
        .when(
            F.col("tier") == 2,
            F.format_string(
                f"VAD tier2 (frame-energy): %d/%d frames active (%s%% retained, threshold: %sdB + {K.GATE_MARGIN_DB}dB)",
                F.col("n_active"), F.col("n_frames"), share, fixed("noise_floor_db", 1),
            ),
        )
        .when(F.col("tier") == 3, F.format_string("VAD tier3 (librosa fallback): edge-trim top_db=30 - %ss retained", kept))
    )
    return present(
        F.when(F.col("channels") > 1, F.lit("Stereo -> Mono downmix")),
        *([] if max_seconds is None else [F.when(F.col("raw_samples") > F.lit(max_seconds * sr), F.lit(f"Truncated to {max_seconds}s"))]),
        gate_step,
        F.when(
            F.col("source_rms") > 1e-8,
            F.format_string(f"RMS normalization (source RMS: %s -> target: {K.TARGET_RMS})", fixed("source_rms", 4)),
        ).otherwise(F.lit("Skipped RMS normalization (near-silent signal)")),
    )
