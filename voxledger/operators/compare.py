"""Pair comparison: similarity per dimension, fusion, verdict and contradictions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxledger import constants as K
from voxledger.functions.numbers import fixed, ladder, linear_similarity, named, present, round_dp, round_sql, weighted_mean_present
from voxledger.functions.vectors import cosine
from voxledger.operators.synthesis import gap_rows


def pair_profiles(pairs: DataFrame, profiles: DataFrame) -> DataFrame:
    """Put both clips' profile structs next to each pair ``(a_id, b_id)``.

    Two equi-joins on the clip id; the profile table has one row per clip, so
    adaptive execution may split a clip that appears in many pairs.
    """
    body = F.struct(*[c for c in profiles.columns if c != "clip_id"])
    side = profiles.select("clip_id", body.alias("p"))
    return (
        pairs.join(side.withColumnsRenamed({"clip_id": "a_id", "p": "a"}), "a_id")
        .join(side.withColumnsRenamed({"clip_id": "b_id", "p": "b"}), "b_id")
    )


def _gap(field: str) -> Column:
    return F.abs(F.col(f"a.{field}") - F.col(f"b.{field}"))


def _similar(fields: list[str], tolerances, weights) -> Column:
    return linear_similarity([(f"a.{f}", f"b.{f}") for f in fields], tolerances, weights)


def both_available() -> Column:
    return F.coalesce(F.col("a.available") & F.col("b.available"), F.lit(False))


def missing_reason(default: str) -> Column:
    """First side's reason, else the second's, else ``default``; null when both are available."""
    return F.when(~both_available(), F.coalesce("a.reason", "b.reason", F.lit(default)))


PITCH_FIELDS = ["mean_f0", "range_semitones", "jitter_pct"]
FORMANT_FIELDS = ["f1_hz", "f2_hz", "f3_hz", "f4_hz", "formant_dispersion"]
RHYTHM_FIELDS = ["onset_rate_per_sec", "articulation_rate_per_sec", "speech_ratio", "mean_pause_sec"]


def pitch_score() -> Column:
    s = _similar(PITCH_FIELDS, K.PITCH_TOLERANCES, K.PITCH_WEIGHTS)
    return F.when(both_available(), round_dp(s * F.lit(100.0), 1))


def formant_score() -> Column:
    s = _similar(FORMANT_FIELDS, K.FORMANT_TOLERANCES, K.FORMANT_WEIGHTS)
    return F.when(both_available(), round_dp(s * F.lit(100.0), 1))


def rhythm_score() -> Column:
    s = _similar(RHYTHM_FIELDS, K.RHYTHM_TOLERANCES, K.RHYTHM_WEIGHTS)
    return F.when(both_available(), round_dp(s * F.lit(100.0), 1))


def spectral_score() -> Column:
    cos = F.coalesce((cosine("a.mfcc_mean", "b.mfcc_mean") + 1.0) / F.lit(2.0), F.lit(0.5))
    rest = _similar(
        ["spectral_centroid_mean", "spectral_rolloff_mean", "mean_pitch"], K.SPECTRAL_TOLERANCES, K.SPECTRAL_WEIGHTS
    )
    return round_dp((cos * F.lit(K.SPECTRAL_COSINE_WEIGHT) + rest) * F.lit(100.0), 1)


def environment_score() -> Column:
    loss = (
        F.least(F.lit(40.0), _gap("noise_floor_db") / F.lit(20.0) * F.lit(40.0))
        + F.least(F.lit(30.0), _gap("mean_spectral_contrast") / F.lit(5.0) * F.lit(30.0))
        + F.least(F.lit(30.0), _gap("rolloff_mean") / F.lit(2000.0) * F.lit(30.0))
    )
    return F.greatest(F.lit(0.0), F.lit(100.0) - loss)


# bar colours by share of the largest delta
DELTA_BANDS = ((0.75, "#f87171"), (0.5, "#facc15"), (0.25, "#a3e635"))
DELTA_BAND_BELOW = "#00ff88"


def mfcc_deltas(pairs: DataFrame, size: int = K.N_MFCC) -> DataFrame:
    """One row per coefficient: both values, |delta|, largest delta of the pair and band."""
    d = pairs.select("a_id", "b_id", F.col("a.mfcc_mean").alias("_a"), F.col("b.mfcc_mean").alias("_b"))
    d = d.withColumn("_d", F.zip_with("_a", "_b", lambda x, y: round_dp(F.abs(x - y), 3)))
    d = d.select("a_id", "b_id", F.array_max("_d").alias("max_delta"), F.posexplode(F.arrays_zip("_a", "_b", "_d")).alias("i", "r"))
    share = F.least(F.col("delta") / F.greatest(F.col("max_delta"), F.lit(1.0)), F.lit(1.0))
    return (
        d.where(F.col("i") < size)
        .select(
            "a_id", "b_id", (F.col("i") + 1).alias("coeff"), round_dp("r._a", 3).alias("val_1"), round_dp("r._b", 3).alias("val_2"),
            F.col("r._d").alias("delta"), "max_delta",
        )
        .withColumn("band", ladder(share, DELTA_BANDS, DELTA_BAND_BELOW))
    )


def spectral_deltas() -> list[Column]:
    fields = {
        "spectral_centroid_mean": ("delta_centroid_hz", 1),
        "spectral_bandwidth_mean": ("delta_bandwidth_hz", 1),
        "spectral_rolloff_mean": ("delta_rolloff_hz", 1),
        "rms_mean_db": ("delta_rms_db", 2),
        "dynamic_range_db": ("delta_dynamic_range_db", 2),
    }
    return [round_dp(_gap(f), dp).alias(name) for f, (name, dp) in fields.items()]


# --- fusion -------------------------------------------------------------------
def neural_composite(first: str, second: str) -> Column:
    """0.6 first + 0.4 second, or the second alone."""
    return round_dp(f"coalesce({first} * 0.6D + {second} * 0.4D, {second})", 1)


def risk_penalty(risk: str) -> Column:
    return F.expr(f"if({risk} > 60, ({risk} - 60D) / 40D * 30D, 0D)")


def fuse(pairs: DataFrame, weights: dict[str, float] = K.DIMENSION_WEIGHTS) -> DataFrame:
    """Fused similarity, verdict and confidence from six nullable dimension columns.

    Needs ``first_neural, second_neural, formants, pitch, spectral_mfcc, rhythm,
    energy, risk1, risk2`` and optionally ``no_speech_1, no_speech_2``.  Pitch,
    formant, rhythm and spectral scores have one decimal already.
    """
    d = pairs.withColumns({"neural_identity": neural_composite("first_neural", "second_neural"), "energy": round_dp("energy", 1)})
    for c in ("no_speech_1", "no_speech_2"):
        if c not in d.columns:
            d = d.withColumn(c, F.lit(False))
    d = d.withColumns(
        {
            "no_speech": F.expr("no_speech_1 OR no_speech_2"),
            "max_risk": F.greatest("risk1", "risk2"),
            "base": weighted_mean_present(weights),
        }
    ).withColumn("penalty", risk_penalty("max_risk"))
    d = d.withColumn("similarity", F.expr(f"if(no_speech, 0D, {round_sql('greatest(0D, base - penalty)', 1)})"))
    verdict = ladder("similarity", K.VERDICTS, K.VERDICT_BELOW)
    return d.withColumn("verdict", F.when(F.col("no_speech"), F.lit("Cannot Compare")).otherwise(verdict)).withColumns(
        {
            "colour": F.coalesce(named("verdict", K.VERDICT_COLOURS), F.lit("neutral")),
            "confidence": confidence(),
            "no_speech_files": F.expr(
                "filter(array(if(no_speech_1, 'Target Sample', NULL), if(no_speech_2, 'Comparison Sample', NULL)), s -> s IS NOT NULL)"
            ),
        }
    )


def confidence() -> Column:
    return F.expr(
        "CASE WHEN no_speech THEN 'NONE' "
        "WHEN first_neural IS NOT NULL AND similarity >= 65 AND max_risk < 40 THEN 'HIGH' "
        "WHEN similarity >= 45 AND max_risk < 60 THEN 'MEDIUM' ELSE 'LOW' END"
    )


def threshold_note(steps=K.VERDICTS, below: str = K.VERDICT_BELOW) -> str:
    """Ladder in words, generated from the ladder."""
    parts = [f">={b:g}% {name}" for b, name in steps]
    return "Verdict thresholds: " + ", ".join(parts) + f", <{steps[-1][0]:g}% {below}."


def contradictions(fused: DataFrame, threshold: float = K.DIMENSION_GAP) -> DataFrame:
    """Rows for every two dimensions that diverge, and for a high identity score under synthetic risk."""
    live = fused.where("NOT no_speech")
    conflicts = live.where("neural_identity >= 65 AND max_risk >= 50").selectExpr(
        "pair_id", "'neural_identity' AS high", "'deepfake_risk' AS low", "neural_identity AS score_high",
        "max_risk AS score_low", "abs(neural_identity - max_risk) AS delta",
    )
    rows = gap_rows(live, "pair_id", K.DIMENSION_ORDER, threshold).unionByName(conflicts)
    synthetic = F.expr("low = 'deepfake_risk'")
    shown = rows.select(
        "pair_id", F.when(synthetic, "synthetic_identity_conflict").otherwise("dimension_conflict").alias("type"),
        F.col("high").alias("dim_high"), F.col("low").alias("dim_low"), "score_high", "score_low",
        round_dp("delta", 1).alias("delta"),
    )
    high, low = named("dim_high", K.DIMENSION_PHRASES), named("dim_low", K.DIMENSION_PHRASES)
    at = (F.format_string("%.1f", "score_high"), F.format_string("%.1f", "score_low"))  # one decimal already
    gap_text = F.concat(
        high, F.lit(" shows high agreement ("), at[0], F.lit("%) while "), low, F.lit(" shows low agreement ("), at[1],
        F.lit(
            "%). This divergence is forensically significant and warrants closer examination of "
            "each dimension independently."
        ),
    )
    risk_text = F.concat(
        F.lit("Neural identity score is high ("), at[0], F.lit("%) but deepfake risk is also elevated ("), at[1],
        F.lit(
            "%). Match confidence is reduced — one or both samples may be a voice clone targeting "
            "the reference speaker."
        ),
    )
    return shown.withColumn("message", F.when(F.col("type") == "dimension_conflict", gap_text).otherwise(risk_text))


def dimension_rows(fused: DataFrame) -> DataFrame:
    """Radar rows: dimension, key, score, weight and availability."""
    rows = [
        F.struct(
            F.lit(K.RADAR_LABELS[k]).alias("dimension"), F.lit(k).alias("key"), F.col(k).alias("score"),
            F.lit(round(K.DIMENSION_WEIGHTS[k] * 100)).alias("weight_pct"), F.col(k).isNotNull().alias("available"),
        )
        for k in K.DIMENSION_ORDER
    ]
    return fused.select("pair_id", F.inline(F.array(*rows)))


# icon and pill bands of a telemetry row
STATUS_BANDS = ((65.0, "ok"), (45.0, "warn"))
PILL_BANDS = ((75.0, "green"), (50.0, "yellow"))


FIXED_NOTES = {
    "neural_identity": "Composite WavLM + ECAPA-TDNN voice embedding similarity.",
    "energy": "Signal environment and RMS loudness profile consistency.",
}


def telemetry_rows(fused: DataFrame, details: dict[str, dict[str, Column]] | None = None) -> DataFrame:
    """One row per dimension with its values, delta, status and pill band.

    ``details`` maps a dimension to columns ``val_1, val_2, delta, unit,
    delta_label, interpretation``.
    """
    details = {**{k: {"interpretation": F.lit(v)} for k, v in FIXED_NOTES.items()}, **(details or {})}
    rows = []
    for k in ("neural_identity", "pitch", "formants", "spectral_mfcc", "rhythm", "energy"):
        d = details.get(k, {})
        score = F.col(k)
        rows.append(
            F.struct(
                F.lit(K.TELEMETRY_LABELS[k]).alias("dimension"), F.lit(k).alias("key"), score.alias("score"),
                score.isNotNull().alias("available"),
                d.get("val_1", F.lit(None).cast("double")).alias("val_1"),
                d.get("val_2", F.lit(None).cast("double")).alias("val_2"),
                d.get("unit", F.lit(None).cast("string")).alias("unit"),
                d.get("delta_label", F.lit(None).cast("string")).alias("delta_label"),
                d.get("delta", F.lit(None).cast("double")).alias("delta"),
                d.get("interpretation", F.lit(None).cast("string")).alias("interpretation"),
                F.when(score.isNull(), "unavailable").otherwise(ladder(score, STATUS_BANDS, "fail")).alias("status"),
                F.when(score.isNull(), "N/A").otherwise(ladder(score, PILL_BANDS, "red")).alias("pill"),
            )
        )
    return fused.where(~F.col("no_speech")).select("pair_id", F.inline(F.array(*rows)))


def contour_alignment(pairs: DataFrame, points: DataFrame) -> DataFrame:
    """Two contours by position with the shared axis range; rows ``(clip_id, j, t, f0)`` per clip."""
    left = points.select(F.col("clip_id").alias("a_id"), "j", "t", F.col("f0").alias("f0_target"))
    right = points.select(F.col("clip_id").alias("b_id"), "j", F.col("f0").alias("f0_comparison"))
    d = pairs.join(left, "a_id").join(right, ["b_id", "j"], "left")
    w = Window.partitionBy("a_id", "b_id")  # one contour's points
    lo = F.least(F.min("f0_target").over(w), F.min("f0_comparison").over(w))
    hi = F.greatest(F.max("f0_target").over(w), F.max("f0_comparison").over(w))
    return d.select(
        "a_id", "b_id", "j", "t", "f0_target", "f0_comparison",
        F.coalesce(F.when(lo.isNotNull(), F.greatest(F.lit(0.0), lo - F.lit(20.0))), F.lit(60.0)).alias("y_min"),
        F.coalesce(F.when(hi.isNotNull(), F.least(F.lit(600.0), hi + F.lit(20.0))), F.lit(400.0)).alias("y_max"),
    )


def pitch_text() -> Column:
    m, r = _gap("mean_f0"), _gap("range_semitones")
    mean = (
        F.when(m < 15, F.format_string("Mean pitch is closely matched (%s Hz apart).", fixed(m, 1)))
        .when(
            m < 40,
            F.format_string(
                "Mean pitch shows moderate divergence (%s Hz), consistent with different recording "
                "conditions or emotional state.", fixed(m, 1),
            ),
        )
        .otherwise(
            F.format_string(
                "Mean pitch diverges significantly (%s Hz), suggesting different physiological vocal registers.", fixed(m, 1)
            )
        )
    )
    spread = (
        F.when(r < 3, F.lit("Pitch range (expressivity) is similar."))
        .when(r < 8, F.format_string("Pitch range differs by %s semitones; may reflect different speaking styles.", fixed(r, 1)))
        .otherwise(
            F.format_string(
                "Pitch range differs substantially (%s semitones); this level of divergence is unlikely for the same speaker.",
                fixed(r, 1),
            )
        )
    )
    return F.when(both_available(), F.concat_ws(" ", mean, spread))


def formant_text() -> Column:
    d1, d2, disp = _gap("f1_hz"), _gap("f2_hz"), _gap("formant_dispersion")
    at = (fixed(d1, 0), fixed(d2, 0))
    body = (
        F.when(
            (d1 < 80) & (d2 < 120),
            F.format_string(
                "First and second formants are closely matched (F1 delta=%s Hz, F2 delta=%s Hz), "
                "consistent with similar vocal tract geometry.", *at,
            ),
        )
        .when(
            (d1 < 150) | (d2 < 200),
            F.format_string(
                "Formant structure shows partial agreement (F1 delta=%s Hz, F2 delta=%s Hz). Moderate divergence may "
                "reflect different phonetic context or recording conditions.", *at,
            ),
        )
        .otherwise(
            F.format_string(
                "Formant profiles diverge substantially (F1 delta=%s Hz, F2 delta=%s Hz). This suggests different vocal "
                "tract anatomies, i.e. likely different speakers.", *at,
            )
        )
    )
    more = F.when(
        disp > 150,
        F.format_string(
            "Formant dispersion differs by %s Hz, indicating a meaningful difference in estimated vocal tract length.",
            fixed(disp, 0),
        ),
    )
    return F.when(both_available(), F.concat_ws(" ", body, more))


def rhythm_text() -> Column:
    r, a = _gap("onset_rate_per_sec"), _gap("articulation_rate_per_sec")
    rates = (fixed("a.onset_rate_per_sec", 2), fixed("b.onset_rate_per_sec", 2))
    body = (
        F.when(r < 1, F.format_string("Syllable onset rates are closely matched (%s vs %s onsets/sec).", *rates))
        .when(
            r < 3,
            F.format_string(
                "Moderate difference in onset rate (%s vs %s onsets/sec). Could reflect different speaking styles "
                "or emotional states.", *rates,
            ),
        )
        .otherwise(
            F.format_string(
                "Substantial onset rate divergence (%s vs %s onsets/sec), suggesting different speaking tempos.", *rates
            )
        )
    )
    more = F.when(
        a > 2,
        F.format_string(
            "Articulation rates differ meaningfully (%s vs %s syllables/sec of active speech).",
            fixed("a.articulation_rate_per_sec", 2), fixed("b.articulation_rate_per_sec", 2),
        ),
    )
    return F.when(both_available(), F.concat_ws(" ", body, more))


def with_spectral_text(pairs: DataFrame, score: str = "score", size: int = K.N_MFCC) -> DataFrame:
    """Add ``text`` from the score, the mean coefficient delta and the centroid delta."""
    deltas = F.zip_with("a.mfcc_mean", "b.mfcc_mean", lambda x, y: round_dp(F.abs(x - y), 3))
    d = pairs.withColumn("_mean", F.aggregate(deltas, F.lit(0.0), lambda s, x: s + x) / F.lit(float(size))).withColumn(
        "_centroid", _gap("spectral_centroid_mean")
    )
    at = (fixed("_mean", 2), fixed("_centroid", 0))
    text = (
        F.when(
            F.col(score) >= 75,
            F.lit(
                "Spectral and MFCC fingerprints are closely matched, suggesting similar vocal timbre and "
                "resonance characteristics."
            ),
        )
        .when(
            F.col(score) >= 50,
            F.format_string(
                "Moderate spectral divergence (MFCC mean delta=%s; centroid delta=%s Hz). Could reflect different "
                "microphone responses or speaking styles.", *at,
            ),
        )
        .otherwise(
            F.format_string(
                "Spectral profiles differ substantially (MFCC mean delta=%s; centroid delta=%s Hz), indicating "
                "different acoustic characteristics between samples.", *at,
            )
        )
    )
    return d.withColumn("text", text).drop("_mean", "_centroid")


def breakdown_lines() -> Column:
    """Ordered score lines of a fused pair; missing dimensions are named, a penalty is appended."""
    def line(label: str, c: str, missing: str | None = None) -> Column:
        text = F.concat(F.lit(f"{label}: "), fixed(c, 1), F.lit("%"))
        return text if missing is None else F.coalesce(text, F.lit(missing))

    penalty = F.when(
        F.col("penalty") > 0,
        F.concat(
            F.lit("WARNING Deepfake Penalty Applied: -"), fixed("penalty", 1), F.lit(" pts (max synthetic risk: "),
            fixed("max_risk", 0), F.lit("%)"),
        ),
    )
    lines = present(
        line(
            "WavLM Neural Verification (wavlm-base-plus-sv)", "first_neural",
            "WavLM Neural Verification: Offline (model load error — reduced accuracy)",
        ),
        line("Secondary Speaker Embedding (ECAPA-TDNN / Wav2Vec2)", "second_neural"),
        line("Neural Identity Composite", "neural_identity"),
        line("Spectral & MFCC Fingerprint", "spectral_mfcc"),
        line("Energy Dynamics", "energy"),
        line("Pitch Contour & Intonation", "pitch", "Pitch Contour: Unavailable"),
        line("Vocal Tract Formants (F1-F4)", "formants", "Formant Analysis: Unavailable"),
        line("Speaking Rate & Rhythm", "rhythm", "Rhythm Analysis: Unavailable"),
        penalty,
    )
    mute = F.array(
        F.concat(
            F.lit("CANNOT COMPARE: No speech detected in "), F.array_join("no_speech_files", ", "),
            F.lit(". Ensure uploaded files contain clear speech."),
        )
    )
    return F.when(F.col("no_speech"), mute).otherwise(lines)


