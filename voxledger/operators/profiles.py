"""One feature row per clip: pitch, formants, rhythm, spectrum, energy, environment."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxledger import constants as K
from voxledger.functions.numbers import round_dp
from voxledger.functions.ordered import SEG, ordered, quantiles, with_segments
from voxledger.functions.vectors import dot, l2_normalise, mean_vector, var_vector

CLIP = ["clip_id"]


def relative_variation(df: DataFrame, x: str, order: str, out: str) -> DataFrame:
    """100 * mean|step between consecutive rows| / mean, per clip; 0 for a zero mean or one row."""
    d = ordered(with_segments(df, CLIP, order), CLIP, [order], previous={"_p": x})
    step = F.avg(F.abs(F.col(x) - F.col("_p")))
    mean = F.avg(x)
    return d.groupBy("clip_id").agg(
        mean.alias(f"mean_{x}"),
        F.coalesce(F.when(mean > 0, step / mean * F.lit(100.0)), F.lit(0.0)).alias(out),
    )


def pitch_profile(pframes: DataFrame, min_voiced: int = 5) -> DataFrame:
    """Pitch statistics per clip; unavailable with a reason below ``min_voiced`` frames."""
    d = with_segments(pframes, CLIP, "frame_id")
    voiced = d.where("voiced AND f0 > 0")
    frames = d.groupBy("clip_id").agg(F.count(F.lit(1)).alias("n_frames"))
    steps = ordered(voiced, CLIP, ["frame_id"], previous={"_p": "f0"})
    mean = F.avg("f0")
    stats = steps.groupBy("clip_id").agg(
        F.count("f0").alias("n_voiced"),
        mean.alias("mean_f0"),
        F.min("f0").alias("min_f0"),
        F.max("f0").alias("max_f0"),
        F.coalesce(F.avg(F.abs(F.col("f0") - F.col("_p"))) / mean * F.lit(100.0), F.lit(0.0)).alias("jitter_pct"),
    )
    median = quantiles(voiced, CLIP, "f0", {"median_f0": 0.5})
    all_clips = frames.join(stats, "clip_id", "left").join(median, "clip_id", "left").fillna(0, subset=["n_voiced"])
    ok = F.col("n_voiced") >= min_voiced

    def known(e: Column, dp: int) -> Column:
        return F.when(F.col("available"), round_dp(e, dp))

    return (
        all_clips.withColumn("available", ok)
        .withColumn(
            "reason",
            F.when(~ok, F.concat(F.lit("Insufficient voiced frames ("), F.col("n_voiced").cast("string"), F.lit(")"))),
        )
        .select(
            "clip_id", "available", "reason", "n_frames", "n_voiced",
            known(F.col("mean_f0"), 2).alias("mean_f0"),
            known(F.col("median_f0"), 2).alias("median_f0"),
            known(F.col("min_f0"), 2).alias("min_f0"),
            known(F.col("max_f0"), 2).alias("max_f0"),
            known(F.lit(12.0) * F.log2(F.col("max_f0") / F.col("min_f0")), 2).alias("range_semitones"),
            known(F.col("jitter_pct"), 3).alias("jitter_pct"),
            known(F.col("n_voiced") / F.col("n_frames"), 3).alias("voiced_fraction"),
        )
    )


def resample_points(df: DataFrame, order: str, k: int = K.CURVE_POINTS, carry: Sequence[str] = ()) -> DataFrame:
    """``k`` evenly spaced rows per clip by index floor(j*(n-1)/(k-1)); ``t`` runs from 0 to 1.

    Each row finds the points it stands for by arithmetic on its own index, so
    nothing is joined: row i serves every j with floor(j*(n-1)/(k-1)) = i.
    """
    d = ordered(with_segments(df, CLIP, order), CLIP, [order], index="_i", totals={"_n": ("sum", F.lit(1))})
    span = F.col("_n") - 1
    lo = F.when(span > 0, F.ceil(F.col("_i") * (k - 1) / F.nullif(span, F.lit(0)))).otherwise(0)
    hi = F.when(span > 0, F.least(F.lit(k - 1), F.ceil((F.col("_i") + 1) * (k - 1) / F.nullif(span, F.lit(0))) - 1)).otherwise(k - 1)
    return (
        d.withColumn("_lo", lo.cast("long"))
        .withColumn("_hi", hi.cast("long"))
        .where("_lo <= _hi")
        .withColumn("j", F.explode(F.sequence("_lo", "_hi")))
        .select("clip_id", "j", round_dp(F.col("j") / F.lit(float(k - 1)), 4).alias("t"), *carry)
    )


def pitch_contour(pframes: DataFrame, k: int = K.CURVE_POINTS) -> DataFrame:
    d = pframes.withColumn("_f", F.when(F.col("voiced") & (F.col("f0") > 0), F.col("f0")))
    return resample_points(d, "frame_id", k, ["_f"]).select("clip_id", "j", "t", round_dp("_f", 2).alias("f0"))


def energy_curve(frames: DataFrame, k: int = K.CURVE_POINTS) -> DataFrame:
    """``k``-point RMS curve relative to its own maximum."""
    pts = resample_points(frames, "frame_id", k, ["rms"])
    top = F.max("rms").over(Window.partitionBy("clip_id"))  # k rows per clip
    return pts.select(
        "clip_id", "j", round_dp(F.when(top > 0, F.col("rms") / F.nullif(top, F.lit(0.0))).otherwise(F.col("rms")), 4).alias("level")
    )


def formant_profile(fframes: DataFrame, min_frames: int = 5) -> DataFrame:
    """Median F1..F4 from rows ``(clip_id, f1, f2, f3, f4)`` and dispersion (F4-F1)/3."""
    d = with_segments(fframes, CLIP, "frame_id").selectExpr(
        "clip_id", SEG, "stack(4, 'f1', CAST(f1 AS DOUBLE), 'f2', CAST(f2 AS DOUBLE), 'f3', CAST(f3 AS DOUBLE), 'f4', CAST(f4 AS DOUBLE)) AS (f, hz)"
    )
    names = ("f1", "f2", "f3", "f4")
    med = quantiles(d, ["clip_id", "f"], "hz", {"med": 0.5}, count="n")
    out = med.groupBy("clip_id").agg(
        F.max("n").alias("n_frames"), *[F.expr(f"max(med) FILTER (WHERE f = '{f}')").alias(f"{f}_med") for f in names]
    )
    ok = F.col("n_frames") >= min_frames
    meds = [F.when(ok, round_dp(f"{f}_med", 1)).alias(f"{f}_hz") for f in ("f1", "f2", "f3", "f4")]
    return out.select(
        "clip_id", ok.alias("available"),
        F.when(
            ~ok, F.concat(F.lit("Too few voiced frames for formant analysis ("), F.col("n_frames").cast("string"), F.lit(")"))
        ).alias("reason"),
        "n_frames", *meds,
        F.when(ok, round_dp((F.col("f4_med") - F.col("f1_med")) / F.lit(3.0), 1)).alias("formant_dispersion"),
    )


def with_speech_mask(frames: DataFrame, share: float = 0.15) -> DataFrame:
    """``speech`` marks frames above ``share`` of the clip's loudest frame."""
    d = ordered(with_segments(frames, CLIP, "frame_id"), CLIP, ["frame_id"], totals={"_top": ("max", "rms")})
    return d.withColumn("speech", F.col("rms") > F.col("_top") * F.lit(share)).drop("_top")


def interior_pauses(masked: DataFrame, frame_sec: float, shortest: float = 0.05) -> DataFrame:
    """Silent runs between two speech frames longer than ``shortest`` seconds, as rows.

    A pause is the gap between consecutive speech frames, so only speech rows
    are ordered.
    """
    speech = ordered(masked.where("speech"), CLIP, ["frame_id"], previous={"_p": "frame_id"})
    gap = F.col("frame_id") - F.col("_p") - 1
    return speech.where((gap > 0) & (gap * F.lit(frame_sec) > shortest)).select(
        "clip_id", (F.col("_p") + 1).alias("first_frame"), gap.alias("n_frames"), (gap * F.lit(frame_sec)).alias("pause_sec")
    )


def rhythm_profile(
    masked: DataFrame, onsets: DataFrame, durations: DataFrame, frame_sec: float = K.HOP / K.SAMPLE_RATE,
    shortest_clip: float = 0.5, shortest_pause: float = 0.05, min_speech: float = 0.1,
) -> DataFrame:
    """Onset rate, articulation rate, speech ratio and mean interior pause per clip."""
    speech = masked.groupBy("clip_id").agg((F.sum(F.col("speech").cast("long")) * F.lit(frame_sec)).alias("speech_sec"))
    n_on = onsets.groupBy("clip_id").agg(F.count(F.lit(1)).alias("n_onsets"))
    pauses = interior_pauses(masked, frame_sec, shortest_pause).groupBy("clip_id").agg(F.avg("pause_sec").alias("mean_pause"))
    d = (
        durations.join(speech, "clip_id", "left").join(n_on, "clip_id", "left").join(pauses, "clip_id", "left")
        .fillna(0, subset=["n_onsets"]).fillna(0.0, subset=["speech_sec", "mean_pause"])
    )
    ok = F.col("duration_sec") >= shortest_clip
    dur = F.nullif(F.col("duration_sec"), F.lit(0.0))
    rate = F.when(F.col("speech_sec") > min_speech, F.col("n_onsets") / F.nullif(F.col("speech_sec"), F.lit(0.0))).otherwise(0.0)
    return d.select(
        "clip_id", ok.alias("available"),
        F.when(~ok, F.lit("Audio too short for rhythm analysis")).alias("reason"),
        F.when(ok, round_dp(F.col("n_onsets") / dur, 3)).alias("onset_rate_per_sec"),
        F.when(ok, round_dp(rate, 3)).alias("articulation_rate_per_sec"),
        F.when(ok, round_dp(F.col("speech_sec") / dur, 3)).alias("speech_ratio"),
        F.when(ok, round_dp("mean_pause", 3)).alias("mean_pause_sec"),
    )


def vector_stats(df: DataFrame, v: str, size: int, dp: int = 4) -> DataFrame:
    """Element-wise mean and population variance of a fixed-size vector per clip."""
    d = df.groupBy("clip_id").agg(mean_vector(v, size).alias("_m"), var_vector(v, size).alias("_v"))
    return d.select(
        "clip_id",
        F.transform("_m", lambda x: round_dp(x, dp)).alias(f"{v}_mean"),
        F.transform("_v", lambda x: round_dp(x, dp)).alias(f"{v}_var"),
    )


MEAN_PLACES = {"centroid": 2, "bandwidth": 2, "rolloff": 2, "contrast": 4}


def spectral_means(sframes: DataFrame, places: dict[str, int] = MEAN_PLACES) -> DataFrame:
    """Clip means of the spectral shape, rounded."""
    return sframes.groupBy("clip_id").agg(*[round_dp(f"avg({c})", dp).alias(f"spectral_{c}_mean") for c, dp in places.items()])


def relative_db(rms: Column, top: Column, floor_db: float = 80.0) -> Column:
    """dB relative to the clip's loudest frame, at most ``floor_db`` below the loudest."""
    ref = F.lit(20.0) * F.log10(F.greatest(F.lit(1e-5), top + F.lit(1e-9)))
    db = F.lit(20.0) * F.log10(F.greatest(F.lit(1e-5), rms)) - ref
    top_db = F.lit(20.0) * F.log10(F.greatest(F.lit(1e-5), top)) - ref
    return F.greatest(db, top_db - F.lit(floor_db))


def energy_dynamics(frames: DataFrame) -> DataFrame:
    """Mean and spread of a clip's relative dB, and its P95-P5."""
    d = ordered(with_segments(frames, CLIP, "frame_id"), CLIP, ["frame_id"], totals={"_top": ("max", "rms")})
    d = d.withColumn("db", relative_db(F.col("rms"), F.col("_top")))
    q = quantiles(d, CLIP, "db", {"p95": 0.95, "p05": 0.05})
    return (
        d.groupBy("clip_id")
        .agg(F.avg("db").alias("m"), F.stddev_pop("db").alias("s"))
        .join(q, "clip_id")
        .select(
            "clip_id",
            round_dp("m", 2).alias("rms_mean_db"),
            round_dp("s", 2).alias("rms_std_db"),
            round_dp("p95 - p05", 2).alias("dynamic_range_db"),
        )
    )


def crest_factor(frames: DataFrame) -> DataFrame:
    """20*log10(peak / RMS) of a clip, from its sample frames."""
    d = frames.groupBy("clip_id").agg(
        F.expr("max(array_max(transform(xs, x -> abs(x))))").alias("peak"),
        F.sum(dot("xs", "xs")).alias("ss"), F.expr("sum(size(xs))").alias("n"),
    )
    return d.select("clip_id", round_dp("20D * log10((peak + 1e-9D) / (sqrt(ss / n) + 1e-9D))", 2).alias("crest_factor_db"))


def environment_profile(sframes: DataFrame) -> DataFrame:
    """Mean spectrogram dB, contrast, and mean and spread of the 95 % rolloff."""
    return sframes.groupBy("clip_id").agg(
        F.avg("mean_db").alias("noise_floor_db"),
        F.avg("contrast").alias("mean_spectral_contrast"),
        F.avg("rolloff95").alias("rolloff_mean"),
        F.stddev_pop("rolloff95").alias("rolloff_std"),
    )


def pool_vectors(df: DataFrame, v: str, size: int) -> DataFrame:
    """Mean of the window vectors, then L2 normalised."""
    d = df.groupBy("clip_id").agg(mean_vector(v, size).alias("_m"))
    return d.select("clip_id", l2_normalise("_m").alias("embedding"))


# values a clip gets where its profile could not be computed
PROFILE_DEFAULTS = {
    "spectral_centroid_mean": 0.0,
    "spectral_bandwidth_mean": 0.0,
    "spectral_rolloff_mean": 0.0,
    "spectral_contrast_mean": 0.0,
    "rms_mean_db": -60.0,
    "rms_std_db": 0.0,
    "dynamic_range_db": 0.0,
    "crest_factor_db": 0.0,
    "mean_pitch": 0.0,
    "jitter": 0.0,
    "shimmer": 0.0,
    "noise_floor_db": -80.0,
    "mean_spectral_contrast": 0.0,
    "rolloff_mean": 0.0,
    "rolloff_std": 0.0,
}


def with_profile_defaults(profiles: DataFrame) -> DataFrame:
    """Fill missing scalars, and missing MFCC vectors with zeros."""
    out = profiles.fillna({k: v for k, v in PROFILE_DEFAULTS.items() if k in profiles.columns})
    for c in ("mfcc_mean", "mfcc_var"):
        if c in out.columns:
            out = out.withColumn(c, F.coalesce(c, F.array_repeat(F.lit(0.0), K.N_MFCC)))
    return out
