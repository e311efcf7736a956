"""Per-window indicators: vocoder, spectral continuity and prosody.

Frame tables are keyed by ``(clip_id, window_id, frame_id)``; a window holds a
fixed number of frames, so windows are grouped plainly.  Only the comparisons
between windows of one clip go through the segmented operations.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxledger import constants as K
from voxledger.functions.numbers import clip, fixed, present, round_dp
from voxledger.functions.ordered import SEG, attach, ordered, seg_of, with_segments
from voxledger.functions.vectors import euclid, mean_vector, total

CLIP = ["clip_id"]
WINDOW = ["clip_id", "window_id"]


# --- vocoder ----------------------------------------------------------------
def hf_first_bin(n_fft: int = 1024, sr: int = K.SAMPLE_RATE, hz: float = K.HF_BAND_HZ) -> int:
    """First bin strictly above ``hz``."""
    return int(hz * n_fft // sr) + 1


def median_of(values: Column) -> Column:
    """Middle of a fixed-size array."""
    s = F.array_sort(values)
    n = F.size(values)
    return (F.get(s, F.floor((n - 1) / 2).cast("int")) + F.get(s, F.floor(n / 2).cast("int"))) / F.lit(2.0)


def band_stats(spectra: DataFrame, first_bin: int) -> DataFrame:
    """Frame scalars from magnitude arrays: high band mean and mean step, largest and middle magnitude.

    ``first_bin`` (0-based) starts the high band.  The Arrow feature job yields
    the same columns without shipping the arrays.
    """
    band = F.slice("mag", F.lit(first_bin + 1), F.size("mag"))
    steps = F.zip_with(F.slice("_band", F.lit(2), F.size("_band")), F.slice("_band", F.lit(1), F.size("_band") - 1), lambda a, b: F.abs(a - b))
    return (
        spectra.withColumn("_band", band)
        .withColumns(
            {
                "hf_step": total(steps) / (F.size("_band") - 1),
                "hf_mean": total("_band") / F.size("_band"),
                "mag_max": F.array_max("mag"),
                "mag_median": median_of(F.col("mag")),
            }
        )
        .drop("_band")
    )


def hf_ripple(stats: DataFrame) -> DataFrame:
    """Mean absolute step along frequency over mean magnitude, above the band edge."""
    return stats.groupBy(*WINDOW).agg(F.expr("avg(hf_step) / (avg(hf_mean) + 1e-6D)").alias("hf_ripple"))


def ripple_score(ripple: Column) -> Column:
    return clip((ripple - F.lit(0.30)) / F.lit(0.55) * F.lit(100.0), 0, 100)


def peak_to_median_db(stats: DataFrame, min_voiced: int = 5) -> DataFrame:
    """10*log10(mean of frame maxima / mean of frame medians) over voiced frames; 20 with too few."""
    db = "10D * log10(avg(mag_max) FILTER (WHERE voiced) / (avg(mag_median) FILTER (WHERE voiced) + 1e-8D))"
    return stats.groupBy(*WINDOW).agg(F.expr(f"if(count_if(voiced) > {min_voiced}, {db}, 20D)").alias("hnr_db"))


def hnr_score(db: Column) -> Column:
    return F.when((db < 8.0) | (db > 33.0), 70.0).when((db < 12.0) | (db > 28.0), 30.0).otherwise(5.0)


def phase_variance(spectra: DataFrame) -> DataFrame:
    """Population variance of the frame-to-frame phase differences of a window."""
    w = Window.partitionBy(*WINDOW).orderBy("frame_id")  # frames of one window
    d = spectra.select(*WINDOW, "phase", F.lag("phase").over(w).alias("_before")).where("_before IS NOT NULL")
    diff = F.zip_with("phase", "_before", lambda a, b: a - b)
    add = lambda s, x: s + x
    sq = F.transform("_d", lambda x: x * x)
    mean = F.sum(F.aggregate("_d", F.lit(0.0), add)) / F.sum(F.size("_d"))
    return (
        d.withColumn("_d", diff)
        .groupBy(*WINDOW)
        .agg((F.sum(F.aggregate(sq, F.lit(0.0), add)) / F.sum(F.size("_d")) - mean * mean).alias("phase_var"))
    )


def phase_score(var: Column) -> Column:
    return F.when((var < 0.5) | (var > 3.8), 65.0).when((var < 0.75) | (var > 2.8), 25.0).otherwise(5.0)


def vocoder_score(ripple: Column, hnr: Column, phase: Column) -> Column:
    """Weighted score; 25 where an input is missing."""
    s = F.lit(0.45) * ripple_score(ripple) + F.lit(0.30) * hnr_score(hnr) + F.lit(0.25) * phase_score(phase)
    ok = ripple.isNotNull() & hnr.isNotNull() & phase.isNotNull()
    return F.when(ok, clip(round_dp(s, 1), 2.0, 98.0)).otherwise(25.0)


def vocoder_checks(ripple: Column, hnr: Column, phase: Column) -> list[Column]:
    return [
        F.when(ripple_score(ripple) > 55, K.CHECKS["ripple"]),
        F.when(hnr_score(hnr) > 55, K.CHECKS["hnr"]),
        F.when(phase_score(phase) > 55, K.CHECKS["phase"]),
    ]


# --- spectral continuity ------------------------------------------------------
def window_spectral(frames: DataFrame, n_mfcc: int = K.N_MFCC) -> DataFrame:
    """Per window: mean MFCC, mean centroid, and RMS of its quiet frames."""
    w = Window.partitionBy(*WINDOW)  # frames of one window
    d = frames.withColumn("_q", F.percentile("rms", F.lit(0.2)).over(w))
    quiet = F.avg(F.when(F.col("rms") < F.col("_q"), F.col("rms")))
    seg = [seg_of(frames)] if SEG in frames.columns else []
    return d.groupBy(*WINDOW).agg(
        mean_vector("mfcc", n_mfcc).alias("mfcc_mean"),
        F.avg("centroid").alias("centroid_mean"),
        F.coalesce(quiet, F.avg("rms")).alias("quiet_rms"),
        *seg,
    )


def mfcc_baseline(frames: DataFrame, n_mfcc: int = K.N_MFCC, chunk: int = 93, hop: int = 31) -> DataFrame:
    """Clip mean and spread of the distance between consecutive chunk means; (30, 10) below two chunks.

    Chunks start every ``hop`` frames before ``max(1, T - chunk)``.
    """
    d = ordered(
        with_segments(frames, CLIP, "frame_id"), CLIP, ["frame_id"], totals={"_t": ("sum", F.lit(1))}
    )
    last = F.floor((F.greatest(F.lit(1), F.col("_t") - chunk) - 1) / hop)
    lo = F.greatest(F.lit(0), F.ceil((F.col("frame_id") - (chunk - 1)) / hop))
    hi = F.least(F.floor(F.col("frame_id") / hop), last)
    chunks = (
        d.where(lo <= hi)
        .withColumn("chunk_id", F.explode(F.sequence(lo, hi)))
        .groupBy("clip_id", "chunk_id")
        .agg(mean_vector("mfcc", n_mfcc).alias("m"), seg_of(d))
    )
    steps = ordered(chunks, CLIP, ["chunk_id"], previous={"_pm": "m"}).withColumn("dist", euclid("m", "_pm"))
    n = F.count("dist")
    return steps.groupBy("clip_id").agg(
        F.when(n >= 1, F.avg("dist")).otherwise(30.0).alias("mu"),
        F.when(n >= 1, F.stddev_pop("dist") + F.lit(1e-6)).otherwise(10.0).alias("sigma"),
        seg_of(d, F.max),
    )


def cross_window(windows: DataFrame) -> DataFrame:
    """Distance to the previous window's mean MFCC, and its quiet RMS."""
    d = with_segments(windows, CLIP, "window_id")
    d = ordered(d, CLIP, ["window_id"], previous={"_pm": "mfcc_mean", "prev_quiet_rms": "quiet_rms"})
    return d.withColumn("mfcc_dist", euclid("mfcc_mean", "_pm")).drop("_pm")


def jump_score(dist: Column, mu: Column, sigma: Column, sigmas: float = K.BOUNDARY_SIGMAS) -> tuple[Column, Column, Column]:
    """(score, boundary flag, threshold); the first window of a clip scores 0."""
    thr = mu + F.lit(sigmas) * sigma
    score = (
        F.when(dist.isNull(), 0.0)
        .when(dist > thr, F.least(F.lit(100.0), F.lit(60.0) + (dist - thr) / (F.lit(2.0) * sigma) * F.lit(40.0)))
        .when(dist > mu, F.least(F.lit(45.0), F.lit(10.0) + (dist - mu) / (thr - mu) * F.lit(35.0)))
        .otherwise(5.0)
    )
    return score, F.coalesce(dist > thr, F.lit(False)), thr


def room_change(quiet: Column, prev: Column, dist: Column, thr: Column) -> Column:
    """Noise floor jump between audible windows, together with a spectral jump."""
    audible = (quiet > 0.003) & (prev > 0.003)
    change = F.abs(quiet - prev) / (prev + F.lit(1e-8))
    return F.coalesce(audible & (change > 0.65) & (dist > thr * F.lit(0.8)), F.lit(False))


def spectral_indicator(windows: DataFrame, baseline: DataFrame, boundary_mode: str = "detected") -> DataFrame:
    """Spectral score, boundary flag and checks per window.

    ``boundary_mode="suppressed"`` reports no boundary, as the service this is
    compatible with does.
    """
    return spectral_scores(attach(cross_window(windows), baseline, CLIP), boundary_mode)


def spectral_scores(d: DataFrame, boundary_mode: str = "detected") -> DataFrame:
    """The same from ``mfcc_dist``, ``quiet_rms``, ``prev_quiet_rms`` and the baseline in each row, batch or stream."""
    score, boundary, thr = jump_score(F.col("mfcc_dist"), F.col("mu"), F.col("sigma"))
    d = d.withColumn("_thr", thr).withColumn("_jump", score).withColumn("_b", boundary)
    room = room_change(F.col("quiet_rms"), F.col("prev_quiet_rms"), F.col("mfcc_dist"), F.col("_thr"))
    d = d.withColumn("room_change", room)
    raised = F.when(F.col("room_change"), F.least(F.lit(100.0), F.col("_jump") + F.lit(25.0))).otherwise(F.col("_jump"))
    jump = F.when(
        F.col("_b"),
        F.concat(
            F.lit("Spectral Boundary Jump (Δ"), fixed("mfcc_dist", 1), F.lit(" > "), fixed("_thr", 1), F.lit(")")
        ),
    )
    return (
        d.withColumn("raw_score", clip(raised, 2.0, 98.0))
        .withColumn("spectral_score", round_dp("raw_score", 1))
        .withColumn("boundary_detected", F.col("_b") if boundary_mode == "detected" else F.lit(False))
        .withColumn("spectral_checks", present(jump, F.when(F.col("room_change"), K.CHECKS["room"])))
        .drop("_thr", "_jump", "_b")
    )


# --- prosody ------------------------------------------------------------------
def binned_entropy(voiced: DataFrame, by: list[str], x: str = "f0", max_bins: int = 15) -> DataFrame:
    """Entropy in bits of an equal-width histogram per bounded group; also the count ``n``.

    ``min(max_bins, n div 2 + 1)`` bins over [min, max], the last one closed; a
    constant group has entropy 0.
    """
    w = Window.partitionBy(*by)
    d = voiced.select(
        *by, F.col(x).alias("_x"), F.min(x).over(w).alias("_lo"), F.max(x).over(w).alias("_hi"),
        F.count(x).over(w).alias("n"),
    )
    bins = F.least(F.lit(max_bins), F.floor(F.col("n") / 2) + 1)
    rel = (F.col("_x") - F.col("_lo")) / F.nullif(F.col("_hi") - F.col("_lo"), F.lit(0.0))
    at = F.coalesce(F.least(F.floor(rel * bins), bins - 1), F.lit(0))
    p = F.col("c") / F.col("n")
    return (
        d.groupBy(*by, "n", at.alias("_bin"))
        .agg(F.count(F.lit(1)).alias("c"))
        .groupBy(*by)
        .agg(F.max("n").alias("n"), (-F.sum(p * F.log2(p)) + F.lit(0.0)).alias("entropy"))
    )


def micro_jitter(voiced: DataFrame, by: list[str], order: str = "frame_id", x: str = "f0") -> DataFrame:
    """Mean absolute step between consecutive voiced values over the mean, in percent."""
    w = Window.partitionBy(*by).orderBy(order)
    d = voiced.withColumn("_d", F.abs(F.col(x) - F.lag(x).over(w)))
    return d.groupBy(*by).agg(
        F.count(x).alias("n"),
        (F.avg("_d") / F.greatest(F.avg(x), F.lit(1.0)) * F.lit(100.0)).alias("jitter"),
        F.stddev_pop(x).alias("pitch_std"),
    )


def pitch_indicator(pframes: DataFrame, min_voiced: int = 8) -> DataFrame:
    """Entropy, jitter and spread per window, with neutral values for few voiced frames."""
    voiced = pframes.where("voiced AND f0 > 0")
    e, j = binned_entropy(voiced, WINDOW), micro_jitter(voiced, WINDOW).drop("n")
    enough = F.col("n") > min_voiced
    all_windows = pframes.select(*WINDOW).distinct()
    return all_windows.join(e.join(j, WINDOW), WINDOW, "left").select(
        *WINDOW,
        F.when(enough, F.col("entropy")).otherwise(2.8).alias("pitch_entropy"),
        F.when(enough, F.col("jitter")).otherwise(1.0).alias("micro_jitter"),
        F.when(enough, F.col("pitch_std")).otherwise(10.0).alias("pitch_std"),
    )


def energy_cv(frames: DataFrame, by: list[str] = WINDOW) -> DataFrame:
    return frames.groupBy(*by).agg((F.stddev_pop("rms") / (F.avg("rms") + F.lit(1e-8))).alias("energy_cv"))


def entropy_score(e: Column) -> Column:
    return F.when(e < 1.2, 90.0).when(e < 1.8, 70.0).when(e < 2.3, 30.0).otherwise(10.0)


def jitter_score(j: Column) -> Column:
    return F.when(j > 3.8, 80.0).when(j < 0.25, 75.0).when(j < 0.60, 40.0).otherwise(10.0)


def energy_score(cv: Column) -> Column:
    return F.when(cv < 0.25, 65.0).when(cv < 0.40, 30.0).otherwise(10.0)


def prosody_score(entropy: Column, jitter: Column, cv: Column) -> Column:
    """Weighted score; 25 where an input is missing."""
    s = entropy_score(entropy) * F.lit(0.50) + jitter_score(jitter) * F.lit(0.35) + energy_score(cv) * F.lit(0.15)
    ok = entropy.isNotNull() & jitter.isNotNull() & cv.isNotNull()
    return F.when(ok, clip(round_dp(s, 1), 2.0, 98.0)).otherwise(25.0)


def prosody_checks(entropy: Column, jitter: Column, cv: Column) -> list[Column]:
    return [
        F.when(entropy < 1.2, K.CHECKS["entropy_severe"]).when(entropy < 1.8, K.CHECKS["entropy_low"]),
        F.when(jitter > 3.8, K.CHECKS["jitter_high"]).when(jitter < 0.25, K.CHECKS["jitter_low"]),
        F.when(cv < 0.25, K.CHECKS["energy"]),
    ]


def fallback_scores(windows: DataFrame) -> DataFrame:
    """Scores a window gets where an indicator failed."""
    return windows.fillna({"vocoder_score": 25.0, "spectral_score": 15.0, "prosody_score": 25.0})


