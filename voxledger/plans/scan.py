"""Is a recording synthetic or spliced, and where?"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxledger import constants as K
from voxledger.functions.numbers import present, round_dp
from voxledger.functions.ordered import SEG, ordered
from voxledger.operators import frames as FR
from voxledger.operators import indicators as I
from voxledger.operators import synthesis as S
from voxledger.operators import windows as W
from voxledger.plans.prepare import Prepared
from voxledger.plans.store import written
from voxledger.sources.pcm import BLOCK

CLIP = ["clip_id"]


@dataclass
class Scan:
    windows: DataFrame
    clips: DataFrame
    intervals: DataFrame


def scored_windows(prep: Prepared, boundary_mode: str = "detected", features: DataFrame | None = None) -> DataFrame:
    """Every scan window with its three scores and triggered checks.

    A window whose frames or indicators failed stays, with the fallback scores and the reason in ``error``.
    """
    blocks = ordered(prep.blocks, CLIP, ["block_id"], totals={"n_clip": ("sum", F.size("xs"))})
    cut = written(FR.window_frames(W.window_blocks(blocks)), "windows")
    start, end = W.window_bounds(F.col("window_id"), F.col("n_clip"), K.WINDOW_SAMPLES, K.WINDOW_HOP_SAMPLES, K.SAMPLE_RATE)
    base = cut.select(*I.WINDOW, SEG, "phase_var", "error", start.alias("start_time"), end.alias("end_time"))
    rows = cut.select(*I.WINDOW, SEG, F.inline("frames"))

    pitch = I.pitch_indicator(rows)
    scalars = (
        I.hf_ripple(rows)
        .join(I.peak_to_median_db(rows), I.WINDOW, "full_outer")
        .join(I.energy_cv(rows), I.WINDOW, "full_outer")
        .join(pitch, I.WINDOW, "full_outer")
    )
    baseline = I.mfcc_baseline(rows_of_clip(prep) if features is None else features)
    spectral = I.spectral_indicator(I.window_spectral(rows), baseline, boundary_mode)
    v = (F.col("hf_ripple"), F.col("hnr_db"), F.col("phase_var"))
    p = (F.col("pitch_entropy"), F.col("micro_jitter"), F.col("energy_cv"))
    found = F.coalesce("spectral_checks", F.array().cast("array<string>"))
    checks = F.concat(present(*I.vocoder_checks(*v)), found, present(*I.prosody_checks(*p)))
    d = base.join(scalars, I.WINDOW, "left").join(
        spectral.select(*I.WINDOW, "spectral_score", "boundary_detected", "spectral_checks", "mfcc_dist", "quiet_rms"), I.WINDOW, "left"
    )
    scored = d.select(
        *I.WINDOW, SEG, "start_time", "end_time", I.vocoder_score(*v).alias("vocoder_score"), "spectral_score",
        I.prosody_score(*p).alias("prosody_score"), F.coalesce("boundary_detected", F.lit(False)).alias("boundary_detected"),
        checks.alias("triggered_checks"), "error",
        F.struct(
            "hf_ripple", "hnr_db", "phase_var", "mfcc_dist", "quiet_rms", "pitch_entropy", "micro_jitter", "pitch_std", "energy_cv"
        ).alias("raw_metrics"),
    )
    return I.fallback_scores(scored)


def rows_of_clip(prep: Prepared) -> DataFrame:
    """Clip-wide feature frames (MFCC and spectral shape at hop 256)."""
    context = FR.with_context(prep.blocks, 2048)
    return FR.frame_features(context, FR.clip_levels(context, BLOCK), BLOCK)


def scan(prep: Prepared, scores: DataFrame | None = None, boundary_mode: str = "detected", features: DataFrame | None = None) -> Scan:
    """Verdict, intervals and scored windows per clip.

    ``scores``: ``clip_id, score`` of a user's model; the baseline applies where
    it has none.
    """
    windows = written(scored_windows(prep, boundary_mode, features), "scored")
    models = prep.clips.select("clip_id", round_dp("speech_sec", 2).alias("duration_sec"))
    if scores is None:
        models = models.withColumn("model", F.lit(50.0))
    else:
        models = FR.score_with(models, scores, CLIP)
    clips, intervals = S.synthesise(windows, models)
    return Scan(windows, clips, intervals)

