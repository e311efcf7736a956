"""Are two recordings the same speaker?"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxledger import constants as K
from voxledger.functions.numbers import round_dp
from voxledger.functions import vectors as V
from voxledger.operators import compare as C
from voxledger.operators import frames as FR
from voxledger.operators import profiles as R
from voxledger.operators import windows as W
from voxledger.plans.prepare import Prepared
from voxledger.plans.store import written
from voxledger.sources.pcm import BLOCK


def clip_profiles(prep: Prepared, features: DataFrame) -> DataFrame:
    """One row per clip: structs ``pitch, formants, rhythm`` and the flat spectral and environment fields.

    ``features`` are the clip-wide frames; pitch frames are computed once per
    hop and shared.
    """
    context = written(FR.with_context(prep.blocks, 2048), "context")
    pitch = written(FR.pitch_frames(context, BLOCK), "pitch")
    voiced400 = FR.pitch_frames(context, BLOCK, hop=400)
    ff = FR.formant_frames(W.frames_in_blocks(prep.blocks, 800, 400), voiced400)
    legacy = FR.pitch_frames(context, BLOCK, hop=512, fmin=50.0).withColumnRenamed("f0_any", "pitch")
    masked = R.with_speech_mask(features)
    onsets = FR.onsets(FR.onset_envelope(features))
    durations = prep.clips.select("clip_id", F.col("speech_sec").alias("duration_sec"))
    even = features.where("frame_id % 2 = 0").withColumn("frame_id", F.expr("CAST(frame_id / 2 AS BIGINT)"))
    shimmer = FR.onset_envelope(even.drop("onset").withColumnRenamed("onset2", "onset"), shift=FR.N_FFT // 1024)

    def packed(df: DataFrame, name: str) -> DataFrame:
        return df.select("clip_id", F.struct(*[c for c in df.columns if c != "clip_id"]).alias(name))

    mfcc = R.vector_stats(features, "mfcc", K.N_MFCC)
    parts = [
        packed(R.pitch_profile(pitch), "pitch"),
        packed(R.formant_profile(ff), "formants"),
        packed(R.rhythm_profile(masked, onsets, durations), "rhythm"),
        mfcc,
        R.spectral_means(features),
        R.energy_dynamics(features),
        R.crest_factor(prep.frames),
        R.relative_variation(legacy, "pitch", "frame_id", "jitter").select("clip_id", round_dp("mean_pitch", 2).alias("mean_pitch"), round_dp("jitter", 3).alias("jitter")),
        R.relative_variation(shimmer, "o", "frame_id", "shimmer").select("clip_id", round_dp("shimmer", 3).alias("shimmer")),
        R.environment_profile(even),
    ]
    out = prep.clips.select("clip_id")
    for part in parts:
        out = out.join(part, "clip_id", "left")
    return R.with_profile_defaults(out)


def compare_pairs(
    pairs: DataFrame, profiles: DataFrame, risks: DataFrame, first: DataFrame | None = None, second: DataFrame | None = None
) -> DataFrame:
    """Fused result per pair ``(pair_id, a_id, b_id)``.

    ``risks``: ``clip_id, composite`` from the scan.  ``first``, ``second``:
    ``clip_id, embedding`` tables; a missing first embedding is left out of the
    fusion, a missing second one counts as 0.  A clip without a profile has no
    speech and cannot be compared.
    """
    d = pairs
    for side, c in (("a", "a_id"), ("b", "b_id")):
        body = F.struct(*[x for x in profiles.columns if x != "clip_id"])
        d = d.join(profiles.select(F.col("clip_id").alias(c), body.alias(side)), c, "left")
        d = d.join(risks.select(F.col("clip_id").alias(c), F.col("composite").alias(f"risk_{side}")), c, "left")
    for name, emb in (("first_neural", first), ("second_neural", second)):
        if emb is None:
            d = d.withColumn(name, F.lit(None).cast("double"))
            continue
        for side, c in (("a", "a_id"), ("b", "b_id")):
            d = d.join(emb.select(F.col("clip_id").alias(c), F.col("embedding").alias(f"_e{side}")), c, "left")
        d = d.withColumn(name, V.cosine_pct("_ea", "_eb")).drop("_ea", "_eb")

    def group(score, text, reason, name: str, default: str):
        sub = d.select("pair_id", F.col(f"a.{name}").alias("a"), F.col(f"b.{name}").alias("b"))
        return sub.select("pair_id", score().alias(name), text().alias(f"{name}_text"), reason(default).alias(f"{name}_reason"))

    d = written(d, "pairs")  # read once per feature group below
    out = C.with_spectral_text(d.withColumn("spectral_mfcc", C.spectral_score()), "spectral_mfcc").select(
        "pair_id", "a_id", "b_id", "first_neural", F.coalesce("second_neural", F.lit(0.0)).alias("second_neural"),
        "spectral_mfcc", F.col("text").alias("spectral_text"), C.environment_score().alias("energy"), *C.spectral_deltas(),
        F.coalesce("risk_a", F.lit(0.0)).alias("risk1"), F.coalesce("risk_b", F.lit(0.0)).alias("risk2"),
        F.col("a").isNull().alias("no_speech_1"), F.col("b").isNull().alias("no_speech_2"),
    )
    out = (
        out.join(group(C.pitch_score, C.pitch_text, C.missing_reason, "pitch", "Pitch unavailable in one or both samples"), "pair_id")
        .join(group(C.formant_score, C.formant_text, C.missing_reason, "formants", "Formant analysis unavailable in one or both samples"), "pair_id")
        .join(group(C.rhythm_score, C.rhythm_text, C.missing_reason, "rhythm", "Rhythm analysis unavailable"), "pair_id")
    )
    return C.fuse(out)
