"""Recordings to levelled speech: the shared first half of every analysis."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxledger import constants as K
from voxledger.functions.ordered import SEG, with_segments
from voxledger.operators import prepare as P
from voxledger.operators import windows as W
from voxledger.plans.store import written
from voxledger.sources import pcm, recordings

CLIP = ["clip_id"]


@dataclass
class Prepared:
    """``blocks``: levelled speech in blocks of ``pcm.BLOCK`` samples; ``frames``: the same as gate
    frames; ``clips``: one row per accepted clip; ``rejects``: clip and reason."""

    blocks: DataFrame
    frames: DataFrame
    clips: DataFrame
    rejects: DataFrame


def prepare(files: DataFrame, sr: int = K.SAMPLE_RATE, max_seconds: int | None = None) -> Prepared:
    """Decode, downmix, gate, level.  ``files`` as from ``scan_recordings``.

    Clips are taken whole; ``max_seconds`` (120 gives the results of the service
    whose results are matched) cuts them, which the step log then says.

    The decoded blocks and the levelled frames are written to the shared folder:
    both are read by several later steps.
    """
    bad_files = files.where("reject_reason IS NOT NULL").select("clip_id", F.col("reject_reason").alias("reason"))
    good = recordings.accepted(files)
    raw = written(pcm.mono_blocks(good, max_seconds=max_seconds), "pcm")
    wrong_rate = F.when(F.col("sr") != sr, F.concat(F.lit("sample_rate_"), F.col("sr").cast("string")))
    raw = raw.withColumn("error", F.coalesce("error", wrong_rate))
    bad_decode = raw.where("error IS NOT NULL").select("clip_id", F.col("error").alias("reason")).distinct()

    mono = raw.where("error IS NULL").drop("error")
    mono = with_segments(mono, CLIP, "start", step=K.GATE_FRAME)
    peak = "max(array_max(transform(xs, x -> abs(x))))"
    lengths = mono.groupBy("clip_id").agg(
        F.max("n_clip").alias("raw_samples"), F.max("channels").alias("channels"), F.expr(peak).alias("peak")
    )
    gated = P.gate(P.frames_from_blocks(mono))
    frames = written(P.normalise_rms(P.resequence(gated)), "speech")

    state = frames.groupBy("clip_id").agg(
        *[
            F.max(c).alias(c)
            for c in ("tier", "reject_reason", "speech_samples", "source_rms", "n_frames", "n_active", "std_db", "noise_floor_db")
        ],
    )
    state = lengths.join(state, "clip_id").withColumn("error", F.lit(None).cast("string"))
    ok, bad_clips = P.split_rejects(state, sr)
    clips = ok.select(
        "clip_id", "speech_samples", (F.col("speech_samples") / F.lit(float(sr))).alias("speech_sec"),
        recordings.custody_durations(F.col("raw_samples"), F.col("speech_samples"), sr).alias("custody"),
        P.step_log(sr, max_seconds).alias("steps"),
    )
    kept = frames.where("reject_reason IS NULL AND n > 0").join(clips.select("clip_id"), "clip_id", "left_semi")
    kept = kept.select("clip_id", "frame_id", "pos", "n", "xs", SEG)
    return Prepared(
        blocks=W.to_blocks(kept, pcm.BLOCK),
        frames=kept,
        clips=clips,
        rejects=bad_files.unionByName(bad_decode).unionByName(bad_clips),
    )
