"""Cutting clips into overlapping windows and frames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxledger import constants as K
from voxledger.functions.numbers import round_dp
from voxledger.functions.ordered import SEG, ordered, seg_of, with_segments

CLIP = ["clip_id"]


def window_count(n, win: int, hop: int):
    """Full windows only; a shorter clip is one window."""
    return F.greatest(F.lit(1), F.floor((n - win) / hop) + 1)


def sliding_windows(
    rows: DataFrame, order: str = "seq", win: int = K.WINDOW_SAMPLES, hop: int = K.WINDOW_HOP_SAMPLES
) -> DataFrame:
    """Assign each row, numbered 0.. in its clip, to every full window that holds it."""
    d = ordered(with_segments(rows, CLIP, order), CLIP, [order], totals={"_n": ("sum", F.lit(1))})
    lo = F.greatest(F.lit(0), F.ceil((F.col(order) - (win - 1)) / hop))
    hi = F.least(F.floor(F.col(order) / hop), window_count(F.col("_n"), win, hop) - 1)
    return d.where(lo <= hi).withColumn("window_id", F.explode(F.sequence(lo, hi))).drop("_n")


def window_bounds(window_id, n, win: int, hop: int, sr: int):
    """(start, end) seconds of a window, two decimals."""
    start = window_id * hop
    return (
        round_dp(start / F.lit(float(sr)), 2),
        round_dp(F.least(start + win, n) / F.lit(float(sr)), 2),
    )


def embedding_windows(
    clips: DataFrame,
    window: float = K.EMBED_WINDOW_SECONDS,
    stride: float = K.EMBED_STRIDE_SECONDS,
    single: float = K.EMBED_SINGLE_SECONDS,
    shortest: float = K.EMBED_MIN_SECONDS,
) -> DataFrame:
    """Windows of a clip of ``duration_sec``: one if short, else strided up to the one reaching the end."""
    dur = F.col("duration_sec")
    last = F.when(dur <= single, 0).otherwise(F.greatest(F.lit(0), F.ceil((dur - window) / stride)))
    d = clips.where(dur > 0).withColumn("window_id", F.explode(F.sequence(F.lit(0).cast("long"), last.cast("long"))))
    start = F.col("window_id") * F.lit(float(stride))
    end = F.when(dur <= single, dur).otherwise(F.least(start + F.lit(float(window)), dur))
    return d.withColumn("start_sec", start).withColumn("end_sec", end).where(
        (dur <= single) | (F.col("end_sec") - F.col("start_sec") >= shortest)
    )


def overlapping_frames(samples: DataFrame, n: int, hop: int) -> DataFrame:
    """Full frames of ``n`` samples every ``hop``, from sample rows; each frame is its own small group."""
    lo = F.greatest(F.lit(0), F.ceil((F.col("seq") - (n - 1)) / hop))
    hi = F.floor(F.col("seq") / hop)
    d = with_segments(samples, CLIP, "seq")
    return (
        d.where(lo <= hi)
        .withColumn("frame_id", F.explode(F.sequence(lo, hi)))
        .groupBy("clip_id", "frame_id")
        .agg(F.array_sort(F.collect_list(F.struct("seq", "x"))).alias("rows"), seg_of(d))
        .where(F.size("rows") == n)
        .select("clip_id", "frame_id", F.col("rows.x").alias("xs"), SEG)
    )


def to_blocks(frames: DataFrame, block_len: int) -> DataFrame:
    """Re-cut frame rows ``(clip_id, pos, n, xs)`` into blocks of ``block_len`` samples.

    A frame contributes a slice to each block it touches; a block is a bounded group.
    """
    ids = F.sequence(F.floor(F.col("pos") / block_len), F.floor((F.col("pos") + F.col("n") - 1) / block_len))
    lo = F.greatest(F.col("block_id") * block_len, F.col("pos"))
    hi = F.least((F.col("block_id") + 1) * block_len, F.col("pos") + F.col("n"))
    piece = F.slice("xs", (lo - F.col("pos") + 1).cast("int"), (hi - lo).cast("int"))
    return (
        frames.where(F.col("n") > 0)
        .select("clip_id", SEG, "pos", "n", "xs", F.explode(ids).alias("block_id"))
        .select("clip_id", SEG, "block_id", lo.alias("at"), piece.alias("piece"))
        .groupBy("clip_id", "block_id")
        .agg(F.array_sort(F.collect_list(F.struct("at", "piece"))).alias("pieces"), seg_of(frames))
        .select(
            "clip_id", "block_id", (F.col("block_id") * block_len).alias("start"),
            F.flatten("pieces.piece").alias("xs"), SEG,
        )
    )


def with_halo(blocks: DataFrame, halo: int) -> DataFrame:
    """Append the next block's first ``halo`` samples to each block; keyed by block, so never skewed."""
    own = blocks.select("clip_id", "block_id", "start", F.col("xs").alias("own"), F.lit(None).cast("array<double>").alias("head"), SEG)
    head = blocks.where(F.col("block_id") > 0).select(
        "clip_id", (F.col("block_id") - 1).alias("block_id"), F.lit(None).cast("long").alias("start"),
        F.lit(None).cast("array<double>").alias("own"), F.slice("xs", 1, halo).alias("head"), F.lit(None).cast("int").alias(SEG),
    )
    d = own.unionByName(head).groupBy("clip_id", "block_id").agg(
        F.max("start").alias("start"), F.first("own", True).alias("own"), F.first("head", True).alias("head"), seg_of(blocks, F.max)
    )
    return d.where("own IS NOT NULL").select(
        "clip_id", "block_id", "start", F.size("own").alias("n_own"),
        F.concat("own", F.coalesce("head", F.array().cast("array<double>"))).alias("xs"), SEG,
    )


def frames_in_blocks(blocks: DataFrame, n: int, hop: int) -> DataFrame:
    """Full overlapping frames from blocks: halo once, then slices inside each row."""
    first = F.ceil(F.col("start") / hop)
    last = F.least(
        F.floor((F.col("start") + F.col("n_own") - 1) / hop), F.floor((F.col("start") + F.size("xs") - n) / hop)
    )
    return (
        with_halo(blocks, n - 1)
        .where(first <= last)
        .withColumn("frame_id", F.explode(F.sequence(first, last)))
        .select(
            "clip_id", "frame_id", F.slice("xs", (F.col("frame_id") * hop - F.col("start") + 1).cast("int"), F.lit(n)).alias("xs"), SEG
        )
    )


def window_blocks(blocks: DataFrame, total: str = "n_clip", win: int = K.WINDOW_SAMPLES, hop: int = K.WINDOW_HOP_SAMPLES) -> DataFrame:
    """Scan windows as rows of ``win`` samples, from blocks of exactly ``hop`` samples.

    ``win`` is a multiple of ``hop``: a block is sent to the windows it belongs
    to and a window gathers win/hop blocks.
    """
    per = win // hop
    count = window_count(F.col(total), win, hop)
    lo = F.greatest(F.lit(0), F.col("block_id") - (per - 1))
    hi = F.least(F.col("block_id"), count - 1)
    return (
        blocks.where(lo <= hi)
        .withColumn("window_id", F.explode(F.sequence(lo, hi)))
        .groupBy("clip_id", "window_id")
        .agg(
            F.array_sort(F.collect_list(F.struct("block_id", "xs"))).alias("pieces"),
            F.max(total).alias(total),
            seg_of(blocks),
        )
        .select("clip_id", "window_id", F.flatten("pieces.xs").alias("xs"), total, SEG)
    )
