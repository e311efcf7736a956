"""Ground-truth splices: overwrite part of a host clip with a levelled donor."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxledger.functions.ordered import SEG, ordered, with_segments


def splice_insert(
    samples: DataFrame, pairs: DataFrame, start: int, end: int, min_len: int, peak: float = 0.85
) -> DataFrame:
    """Host samples with ``[start, end)`` replaced by the donor's first samples.

    ``pairs``: ``clip_id`` (new), ``host_id, donor_id``.  The donor is scaled to
    the host's RMS in the replaced stretch, the host is zero-padded to
    ``min_len``, and the result is peak-normalised.  Joins run on
    ``(clip, seq)``; the levels come from sums over the stretch only.
    """
    span = end - start
    side = samples.select("clip_id", "seq", "x")
    spots = pairs.select("clip_id", "host_id", "donor_id")
    lengths = samples.groupBy("clip_id").agg((F.max("seq") + 1).alias("n"))
    # output positions the host does not cover are zero
    host = spots.join(side.withColumnsRenamed({"clip_id": "host_id", "x": "hx"}), "host_id").select("clip_id", "seq", "hx")
    padding = (
        spots.join(lengths.withColumnRenamed("clip_id", "host_id"), "host_id")
        .where(F.col("n") < min_len)
        .select("clip_id", F.explode(F.sequence(F.col("n"), F.lit(min_len - 1).cast("long"))).alias("seq"), F.lit(0.0).alias("hx"))
    )
    full = host.unionByName(padding)
    donor = (
        spots.join(side.withColumnsRenamed({"clip_id": "donor_id", "x": "dx"}), "donor_id")
        .where(F.col("seq") < span)
        .select("clip_id", (F.col("seq") + start).alias("seq"), "dx")
    )
    rms = lambda c: F.sqrt(F.sum(c * c) / F.lit(float(span)) + F.lit(1e-6))
    inside = (F.col("seq") >= start) & (F.col("seq") < end)
    host_rms = full.where(inside).groupBy("clip_id").agg(rms(F.col("hx")).alias("host_rms"))
    donor_rms = donor.groupBy("clip_id").agg(rms(F.col("dx")).alias("donor_rms"))
    scale = host_rms.join(donor_rms, "clip_id", "left").select(
        "clip_id", (F.col("host_rms") / F.coalesce("donor_rms", F.lit(1e-3))).alias("gain")
    )
    levelled = donor.join(scale, "clip_id").select("clip_id", "seq", (F.col("dx") * F.col("gain")).alias("dx"))
    mixed = full.join(levelled, ["clip_id", "seq"], "left").select(
        "clip_id", "seq",
        F.when(inside, F.coalesce("dx", F.lit(0.0))).otherwise(F.col("hx")).alias("x"),
    )
    d = ordered(
        with_segments(mixed, ["clip_id"], "seq"), ["clip_id"], ["seq"], totals={"_top": ("max", F.abs(F.col("x")))}
    )
    out = F.when(F.col("_top") > 0, F.col("x") / F.nullif(F.col("_top"), F.lit(0.0)) * F.lit(peak)).otherwise(F.col("x"))
    return d.select("clip_id", "seq", out.alias("x"), SEG)


def truth_intervals(pairs: DataFrame, t_start: float = 1.5, t_end: float = 3.0) -> DataFrame:
    return pairs.select(
        "clip_id", "host_id", "donor_id", F.lit(t_start).alias("t_start"), F.lit(t_end).alias("t_end"),
        F.lit(t_end - t_start).alias("duration_sec"),
    )
