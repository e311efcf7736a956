"""Sharding by a two-pass external shuffle (law "rows").

Pass one scatters the rows by a seeded hash into buckets that fit in memory.
Pass two shuffles each bucket with Spark's shuffle(), which is a Fisher-Yates
shuffle, and deals the rows out in the order of bucket and place in it: global
position p goes to shard p mod n at slot p div n.  Row counts of the shards
differ by one at most and slots have no gaps.

Only bucket counts are summed in one task.  Rows that are equal in all columns
are counted before they are scattered, and their copies are numbered, so a row
that fills a third of the table spreads over all buckets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxledger.llm.work import packed, scratch, stored, unpacked

#: Copies of one row that a task writes out at a time.
STRIDE = 4096


def _bytes(df: DataFrame) -> Column:
    """About the bytes of a row."""
    parts = [
        F.coalesce(F.octet_length(F.col(f"`{name}`")), F.lit(0)) if kind in ("string", "binary") else F.lit(0)
        for name, kind in df.dtypes
    ]
    return sum(parts, F.lit(32 + 8 * len(parts))).cast("long")


def shard_rows(df: DataFrame, shards: int = 16, *, seed: int = 17, bucket_bytes: int = 16 << 20) -> DataFrame:
    """Every row of df once, with shard (0 to shards - 1) and slot (from 0, no gaps, in shuffled order).

    Nulls, empty texts and repeated rows are ordinary rows; an empty table gives
    an empty result.  A column of df named shard or slot is replaced.
    """
    if shards < 1:
        raise ValueError("shards must be positive")
    spark = df.sparkSession
    row, keep = packed(df, ["shard", "slot"])
    total = df.agg(F.sum(_bytes(df))).first()[0] or 0
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // bucket_bytes))

    copies = df.select(row).groupBy("_row").agg(F.count(F.lit(1)).alias("_n"))
    each = copies.select(
        "_row", "_n", F.explode(F.sequence(F.lit(0), F.floor((F.col("_n") - 1) / STRIDE))).alias("_block")
    ).select(
        "_row",
        F.explode(
            F.sequence(F.col("_block") * STRIDE, F.least(F.col("_n"), (F.col("_block") + 1) * STRIDE) - 1)
        ).alias("_copy"),
    )
    key = F.xxhash64(F.lit(seed), "_row", "_copy")
    scattered = each.select("_row", key.alias("_key")).withColumn("_bucket", F.pmod("_key", F.lit(buckets)))

    counts = scattered.groupBy("_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    start = counts.select("_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))

    # sorted first, so that the shuffle starts from the same order when a lost task runs again
    filled = (
        scattered.repartition(buckets, "_bucket")
        .groupBy("_bucket")
        .agg(F.sort_array(F.collect_list(F.struct("_key", "_row"))).alias("_rows"))
        .sortWithinPartitions("_bucket")
        .select("_bucket", F.shuffle("_rows", F.lit(seed)).alias("_rows"))
    )
    place = F.col("_start") + F.col("_place")
    return (
        filled.join(start, "_bucket")
        .select("_start", F.posexplode("_rows").alias("_place", "_item"))
        .select(
            F.col("_item._row").alias("_row"),
            F.pmod(place, F.lit(shards)).cast("int").alias("shard"),
            F.floor(place / shards).cast("long").alias("slot"),
        )
        .select(*unpacked(keep), "shard", "slot")
    )


def document_shards(docs: DataFrame, shards: int = 16) -> DataFrame:
    """Digest of the sharding of documents: size, checksum and place.

    Whole rows are sharded and written to the shared folder; the digest is taken
    from what was written.  A null text has size 1 and, like an empty one, checksum 0.
    """
    written = stored(shard_rows(docs, shards), scratch(docs.sparkSession), compression="zstd")
    text = F.coalesce(F.col("text"), F.lit(""))
    return written.select(
        "doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"),
        F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"),
    )
