"""Mixing sources to target weights by systematic sampling.

Every document of a source is expected in the mix target / source_size times.
Documents are put in order of size, these expectations are summed up along the
order, one offset per source is added, and a document is emitted once for every
integer boundary that its interval crosses.  In order of size, each stretch of
documents of about one size gets its share, so the words taken miss the target
by about one document.

A place in the order is found in steps that no source can overload: documents
are numbered in segments of (source, size, hash range), of which there is one
for each SEGMENT_ROWS documents of the table at most, and segments and sizes are
summed from their counts.  Only light rows of counts are summed per source: one
for each size that occurs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxledger.llm.work import n_words, packed, unpacked

SEGMENT_ROWS = 50_000
CAP = 3
#: Weights of the sources in code point order, repeating.
WEIGHTS = (1, 2, 3)
SEED = "mix"


def _digest(key: Column) -> Column:
    return F.md5(F.concat(F.lit(f"{SEED}:"), F.coalesce(key.cast("string"), F.lit("null"))))


def source_targets(sizes: DataFrame, weights=WEIGHTS, cap: int = CAP) -> DataFrame:
    """Target words per source from (null_source, source, source_size): shares by weight, none above cap times its size.

    The excess of capped sources is shared again until none is above, which is
    one level L with target = min(cap * size, weight * L): sources are capped in
    order of size / weight, and L is read at the first that need not be.
    One row per source goes through one task.
    """
    by_name = Window.orderBy("null_source", "source")
    turn = F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights)))
    weight = F.element_at(F.array(*[F.lit(int(w)).cast("long") for w in weights]), turn + 1)
    everything = Window.partitionBy()
    by_need = Window.orderBy("_ratio", "null_source", "source").rowsBetween(Window.unboundedPreceding, -1)
    d = sizes.withColumn("weight", weight).withColumn("_ratio", F.col("source_size") * cap / F.col("weight"))
    d = d.select(
        "*",
        F.sum("source_size").over(everything).alias("_all"),
        F.sum("weight").over(everything).alias("_weights"),
        F.coalesce(F.sum(F.col("source_size") * cap).over(by_need), F.lit(0)).alias("_capped"),
        F.coalesce(F.sum("weight").over(by_need), F.lit(0)).alias("_done"),
    )
    level = (F.col("_all") - F.col("_capped")) / (F.col("_weights") - F.col("_done"))
    d = d.withColumn("_level", F.when(level <= F.col("_ratio"), F.struct("_ratio", "null_source", "source", level.alias("v"))))
    d = d.withColumn("_level", F.min("_level").over(everything))
    return d.select(
        "null_source", "source", "source_size",
        F.least(
            (F.col("source_size") * cap).cast("double"), F.col("weight") * F.col("_level.v")
        ).alias("target"),
    )


def _with_copies(docs: DataFrame, row: Column, weights, cap: int) -> DataFrame:
    """row with size, source_size, target and copies of its document."""
    segments = max(1, -(-docs.count() // SEGMENT_ROWS))
    source = F.col("source").cast("string")
    digest = _digest(F.col("doc_id"))
    share = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / float(1 << 32)
    base = docs.select(
        row,
        F.col("doc_id").alias("_id"),
        source.isNull().alias("null_source"),
        F.coalesce(source, F.lit("")).alias("source"),
        n_words(F.col("text")).alias("size"),
        digest.alias("_hash"),
        F.floor(share * segments).alias("_segment"),
        F.xxhash64(*[F.col(f"`{c}`") for c, kind in docs.dtypes if "map<" not in kind]).alias("_tie"),
    )
    group, piece = ["null_source", "source"], ["null_source", "source", "size", "_segment"]
    pieces = base.groupBy(*piece).agg(F.count(F.lit(1)).alias("_n"))
    by_size = pieces.groupBy(*group, "size").agg(F.sum("_n").alias("_n"))
    targets = source_targets(by_size.groupBy(*group).agg(F.sum(F.col("size") * F.col("_n")).alias("source_size")), weights, cap)

    earlier = lambda *by: Window.partitionBy(*by).rowsBetween(Window.unboundedPreceding, -1)
    smaller = by_size.select(
        *group, "size", F.coalesce(F.sum("_n").over(earlier(*group).orderBy("size")), F.lit(0)).alias("_smaller")
    )
    starts = (
        pieces.select(*piece, F.coalesce(F.sum("_n").over(earlier(*group, "size").orderBy("_segment")), F.lit(0)).alias("_ahead"))
        .join(smaller, [*group, "size"])
        .join(targets, group)
        .select(*piece, (F.col("_smaller") + F.col("_ahead")).alias("_start"), "source_size", "target")
    )
    number = F.row_number().over(Window.partitionBy(*piece).orderBy("_hash", "_id", "_tie"))
    numbered = base.withColumn("_number", number).join(starts, piece)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    name = F.when(~F.col("null_source"), F.col("source"))
    # a multiple of 1/1024, so that sums of whole rates stay exact
    offset = F.conv(F.substring(_digest(name), 1, 4), 16, 10).cast("long")
    offset = F.floor(offset / 64).cast("double") / 1024.0
    last = F.col("_start") + F.col("_number")
    copies = F.least(F.lit(cap).cast("long"), F.floor(last * rate + offset) - F.floor((last - 1) * rate + offset))
    return numbered.select("_row", "size", "source_size", "target", copies.alias("copies"))


def mix_copies(docs: DataFrame, weights=WEIGHTS, cap: int = CAP) -> DataFrame:
    """Every row of docs with size, source_size, target, copies (0 to cap) and taken = size * copies.

    A null text has size 0, a null source is a source of its own, ordered last.
    Documents of equal size and id come in order of a hash of the row.  Rows
    without words are emitted at the rate of their source.  A source without
    words has target 0 and gives nothing.  Columns of docs that bear the name of
    a result are replaced.
    """
    row, keep = packed(docs, ["size", "source_size", "target", "copies", "taken"])
    return _with_copies(docs, row, weights, cap).select(
        *unpacked(keep), "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken")
    )


def mixed(docs: DataFrame, weights=WEIGHTS, cap: int = CAP) -> DataFrame:
    """The mix itself: rows of docs as they are, each as many times as it was taken."""
    row, keep = packed(docs, [])
    d = _with_copies(docs, row, weights, cap).where(F.col("copies") > 0)
    each = F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))
    return d.select("_row", each.alias("_each")).select(*unpacked(keep))


#: DuckDB twin of mix_copies over documents.
SQL = r"""
WITH base AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         md5('mix:' || coalesce(doc_id::VARCHAR, 'null')) AS hash
  FROM documents
), sizes AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM base GROUP BY source
), weighted AS (
  SELECT source, source_size, ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::BIGINT AS weight FROM sizes
), ratios AS (
  SELECT *, (source_size * 3)::DOUBLE / weight AS ratio FROM weighted
), summed AS (
  SELECT *, (sum(source_size) OVER ())::BIGINT AS everything, (sum(weight) OVER ())::BIGINT AS weights,
         coalesce(sum(source_size * 3) OVER before, 0)::BIGINT AS capped, coalesce(sum(weight) OVER before, 0)::BIGINT AS done
  FROM ratios WINDOW before AS (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), levels AS (
  SELECT *, (everything - capped)::DOUBLE / (weights - done) AS level FROM summed
), targets AS (
  SELECT source, source_size,
         least((source_size * 3)::DOUBLE, weight * (SELECT level FROM levels WHERE level <= ratio ORDER BY ratio, source NULLS LAST LIMIT 1)) AS target,
         floor(('0x' || substr(md5('mix:' || coalesce(source, 'null')), 1, 4))::BIGINT / 64.0) / 1024.0 AS shift
  FROM levels
), ranked AS (
  SELECT doc_id, source, size, row_number() OVER (PARTITION BY source ORDER BY size, hash, doc_id) AS place FROM base
), rates AS (
  SELECT r.doc_id, r.size, t.source_size, t.target, place, shift,
         CASE WHEN t.source_size > 0 THEN target / t.source_size ELSE 0.0::DOUBLE END AS rate
  FROM ranked r JOIN targets t ON r.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target,
       (size * least(3, floor(place * rate + shift) - floor((place - 1) * rate + shift)))::BIGINT AS taken
FROM rates
"""
