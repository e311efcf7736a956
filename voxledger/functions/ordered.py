"""Ordered operations per group that survive a group holding much of the table.

A plain ``Window.partitionBy(clip)`` sends one whole clip to one task.  Here a
table carries a ``seg`` column that cuts each group along its order, and windows
run over ``(group, seg)``.  What a piece needs from the pieces before it is one
summary row per piece, found by equi-join on ``(group, seg)``.  There is one plan
for groups of any size, and nothing runs while it is built.

Numbered rows (frames, blocks, samples) are cut by position: ``seg`` is the number
divided by a constant width.  Rows ordered by a value (scores, times) are cut at
quantiles of their group, which one aggregate finds, so pieces hold about equally
many rows wherever the values lie.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voxledger.functions.numbers import col

SEG = "seg"
#: Rows of a piece, as far as positions are dense.
PIECE_ROWS = 65_536
PIECE_ROWS_CONF = "spark.voxledger.pieceRows"
#: Quantiles of a group that is cut by value, and values drawn from one that is cut by text.
SHARES = 1023
DRAWN = 4096
_KINDS = {"sum": F.sum, "min": F.min, "max": F.max}


def piece_rows(spark: SparkSession) -> int:
    return int(spark.conf.get(PIECE_ROWS_CONF, str(PIECE_ROWS)))


def seg_of(df: DataFrame, fn=F.min) -> Column:
    """Aggregate that keeps ``seg`` when rows are grouped."""
    return fn(SEG).alias(SEG)


def with_segments(df: DataFrame, by: Sequence[str], pos: Column | str, step: int = 1) -> DataFrame:
    """Add ``seg``; a table that already has one is returned as it is.

    ``pos`` numbers the rows of a group if it is an integer, about ``step`` apart;
    anything else is a value that orders them.
    """
    if SEG in df.columns:
        return df
    pos = col(pos)
    if isinstance(df.select(pos).schema[0].dataType, T.IntegralType):
        width = piece_rows(df.sparkSession) * step
        return df.withColumn(SEG, F.coalesce(F.floor(pos / F.lit(width)), F.lit(-1)).cast("long"))
    return with_cuts(df, by, pos)


def _null_safe(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join on keys that may be null; the keys of the left side stay."""
    other = right.withColumnsRenamed({k: f"_key_{i}" for i, k in enumerate(keys)})
    same = [F.col(k).eqNullSafe(F.col(f"_key_{i}")) for i, k in enumerate(keys)]
    return left.join(other, same, how).drop(*[f"_key_{i}" for i in range(len(keys))])


def with_cuts(df: DataFrame, by: Sequence[str], value: Column | str) -> DataFrame:
    """Add ``seg`` by values that need not be dense, of a number, time or text.

    One aggregate finds the size of each group and, for numbers and times, SHARES
    approximate quantiles of its rows; a group of more than ``piece_rows`` rows is
    cut at as many of these as it has pieces.  Rows of one value stay together.
    Text has no quantiles; there, values of the smallest hash are drawn.
    """
    value = col(value)
    d = df.withColumn("_v", value)
    cuts = _drawn_cuts(d, by) if isinstance(d.schema["_v"].dataType, T.StringType) else _quantile_cuts(d, by)
    before = F.coalesce(F.size(F.filter("_cuts", lambda c: c <= F.col("_v"))), F.lit(0))
    seg = F.when(F.col("_cuts").isNull(), F.lit(0)).otherwise(before).cast("long")
    return _null_safe(d, cuts, by, "left").withColumn(SEG, seg).select(*df.columns, SEG)


def _quantile_cuts(d: DataFrame, by: Sequence[str]) -> DataFrame:
    width = piece_rows(d.sparkSession)
    shares = F.array(*[F.lit((i + 1) / (SHARES + 1)) for i in range(SHARES)])
    found = d.groupBy(*by).agg(F.count("_v").alias("_rows"), F.percentile_approx("_v", shares, F.lit(10 * SHARES)).alias("_q"))
    every = F.greatest(F.lit(1), F.floor(F.lit(SHARES) / F.ceil(F.col("_rows") / width)).cast("int"))
    return found.where(F.col("_rows") > width).select(*by, F.array_distinct(F.filter("_q", lambda q, i: (i + 1) % every == 0)).alias("_cuts"))


def _drawn_cuts(d: DataFrame, by: Sequence[str]) -> DataFrame:
    width = piece_rows(d.sparkSession)
    sizes = d.groupBy(*by).agg(F.count("_v").alias("_rows")).where(F.col("_rows") > width)
    top = F.lit(float(1 << 62)) * F.least(F.lit(1.0), F.lit(float(DRAWN)) / F.col("_rows")) * 2
    drawn = (
        _null_safe(d.select(*by, "_v"), sizes, by).where(F.abs(F.xxhash64(*by, "_v").cast("double")) <= top)
        .groupBy(*by).agg(F.sort_array(F.collect_set("_v")).alias("_drawn"), F.max("_rows").alias("_rows"))
    )
    every = F.greatest(F.lit(1), F.ceil(F.size("_drawn") / F.ceil(F.col("_rows") / width)).cast("int"))
    return drawn.select(*by, F.filter("_drawn", lambda v, i: (i + 1) % every == 0).alias("_cuts"))


def ordered(
    df: DataFrame,
    by: Sequence[str],
    order: Sequence[str],
    *,
    index: str | None = None,
    previous: dict[str, Column | str] | None = None,
    sums: dict[str, Column | str] | None = None,
    maxes: dict[str, Column | str] | None = None,
    totals: dict[str, tuple[str, Column | str]] | None = None,
) -> DataFrame:
    """Ordered columns per group of a table with ``seg``.

    index     0-based position in the group
    previous  value on the row before
    sums      running sum up to and with the row
    maxes     running maximum over the rows before
    totals    ("sum"|"min"|"max", expr) over the whole group
    """
    previous, sums, maxes = previous or {}, sums or {}, maxes or {}
    if totals:  # need no order and no pieces
        d = _in_order(df, by, order, index, previous, sums, maxes) if index or previous or sums or maxes else df
        return _null_safe(d, df.groupBy(*by).agg(*[_KINDS[k](col(e)).alias(n) for n, (k, e) in totals.items()]), by)
    return _in_order(df, by, order, index, previous, sums, maxes)


def _in_order(
    df: DataFrame, by: Sequence[str], order: Sequence[str], index: str | None, previous: dict[str, Column | str],
    sums: dict[str, Column | str], maxes: dict[str, Column | str],
) -> DataFrame:
    part = [*by, SEG]
    w = Window.partitionBy(*part).orderBy(*order)
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    prev = F.struct(*[col(e).alias(f"p{i}") for i, e in enumerate(previous.values())]) if previous else None

    local = []
    if index:
        local.append(F.row_number().over(w).alias("_li"))
    if previous:
        local.append(F.lag(prev).over(w).alias("_lp"))
    local += [F.sum(col(e)).over(upto).alias(f"_ls{i}") for i, e in enumerate(sums.values())]
    local += [F.max(col(e)).over(before).alias(f"_lm{i}") for i, e in enumerate(maxes.values())]

    pieces = [F.count(F.lit(1)).alias("_n")]
    if previous:
        pieces.append(F.max_by(prev, F.struct(*order)).alias("_p"))
    pieces += [F.sum(col(e)).alias(f"_s{i}") for i, e in enumerate(sums.values())]
    pieces += [F.max(col(e)).alias(f"_m{i}") for i, e in enumerate(maxes.values())]
    cw = Window.partitionBy(*by).orderBy(SEG)
    cbefore = cw.rowsBetween(Window.unboundedPreceding, -1)
    call = Window.partitionBy(*by)
    carried = [F.count(F.lit(1)).over(call).alias("_pieces"), F.sum("_n").over(cbefore).alias("_cn")]
    if previous:
        carried.append(F.lag("_p").over(cw).alias("_cp"))
    carried += [F.sum(f"_s{i}").over(cbefore).alias(f"_cs{i}") for i in range(len(sums))]
    carried += [F.max(f"_m{i}").over(cbefore).alias(f"_cm{i}") for i in range(len(maxes))]
    carry = df.groupBy(*part).agg(*pieces).select(*part, *carried)
    # a group in one piece needs nothing carried, which leaves few rows to join or none
    carry = carry.where(F.col("_pieces") > 1).drop("_pieces")

    joined = df.select("*", *local).join(carry, part, "left")

    out = []
    if index:
        out.append((F.col("_li") - 1 + F.coalesce(F.col("_cn"), F.lit(0))).cast("long").alias(index))
    if previous:
        last = F.coalesce(F.col("_lp"), F.col("_cp"))
        out += [last.getField(f"p{i}").alias(n) for i, n in enumerate(previous)]
    out += [
        F.when(F.col(f"_cs{i}").isNull(), F.col(f"_ls{i}"))
        .otherwise(F.coalesce(F.col(f"_ls{i}") + F.col(f"_cs{i}"), F.col(f"_cs{i}")))
        .alias(n)
        for i, n in enumerate(sums)
    ]
    out += [F.greatest(F.col(f"_lm{i}"), F.col(f"_cm{i}")).alias(n) for i, n in enumerate(maxes)]
    return joined.select(*[F.col(c) for c in df.columns], *out)


def attach(df: DataFrame, stats: DataFrame, by: Sequence[str]) -> DataFrame:
    """Join one row per group to the group's rows; ``seg`` is that of ``df``.

    An equi-join on the group: adaptive execution splits the rows of a large one.
    """
    return df.join(stats.drop(SEG), list(by))


def _step_of(x: Column) -> Column:
    """A whole number that never falls as x grows: 64 steps to an octave, from about a millionth on."""
    size = F.least(F.log2(F.abs(x) * F.lit(float(1 << 20)) + 1.0) * 64.0, F.lit(1e6))
    return F.floor(F.signum(x) * size).cast("long")


def quantiles(
    df: DataFrame, by: Sequence[str], x: Column | str, probs: dict[str, float], count: str | None = None
) -> DataFrame:
    """Exact quantiles with linear interpolation, one row per group.

    Equal values are counted first, so a value that fills the table is one row;
    the distinct values of a group fall into pieces, and only pieces with a rank
    that is asked for are ordered.
    Nothing is gathered per group, unlike ``percentile``.
    """
    counts = (
        df.withColumn("_x", col(x).cast("double"))
        .where(F.col("_x").isNotNull())
        .groupBy(*by, "_x")
        .agg(F.count(F.lit(1)).alias("_w"))
    )
    # groups are cut where a monotone function of the value steps; only the pieces that hold a rank asked for are ordered
    counts = counts.withColumn(SEG, _step_of(F.col("_x")))
    group = Window.partitionBy(*by)
    here = F.sum("_pw").over(group.orderBy(SEG).rowsBetween(Window.unboundedPreceding, -1))
    pieces = counts.groupBy(*by, SEG).agg(F.sum("_w").alias("_pw")).select(
        "*", F.coalesce(here, F.lit(0)).alias("_before"), F.sum("_pw").over(group).alias("_all")
    )
    ranks = [fn((F.col("_all") - 1) * F.lit(float(p))) for p in probs.values() for fn in (F.floor, F.ceil)]
    held = [(F.col("_before") <= r) & (r < F.col("_before") + F.col("_pw")) for r in ranks]
    ranked = _null_safe(counts, pieces.where(reduce(or_, held)).drop("_pw"), [*by, SEG]).withColumn(
        "_cum", F.col("_before") + F.sum("_w").over(Window.partitionBy(*by, SEG).orderBy("_x").rowsBetween(Window.unboundedPreceding, 0))
    )

    def at(rank: Column) -> Column:
        here = (F.col("_cum") - F.col("_w") <= rank) & (rank < F.col("_cum"))
        return F.max(F.when(here, F.col("_x")))

    aggs, out = [], []
    for i, (name, p) in enumerate(probs.items()):
        k = (F.col("_all") - 1) * F.lit(float(p))
        aggs += [
            at(F.floor(k)).alias(f"_a{i}"),
            at(F.ceil(k)).alias(f"_b{i}"),
            F.max(k - F.floor(k)).alias(f"_f{i}"),
        ]
        out.append((F.col(f"_a{i}") + (F.col(f"_b{i}") - F.col(f"_a{i}")) * F.col(f"_f{i}")).alias(name))
    if count:
        aggs.append(F.max("_all").alias(count))
        out.append(F.col(count))
    return ranked.groupBy(*by).agg(*aggs).select(*by, *out)


def global_index(df: DataFrame, key: str, out: str) -> DataFrame:
    """Dense 0-based number of each row by ``(md5(key), key)``, without one big sort.

    The first three hex digits cut the table into 4096 pieces; only the 4096
    piece counts are summed in one task.
    """
    d = df.withColumn("_h", F.md5(F.col(key).cast("string"))).withColumn("_b", F.substring("_h", 1, 3))
    counts = d.groupBy("_b").agg(F.count(F.lit(1)).alias("_n"))
    start = counts.select(
        "_b",
        F.coalesce(
            F.sum("_n").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
        ).alias("_start"),
    )
    local = F.row_number().over(Window.partitionBy("_b").orderBy("_h", key))
    return (
        d.withColumn("_r", local)
        .join(F.broadcast(start), "_b")
        .select(*df.columns, (F.col("_start") + F.col("_r") - 1).cast("long").alias(out))
    )
