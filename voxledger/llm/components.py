"""Connected components of a graph given as links, by alternating star steps.

Each round hangs the larger neighbours of every node on its smallest neighbour
(large star), then the smaller ones and the node itself (small star).  Every
step is a grouped minimum and an equi-join, rounds grow with the logarithm of
the longest chain, and the links of a round are written to the shared folder,
so nothing is collected and no lineage builds up.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxledger.llm.work import drop_folder, scratch, stored


#: The rows of one node are dealt to so many tasks where its smallest neighbour is joined to them.
SPLIT = 8


def _with_low(rows: DataFrame, low: DataFrame) -> DataFrame:
    """rows (node, near) with the low of their node; the centre of a large star spreads over SPLIT tasks."""
    part = F.pmod(F.xxhash64("near"), F.lit(SPLIT)).cast("int")
    parts = F.explode(F.sequence(F.lit(0), F.lit(SPLIT - 1)))
    return rows.withColumn("part", part).join(low.withColumn("part", parts), ["node", "part"])


def _large_star(links: DataFrame) -> DataFrame:
    both = links.union(links.select("b", "a")).toDF("node", "near")
    low = both.groupBy("node").agg(F.least(F.min("near"), F.col("node")).alias("low"))
    return _with_low(both.where(F.col("near") > F.col("node")), low).select(F.col("near").alias("a"), F.col("low").alias("b"))


def _small_star(links: DataFrame) -> DataFrame:
    down = links.select(F.greatest("a", "b").alias("node"), F.least("a", "b").alias("near"))
    low = down.groupBy("node").agg(F.min("near").alias("low"))
    hung = _with_low(down, low).where(F.col("near") != F.col("low")).select(F.col("near").alias("a"), F.col("low").alias("b"))
    return hung.union(low.select(F.col("node").alias("a"), F.col("low").alias("b")))


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of links (a, b), both long: root is the smallest node it reaches.

    Loops and repeated links do no harm; null ends are left out; no links give
    no rows.
    """
    spark, top = links.sparkSession, scratch(links.sparkSession)
    clean = links.select("a", "b").where(F.col("a") != F.col("b")).distinct()
    now, seen, turn = stored(clean, f"{top}/0"), None, 0
    while True:
        state = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == seen or not state[0]:
            break
        seen, turn = state, turn + 1
        now = stored(_small_star(_large_star(now)).where(F.col("a") != F.col("b")).distinct(), f"{top}/{turn}")
        if turn > 1:
            drop_folder(spark, f"{top}/{turn - 2}")
    # at the fixed point every link leads from a node to its root
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(now.select("b", "b")).distinct()
