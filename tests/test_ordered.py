"""Segmented operations on a table where one group holds most rows."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from voxledger.functions.ordered import SEG, attach, global_index, ordered, quantiles, with_cuts, with_segments


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(5)
    g = np.where(rng.random(6000) < 0.6, 0, rng.integers(1, 3000, 6000))
    pdf = pd.DataFrame({"g": g, "t": rng.permutation(6000), "x": rng.integers(0, 50, 6000).astype(float)})
    return pdf, spark.createDataFrame(pdf)


def test_large_group_is_cut(spark, table, hot):
    _, df = table
    per = with_segments(df, ["g"], "t").where("g = 0").groupBy(SEG).count().toPandas()
    assert len(per) > 200 and per["count"].max() <= 16


@pytest.mark.parametrize("far", [False, True])
def test_cuts_follow_the_rows(spark, hot, far):
    """One group is the whole table; with far, a few values lie far out."""
    rng = np.random.default_rng(2)
    v = np.where(rng.random(4000) < 0.002, 1e15, rng.random(4000)) if far else rng.lognormal(0, 6, 4000)
    df = spark.createDataFrame(pd.DataFrame({"g": 1, "v": v}))
    per = with_cuts(df, ["g"], "v").groupBy(SEG).agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    per = per.orderBy(SEG).toPandas()
    assert len(per) >= 200 and per["n"].max() <= 40
    assert (per["hi"].to_numpy()[:-1] < per["lo"].to_numpy()[1:]).all()


def test_small_groups_stay_whole(spark, table):
    _, df = table
    assert with_segments(df, ["g"], "t").where(f"{SEG} <> 0").count() == 0
    assert with_cuts(df, ["g"], "x").where(f"{SEG} <> 0").count() == 0


@pytest.mark.parametrize("cut", [False, True])
def test_ordered_columns(spark, table, cut):
    pdf, df = table
    if cut:
        spark.conf.set("spark.voxledger.pieceRows", "16")
    d = with_segments(df, ["g"], "t")
    out = ordered(
        d, ["g"], ["t"], index="i", previous={"p": "x"}, sums={"s": "x"}, maxes={"m": "x"},
        totals={"n": ("sum", F.lit(1)), "top": ("max", "x"), "low": ("min", "x")},
    ).toPandas().sort_values(["g", "t"]).reset_index(drop=True)
    want = pdf.sort_values(["g", "t"]).reset_index(drop=True)
    by = want.groupby("g")["x"]
    assert (out["i"] == want.groupby("g").cumcount()).all()
    np.testing.assert_array_equal(out["p"].to_numpy(dtype=float), by.shift().to_numpy())
    assert (out["s"] == by.cumsum()).all()
    np.testing.assert_array_equal(out["m"].to_numpy(dtype=float), want.assign(c=by.cummax()).groupby("g")["c"].shift().to_numpy())
    for c, f in (("n", "size"), ("top", "max"), ("low", "min")):
        assert (out[c] == by.transform(f)).all()


@pytest.mark.parametrize("cut", [False, True])
def test_quantiles(spark, table, cut):
    pdf, df = table
    if cut:
        spark.conf.set("spark.voxledger.pieceRows", "16")
    out = quantiles(df, ["g"], "x", {"a": 0.02, "b": 0.5, "c": 0.95}).toPandas().set_index("g")
    for name, p in (("a", 0.02), ("b", 0.5), ("c", 0.95)):
        want = pdf.groupby("g")["x"].quantile(p)
        np.testing.assert_allclose(out[name].sort_index().to_numpy(), want.sort_index().to_numpy(), atol=1e-9)


def test_quantiles_of_one_repeated_value(spark, hot):
    df = spark.range(20000).select(F.lit(1).alias("g"), F.when(F.col("id") % 3 == 0, F.col("id")).otherwise(-1).cast("double").alias("x"))
    r = quantiles(df, ["g"], "x", {"a": 0.5, "b": 0.9}).first()
    x = np.where(np.arange(20000) % 3 == 0, np.arange(20000), -1)
    assert (r["a"], r["b"]) == pytest.approx(tuple(np.quantile(x, [0.5, 0.9])))


def test_attach(spark, table, hot):
    pdf, df = table
    d = with_segments(df, ["g"], "t")
    stats = d.groupBy("g").agg(F.avg("x").alias("m"), F.max(SEG).alias(SEG))
    out = attach(d, stats, ["g"])
    assert out.count() == len(pdf)
    got = out.groupBy("g").agg(F.min("m").alias("a"), F.max("m").alias("b"), F.avg("x").alias("c")).toPandas()
    np.testing.assert_allclose(got["a"], got["c"])
    np.testing.assert_allclose(got["b"], got["c"])


def test_global_index(spark):
    d = global_index(spark.range(5000).withColumn("k", F.concat(F.lit("s"), "id")), "k", "n").toPandas()
    assert sorted(d["n"]) == list(range(5000))
    again = global_index(spark.range(5000).repartition(7).withColumn("k", F.concat(F.lit("s"), "id")), "k", "n").toPandas()
    assert dict(zip(d["k"], d["n"])) == dict(zip(again["k"], again["n"]))
