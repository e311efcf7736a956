import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from voxledger import constants as K
from voxledger.functions import vectors as V
from voxledger.functions.numbers import clip, fixed, ladder, round_dp
from voxledger.operators import compare as C


def test_rounding_is_pythons(spark):
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.integers(-10**6, 10**6, 4000) / 1000.0, rng.random(2000) * 100, [0.5, 1.5, 2.5, 0.125, 2.675, 1.005, -0.04]])
    df = spark.createDataFrame([(float(v),) for v in x], "x double")
    for d in range(5):
        rows = df.select("x", round_dp("x", d).alias("sql"), round_dp(F.col("x"), d).alias("col"), fixed("x", d).alias("t")).collect()
        for r in rows:
            want = round(r["x"], d) + 0.0
            assert r["sql"] == want and r["col"] == want, (r["x"], d)
            assert float(r["t"]) == want


def test_null_stays_null(spark):
    r = spark.range(1).select(
        clip(F.lit(None).cast("double"), 0, 1).alias("a"), fixed(F.lit(None).cast("double"), 1).alias("b"),
        round_dp(F.lit(None).cast("double"), 1).alias("c"),
    ).first()
    assert r["a"] is None and r["b"] is None and r["c"] is None


@pytest.mark.parametrize("score,verdict", [(85.0, 0), (84.9, 1), (75.0, 1), (74.9, 2), (60.0, 2), (59.9, 3), (45.0, 3), (44.9, 4)])
def test_verdict_edges(spark, score, verdict):
    names = [n for _, n in K.VERDICTS] + [K.VERDICT_BELOW]
    df = spark.createDataFrame([(score,)], "s double")
    assert df.select(ladder("s", K.VERDICTS, K.VERDICT_BELOW)).first()[0] == names[verdict]
    assert df.select(ladder(F.col("s"), K.VERDICTS, K.VERDICT_BELOW)).first()[0] == names[verdict]


def test_threshold_note_follows_the_ladder():
    assert C.threshold_note().startswith("Verdict thresholds: >=85% Very Likely Same Speaker, >=75%")


def test_vectors(spark):
    df = spark.createDataFrame([([1.0, 2.0, 2.0], [2.0, 0.0, 1.0]), ([0.0, 0.0, 0.0], [1.0, 1.0, 1.0])], "a array<double>, b array<double>")
    r = df.select(V.dot("a", "b").alias("d"), V.l2norm("a").alias("n"), V.cosine("a", "b").alias("c"), V.cosine("b", "a").alias("c2"), V.euclid("a", "b").alias("e")).collect()
    assert r[0]["d"] == 4 and r[0]["n"] == 3 and r[0]["c"] == pytest.approx(4 / (3 * 5**0.5)) and r[0]["c"] == r[0]["c2"]
    assert r[1]["c"] is None and r[1]["e"] == pytest.approx(3**0.5)


DIMS = "pair_id int, first_neural double, second_neural double, formants double, pitch double, spectral_mfcc double, rhythm double, energy double, risk1 double, risk2 double"


def test_fusion_of_equal_scores_is_that_score(spark):
    rows = [(1, 70.0, 70.0, 70.0, 70.0, 70.0, 70.0, 70.0, 0.0, 0.0), (2, None, 70.0, None, None, 70.0, None, 70.0, 0.0, 60.0)]
    out = {r["pair_id"]: r for r in C.fuse(spark.createDataFrame(rows, DIMS)).collect()}
    assert out[1]["similarity"] == 70.0 and out[1]["confidence"] == "HIGH" and out[1]["penalty"] == 0
    assert out[2]["similarity"] == 70.0 and out[2]["confidence"] == "LOW"
    assert C.contradictions(C.fuse(spark.createDataFrame(rows[:1], DIMS))).count() == 0


def test_penalty_and_conflict(spark):
    rows = [(1, 100.0, 100.0, 100.0, 100.0, 100.0, 100.0, 100.0, 10.0, 100.0), (2, 90.0, 90.0, 64.9, 65.0, 90.0, 90.0, 90.0, 0.0, 0.0)]
    f = C.fuse(spark.createDataFrame(rows, DIMS))
    assert f.where("pair_id = 1").first()["similarity"] == 70.0
    c = C.contradictions(f).toPandas()
    assert list(c[c.pair_id == 1]["type"]) == ["synthetic_identity_conflict"]
    two = c[c.pair_id == 2]
    assert (two["delta"] >= 25).all() and len(two) == 8  # four scores of 90 against 65.0 and 64.9
    assert set(two["dim_low"]) == {"pitch", "formants"}


@settings(max_examples=20, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 60), st.integers(1, 8)), min_size=1, max_size=25))
def test_merged_intervals(spark, spans):
    from voxledger.operators.synthesis import merge_intervals

    rows = [(1, s * 0.5, s * 0.5 + e * 0.25) for s, e in spans]
    got = merge_intervals(spark.createDataFrame(rows, "clip_id int, a double, b double"), ["clip_id"], "a", "b").orderBy("t_start").collect()
    want: list[list[float]] = []
    for _, s, e in sorted(rows):
        if want and s <= want[-1][1] + 0.55:
            want[-1][1] = max(want[-1][1], e)
        else:
            want.append([s, e])
    assert [[r["t_start"], r["t_end"]] for r in got] == want
    assert sum(r["n_windows"] for r in got) == len(rows)
