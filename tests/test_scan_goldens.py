"""Small literal tables at the edges of the scan and calibration rules."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxledger.operators import evaluate as E
from voxledger.operators import indicators as I
from voxledger.operators import prepare as P
from voxledger.operators import profiles as R
from voxledger.operators import synthesis as S

W = "clip_id int, window_id int, start_time double, end_time double, vocoder_score double, spectral_score double, prosody_score double, boundary_detected boolean"


def windows(spark, rows):
    return spark.createDataFrame([(c, w, w * 0.5, w * 0.5 + 1.5, v, s, p, b) for c, w, v, s, p, b in rows], W)


def test_suspicion_edges(spark):
    d = windows(spark, [(1, 0, 38.0, 38.0, 38.0, False), (1, 1, 37.9, 37.9, 37.9, False), (1, 2, 0.0, 88.0, 0.0, False), (1, 3, 0.0, 87.9, 0.0, False)])
    assert [r["is_suspicious"] for r in S.flag_windows(d).orderBy("window_id").collect()] == [True, False, True, False]


def test_lone_flag_is_suppressed(spark):
    rows = [(1, w, 2.0, 90.0 if w == 2 else 2.0, 10.0, False) for w in range(8)]
    rows += [(2, *r[1:]) for r in rows]
    models = spark.createDataFrame([(1, 10.0, 5.0), (2, 50.0, 5.0), (3, 0.0, 5.0)], "clip_id int, model double, duration_sec double")
    clips, intervals = S.synthesise(windows(spark, rows), models)
    by = {r["clip_id"]: r for r in clips.collect()}
    assert by[1]["suppressed"] and by[1]["n_intervals"] == 0 and not by[2]["suppressed"] and by[2]["n_intervals"] == 1
    assert [r["clip_id"] for r in intervals.collect()] == [2]
    assert by[3]["n_windows"] == 0 and (by[3]["vocoder"], by[3]["spectral"], by[3]["prosody"]) == (10.0, 10.0, 10.0)


def test_interval_gap_edge(spark):
    def n(gap):
        d = spark.createDataFrame([(1, 0.0, 1.0), (1, 1.0 + gap, 3.0)], "clip_id int, a double, b double")
        return S.merge_intervals(d, ["clip_id"], "a", "b").count()

    assert n(0.55) == 1 and n(0.5500001) == 2


def test_jump_score_edges(spark):
    thr = 10 + 2.2 * 2
    df = spark.createDataFrame([(None,), (10.0,), (10.1,), (thr,), (thr + 1e-6,), (thr + 4.0,)], "d double")
    s, b, _ = I.jump_score(F.col("d"), F.lit(10.0), F.lit(2.0))
    rows = df.select(s.alias("s"), b.alias("b")).collect()
    assert [r["b"] for r in rows] == [False, False, False, False, True, True]
    assert rows[0]["s"] == 0 and rows[1]["s"] == 5 and rows[3]["s"] == pytest.approx(45) and rows[5]["s"] == pytest.approx(100)


def test_spectral_score_is_rounded_and_limited(spark):
    fr = spark.createDataFrame([(1, w, w, [float(w % 2)] * 13, 0.1, 1.0) for w in range(12)], "clip_id int, window_id int, frame_id int, mfcc array<double>, rms double, centroid double")
    d = I.spectral_indicator(I.window_spectral(fr), I.mfcc_baseline(fr, chunk=2, hop=1)).orderBy("window_id").collect()
    assert d[0]["spectral_score"] == 2.0 and all(2 <= r["spectral_score"] <= 98 and round(r["spectral_score"], 1) == r["spectral_score"] for r in d)
    off = I.spectral_indicator(I.window_spectral(fr), I.mfcc_baseline(fr, chunk=2, hop=1), boundary_mode="suppressed")
    assert off.where("boundary_detected").count() == 0


def test_constant_pitch_has_no_entropy(spark):
    p = spark.createDataFrame([(1, 0, f, 120.0, True) for f in range(12)] + [(1, 1, f, 100.0 + f, f < 5) for f in range(12)], "clip_id int, window_id int, frame_id int, f0 double, voiced boolean")
    by = {r["window_id"]: r for r in I.pitch_indicator(p).collect()}
    assert by[0]["pitch_entropy"] == 0 and by[0]["micro_jitter"] == 0
    assert (by[1]["pitch_entropy"], by[1]["micro_jitter"], by[1]["pitch_std"]) == (2.8, 1.0, 10.0)


def test_entropy_matches_numpy(spark):
    x = np.random.default_rng(2).normal(150, 20, 80)
    p = spark.createDataFrame([(1, 0, i, float(v)) for i, v in enumerate(x)], "clip_id int, window_id int, frame_id int, f0 double")
    c, _ = np.histogram(x, bins=15)
    q = c[c > 0] / len(x)
    assert I.binned_entropy(p, ["clip_id", "window_id"]).first()["entropy"] == pytest.approx(-(q * np.log2(q)).sum())


def test_pauses_at_the_edges_do_not_count(spark):
    speech = [0, 0, 1, 0, 0, 0, 1, 1, 0, 1, 0]
    d = spark.createDataFrame([(1, i, 1.0 if s else 0.0) for i, s in enumerate(speech)], "clip_id int, frame_id int, rms double")
    rows = R.interior_pauses(R.with_speech_mask(d), 0.03).orderBy("first_frame").collect()
    assert [(r["first_frame"], r["n_frames"]) for r in rows] == [(3, 3)]  # one frame of 0.03 s is too short


@pytest.mark.parametrize("n", [1, 2, 7, 59, 60, 61, 500])
def test_resample_matches_numpy(spark, n):
    d = spark.range(n).select(F.lit(1).alias("clip_id"), F.col("id").alias("frame_id"), F.col("id").cast("double").alias("rms"))
    got = [r["rms"] for r in R.resample_points(d, "frame_id", 60, ["rms"]).orderBy("j").collect()]
    assert got == list(np.linspace(0, n - 1, 60, dtype=int))


def samples(spark, x, clip=1):
    return spark.createDataFrame([(clip, i, float(v)) for i, v in enumerate(x)], "clip_id int, seq long, x double")


def reference_gate(x, frame, trim_frame, hop, shortest):
    """The gate, spelled out on one array."""
    n = len(x) // frame
    if n == 0:
        return 0, x
    e = np.sqrt((x[: n * frame].reshape(n, frame) ** 2).mean(axis=1))
    db = 20 * np.log10(np.maximum(e, 1e-10))
    if 20 * np.log10(max(np.sqrt((x**2).mean()), 1e-10)) < -60:
        return None, x[:0]

    def trim(top):
        pad = np.concatenate([np.zeros(trim_frame // 2), x, np.zeros(trim_frame)])
        r = np.array([np.sqrt((pad[i * hop : i * hop + trim_frame] ** 2).mean()) for i in range(1 + len(x) // hop)])
        lev = 20 * np.log10(np.maximum(r, 1e-5))
        keep = np.flatnonzero(lev > lev.max() - top)
        return x[keep[0] * hop : min(len(x), (keep[-1] + 1) * hop)]

    if db.std() < 3:
        y = trim(40)
        return (1, y) if len(y) >= shortest else (0, x)
    on = db >= np.percentile(db, 2) + 6
    if on.mean() >= 0.2:
        y = x[: n * frame].reshape(n, frame)[on].ravel()
        return 2, np.concatenate([y, x[n * frame :]]) if on[-1] else y
    y = trim(30)
    return (3, y) if len(y) >= shortest else (None, x[:0])


@pytest.mark.parametrize("kind", ["uniform", "gaps", "last_on", "burst", "silent", "short", "zero_edges"])
@pytest.mark.parametrize("cut", [False, True])
def test_gate_tiers(spark, kind, cut):
    rng = np.random.default_rng(8)
    x = rng.normal(0, 0.1, 203)
    if kind == "gaps":
        x[40:120] *= 0.001
    elif kind == "last_on":
        x[:100] *= 0.001
    elif kind == "burst":
        x[:] = 0.02 * rng.normal(size=203)
        x[100:112] = 0.9
        x[150:] = x[150:] * 0 + 0.02 * np.sign(x[150:])
    elif kind == "silent":
        x *= 1e-5
    elif kind == "short":
        x = x[:3]
    elif kind == "zero_edges":
        x[:16] = 0
        x[190:] = 0
    if cut:
        spark.conf.set("spark.voxledger.pieceRows", "16")
    tier, want = reference_gate(x, 4, 8, 2, 8)
    out = P.resequence(P.gate(P.frames_from_samples(samples(spark, x), 4), 4, 8, 2, 8))
    rows = out.orderBy("pos", "n").collect()
    assert {r["tier"] for r in rows} == {tier}
    assert (rows[0]["reject_reason"] == "no_speech") is (tier is None)
    np.testing.assert_allclose(np.concatenate([r["xs"] for r in rows]), want)


SCORES = "label int, signal string, score double"


def test_auc(spark):
    rng = np.random.default_rng(1)
    rows = [(int(label), "a", float(s)) for label, s in zip(rng.integers(0, 2, 300), rng.integers(0, 20, 300))]
    d = spark.createDataFrame(rows + [(1, "empty", 3.0)], SCORES)
    auc = {r["signal"]: r["auc"] for r in E.roc_auc(d).collect()}
    pos, neg = (np.array([s for label, _, s in rows if label == k]) for k in (1, 0))
    diff = pos[:, None] - neg[None]
    assert auc["a"] == round(((diff > 0).sum() + 0.5 * (diff == 0).sum()) / diff.size, 4) and auc["empty"] == 0.5
    flipped = E.roc_auc(d.where("signal = 'a'").withColumn("score", -F.col("score"))).first()["auc"]
    assert auc["a"] + flipped == pytest.approx(1, abs=2e-4)


@pytest.mark.parametrize("cut", [False, True])
def test_curve_matches_brute_force(spark, cut):
    rng = np.random.default_rng(4)
    rows = [(int(label), "a", float(np.round(s, 2))) for label, s in zip(rng.integers(0, 2, 400), rng.normal(50, 20, 400))]
    if cut:
        spark.conf.set("spark.voxledger.pieceRows", "16")
    c = E.error_curve(spark.createDataFrame(rows, SCORES)).orderBy("idx").toPandas()
    pos, neg = (np.array([s for label, _, s in rows if label == k]) for k in (1, 0))
    allv = np.concatenate([pos, neg])
    t = np.linspace(allv.min(), allv.max(), 1000)
    assert len(c) == 1000
    np.testing.assert_allclose(c["threshold"], t)
    np.testing.assert_allclose(c["far"], [(neg >= v).mean() for v in t])
    np.testing.assert_allclose(c["frr"], [(pos < v).mean() for v in t])
    assert (np.diff(c["far"]) <= 0).all() and (np.diff(c["frr"]) >= 0).all()
    e = E.equal_error(E.error_curve(spark.createDataFrame(rows, SCORES))).first()
    far, frr = c["far"].to_numpy(), c["frr"].to_numpy()
    i = int(np.argmin(np.abs(far - frr)))
    assert e["eer_pct"] == pytest.approx((far[i] + frr[i]) * 50, abs=0.006)


def test_one_class_and_constant_scores(spark):
    d = spark.createDataFrame([(1, "x", 5.0), (1, "x", 6.0), (0, "c", 7.0), (1, "c", 7.0)], SCORES)
    by = {r["signal"]: r for r in E.evaluate_signals(d).collect()}
    assert (by["x"]["eer_pct"], by["x"]["optimal_threshold"], by["x"]["auc"]) == (50.0, 50.0, 0.5)
    assert by["c"]["auc"] == 0.5 and by["c"]["eer_pct"] == 50.0


def test_weights_sum_to_one(spark):
    rep = spark.createDataFrame([("neural_identity", 17.5), ("formants", 8.75), ("pitch", 0.2), ("rhythm", 50.6)], "signal string, eer_pct double")
    w = E.inverse_error_weights(rep).toPandas()
    assert w["weight"].sum() == pytest.approx(1.0, abs=1e-12)
