"""Calibration queries (EVA-*), all signals in one job."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxledger.catalog.bindings import b_cats, b_scores, oracle, sql_round
from voxledger.catalog.compare import VEC_PAIRS, vec_pairs
from voxledger.catalog.registry import query
from voxledger.functions import vectors as V
from voxledger.operators import evaluate as E

SIGNALS = ["s1", "s2", "s3"]


def scores(spark, sf) -> DataFrame:
    return E.long_scores(b_scores(spark, sf), SIGNALS)


_LONG = "sl AS (SELECT label, unnest(['s1','s2','s3']) AS signal, unnest([s1, s2, coalesce(s3, 0e0)]) AS score FROM b_scores)"
_AUC = f"""cn AS (SELECT signal, score, count(*) FILTER (label=1) AS pos, count(*) FILTER (label=0) AS neg FROM sl GROUP BY 1,2),
cu AS (SELECT *, sum(neg) OVER w AS nu, sum(pos) OVER w AS pu, sum(pos) OVER (PARTITION BY signal) AS np, sum(neg) OVER (PARTITION BY signal) AS nn,
 min(score) OVER (PARTITION BY signal) AS lo, max(score) OVER (PARTITION BY signal) AS hi FROM cn WINDOW w AS (PARTITION BY signal ORDER BY score ROWS UNBOUNDED PRECEDING)),
au0 AS (SELECT signal, CASE WHEN max(np)*max(nn) > 0 THEN CAST(sum(pos*(2*nu-neg)) AS DOUBLE)/2e0/nullif(CAST(max(np) AS DOUBLE)*CAST(max(nn) AS DOUBLE),0) ELSE 0.5e0 END AS a FROM cu GROUP BY 1),
au AS (SELECT signal, {sql_round('a', 4)} AS auc FROM au0)"""
_CURVE = """g AS (SELECT signal, any_value(lo) AS lo, any_value(hi) AS hi, any_value(np) AS np, any_value(nn) AS nn FROM cu GROUP BY 1),
gt AS (SELECT *, CASE WHEN idx = 999 THEN hi ELSE lo + idx*((hi-lo)/999e0) END AS threshold FROM g, (SELECT unnest(range(1000)) AS idx)),
cv AS (SELECT gt.signal, idx, any_value(threshold) AS threshold, any_value(np) AS np, any_value(nn) AS nn, coalesce(sum(neg) FILTER (score >= threshold),0) AS fa, coalesce(sum(pos) FILTER (score < threshold),0) AS fr
 FROM gt JOIN cn ON cn.signal = gt.signal GROUP BY 1,2),
cr AS (SELECT signal, idx, threshold, fa/nn::DOUBLE AS far, fr/np::DOUBLE AS frr, (np-fr+nn-fa)/(np+nn)::DOUBLE AS accuracy, abs(fa*np-fr*nn) AS gap FROM cv),
ee AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY signal ORDER BY gap, idx) AS rn FROM cr) WHERE rn = 1)"""


def _sql(body: str, *ctes: str) -> str:
    return oracle(body, "b_scores", ctes=", ".join([_LONG, *ctes]))


@query("eva1_roc_auc", _sql("SELECT signal, auc FROM au", _AUC))
def _eva1(spark, sf):
    return E.roc_auc(scores(spark, sf))


@query(
    "eva2_error_curve",
    _sql("SELECT signal, idx, round(threshold,6) AS threshold, round(far,6) AS far, round(frr,6) AS frr, round(accuracy,6) AS accuracy FROM cr", _AUC, _CURVE),
)
def _eva2(spark, sf):
    c = E.error_curve(scores(spark, sf))
    return c.select("signal", "idx", *[F.round(x, 6).alias(x) for x in ("threshold", "far", "frr", "accuracy")])


@query(
    "eva3_equal_error",
    _sql(f"SELECT signal, {sql_round('(far+frr)/2e0*100e0', 2)} AS eer_pct, {sql_round('threshold', 2)} AS optimal_threshold FROM ee", _AUC, _CURVE),
)
def _eva3(spark, sf):
    return E.equal_error(E.error_curve(scores(spark, sf)))


@query(
    "eva4_operating_points",
    _sql(
        f"""SELECT signal, point, target_far, {sql_round('score', 2)} AS threshold, {sql_round('(nn-nu+neg)/nn::DOUBLE*100e0', 2)} AS actual_far_pct,
 {sql_round('(pu-pos)/np::DOUBLE*100e0', 2)} AS actual_frr_pct, (nn-nu+neg)/nn::DOUBLE <= target_far AS met_target FROM cu,
 (SELECT unnest(['FAR_1bps','FAR_1pct','FAR_5pct']) AS point, unnest([0.001e0,0.01e0,0.05e0]) AS target_far, unnest([0.999e0,0.99e0,0.95e0]) AS keep)
 WHERE neg > 0 AND nu-neg <= least(floor(keep*nn), nn-1) AND least(floor(keep*nn), nn-1) < nu""",
        _AUC,
    ),
)
def _eva4(spark, sf):
    return E.operating_points(scores(spark, sf))


_REPORT = f"""rp AS (SELECT au.signal, auc, {sql_round('(far+frr)/2e0*100e0', 2)} AS eer_pct, {sql_round('threshold', 2)} AS optimal_threshold, mp, mn FROM au JOIN ee USING (signal)
 JOIN (SELECT signal, avg(score) FILTER (label=1) AS mp, avg(score) FILTER (label=0) AS mn FROM sl GROUP BY 1) USING (signal))"""


@query(
    "eva5_signal_report",
    _sql("SELECT signal, auc, eer_pct, optimal_threshold, round(mp,6) AS mean_positive, round(mn,6) AS mean_negative FROM rp", _AUC, _CURVE, _REPORT),
)
def _eva5(spark, sf):
    return E.evaluate_signals(scores(spark, sf)).withColumns(
        {c: F.round(c, 6) for c in ("mean_positive", "mean_negative")}
    )


@query("eva6_imputation", oracle("SELECT item_id, label, s1, s2, coalesce(s3, 50e0) AS s3 FROM b_scores", "b_scores"))
def _eva6(spark, sf):
    return E.impute(b_scores(spark, sf), SIGNALS, 50.0)


@query(
    "eva7_inverse_error_weights",
    _sql(
        f"SELECT signal, eer_pct, CASE WHEN signal = 's1' THEN {sql_round('w + r', 3)} ELSE w END AS weight FROM (SELECT *, {sql_round('1e0 - sum(w) OVER ()', 3)} AS r FROM (SELECT signal, eer_pct, {sql_round('(1e0/greatest(1e0,eer_pct))/sum(1e0/greatest(1e0,eer_pct)) OVER ()', 3)} AS w FROM rp))",
        _AUC, _CURVE, _REPORT,
    ),
)
def _eva7(spark, sf):
    rep = E.evaluate_signals(scores(spark, sf))
    return E.inverse_error_weights(rep, residue_to="s1").select("signal", "eer_pct", "weight")


@query(
    "eva8_thin_curve",
    _sql(
        f"""SELECT signal, idx, {sql_round('threshold', 2)} AS threshold, {sql_round('far*100e0', 2)} AS far, {sql_round('frr*100e0', 2)} AS frr, {sql_round('accuracy*100e0', 2)} AS accuracy FROM cr WHERE idx % 20 = 0""",
        _AUC, _CURVE,
    ),
)
def _eva8(spark, sf):
    return E.curve_points(E.thin_curve(E.error_curve(scores(spark, sf))))


_VALID = "vc AS (SELECT * FROM b_cats WHERE error IS NULL)"


@query(
    "eva9_10_category_accuracy",
    oracle(
        f"""SELECT {sql_round('a', 2)} AS category_accuracy_pct, {sql_round('b', 2)} AS bona_fide_accuracy_pct, {sql_round('100e0-b', 2)} AS bona_fide_fpr_pct, {sql_round('s', 2)} AS synthetic_accuracy_pct, {sql_round('r', 2)} AS splice_recall_pct FROM (
 SELECT avg((pred=truth)::INT)*100e0 AS a, coalesce(avg((pred=truth)::INT) FILTER (truth='LIKELY_AUTHENTIC')*100e0,0e0) AS b, coalesce(avg((pred=truth)::INT) FILTER (truth='FULLY_SYNTHETIC')*100e0,0e0) AS s,
 coalesce(avg((pred='SPLICED_PARTIAL' OR n_intervals>0 OR n_boundaries>0)::INT) FILTER (spliced)*100e0,0e0) AS r FROM vc)""",
        "b_cats", ctes=_VALID,
    ),
)
def _eva9(spark, sf):
    items = b_cats(spark, sf)
    return E.category_accuracy(E.valid_items(items, items.where("error IS NOT NULL").select("item_id")))


@query(
    "eva11_confusion_matrix",
    oracle(
        """SELECT truth, count(*) FILTER (pred='LIKELY_AUTHENTIC') AS LIKELY_AUTHENTIC, count(*) FILTER (pred='FULLY_SYNTHETIC') AS FULLY_SYNTHETIC,
 count(*) FILTER (pred='SPLICED_PARTIAL') AS SPLICED_PARTIAL FROM b_cats GROUP BY 1""",
        "b_cats",
    ),
)
def _eva11(spark, sf):
    return E.confusion_matrix(b_cats(spark, sf))


@query(
    "eva12_class_counts",
    oracle(
        """SELECT count(*) FILTER (error IS NULL) AS sample_size, count(*) FILTER (error IS NULL AND truth='LIKELY_AUTHENTIC') AS bona_fide,
 count(*) FILTER (error IS NULL AND truth<>'LIKELY_AUTHENTIC') AS synthetic, count(*) FILTER (error IS NULL AND spliced) AS spliced, count(*) FILTER (error IS NOT NULL) AS skipped FROM b_cats""",
        "b_cats",
    ),
)
def _eva12(spark, sf):
    return E.class_counts(b_cats(spark, sf))


@query(
    "eval_pair_calibration",
    oracle(
        "SELECT signal, auc FROM au", ctes=VEC_PAIRS + ", sl AS (SELECT same::INT AS label, 'cosine' AS signal, round(greatest(0e0, least(100e0, (cos+1)*50e0)),3) AS score FROM vc), " + _AUC,
    ),
)
def _eval_pairs(spark, sf):
    d = vec_pairs(spark, sf).select(
        F.expr("CAST(la = lb AS INT)").alias("label"), F.lit("cosine").alias("signal"), F.round(V.cosine_pct("va", "vb"), 3).alias("score")
    )
    return E.roc_auc(d)
