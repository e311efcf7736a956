"""Calibration of scores against labels, for all signals in one job.

Everything starts from counts per ``(signal, score)``: equal scores collapse
before any ordering, and the ordered steps are the segmented ones, because a
handful of signals would otherwise mean a handful of tasks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxledger import constants as K
from voxledger.functions.numbers import round_dp
from voxledger.functions.ordered import ordered, with_segments

SIGNAL = ["signal"]


def impute(df: DataFrame, columns: Sequence[str], value: float) -> DataFrame:
    return df.fillna(value, subset=list(columns))


def long_scores(df: DataFrame, signals: Sequence[str], missing: float = 0.0) -> DataFrame:
    """One row per item and signal; a missing score becomes ``missing``."""
    pairs = ", ".join(f"'{s}', `{s}`" for s in signals)
    return df.selectExpr("label", f"stack({len(signals)}, {pairs}) AS (signal, score)").fillna(missing, subset=["score"])


def score_counts(scores: DataFrame) -> DataFrame:
    """Positives and negatives per distinct score of a signal."""
    counts = scores.groupBy("signal", "score").agg(
        F.sum((F.col("label") == 1).cast("long")).alias("pos"),
        F.sum((F.col("label") == 0).cast("long")).alias("neg"),
    )
    return with_segments(counts, SIGNAL, "score")


def _cumulative(counts: DataFrame) -> DataFrame:
    return ordered(
        counts,
        SIGNAL,
        ["score"],
        sums={"pos_upto": "pos", "neg_upto": "neg"},
        totals={
            "n_pos": ("sum", "pos"), "n_neg": ("sum", "neg"), "lo": ("min", "score"), "hi": ("max", "score"),
        },
    )


def roc_auc(scores: DataFrame) -> DataFrame:
    """Area under the ROC curve by mid-ranks; 0.5 where a class is empty."""
    return _auc(_cumulative(score_counts(scores)))


def _auc(cum: DataFrame) -> DataFrame:
    # each positive beats the negatives below it and half of those level with it;
    # doubled, the sum is an exact integer
    beats = F.sum((F.col("pos") * (F.col("neg_upto") * 2 - F.col("neg"))).cast("decimal(38,0)"))
    pairs = F.max("n_pos").cast("double") * F.max("n_neg").cast("double")
    return cum.groupBy("signal").agg(
        round_dp(
            F.when(pairs > 0, beats.cast("double") / F.lit(2.0) / F.nullif(pairs, F.lit(0.0))).otherwise(0.5), 4
        ).alias("auc")
    )


def _grid_value(i: Column, lo: Column, hi: Column, n: int) -> Column:
    """i-th of ``n`` evenly spaced thresholds; the last is the maximum itself."""
    step = (hi - lo) / F.lit(float(n - 1))
    return F.when(i == n - 1, hi).otherwise(lo + i * step)


def _grid_index(x: Column, lo: Column, hi: Column, n: int) -> Column:
    """Largest i whose threshold is <= x, settled by comparing with the thresholds themselves."""
    guess = F.coalesce(F.floor((x - lo) / F.nullif((hi - lo) / F.lit(float(n - 1)), F.lit(0.0))), F.lit(n - 1))
    guess = F.least(F.lit(n - 1), F.greatest(F.lit(0), guess))
    up = (guess < n - 1) & (_grid_value(guess + 1, lo, hi, n) <= x)
    down = _grid_value(guess, lo, hi, n) > x
    return (guess + F.when(up, 1).when(down, -1).otherwise(0)).cast("int")


def error_curve(scores: DataFrame, n: int = K.CURVE_THRESHOLDS) -> DataFrame:
    """FAR, FRR and accuracy at ``n`` thresholds between a signal's smallest and largest score.

    Each distinct score is placed on the grid by arithmetic; the curve is a
    running sum over at most ``n`` bins per signal.  No score meets a threshold
    in a join.
    """
    return _curve(_cumulative(score_counts(scores)), n)


def _curve(cum: DataFrame, n: int) -> DataFrame:
    at = _grid_index(F.col("score"), F.col("lo"), F.col("hi"), n)
    bins = (
        cum.where("n_pos > 0 AND n_neg > 0")
        .groupBy("signal", at.alias("bin"))
        .agg(
            F.sum("pos").alias("pos"), F.sum("neg").alias("neg"),
            *[F.max(c).alias(c) for c in ("n_pos", "n_neg", "lo", "hi")],
        )
    )
    # a score in bin b is >= thresholds 0..b; spread each bin over the grid points up to the next one
    w = Window.partitionBy("signal").orderBy("bin")  # at most n bins per signal
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    spread = F.sequence(F.col("bin") + 1, F.coalesce(F.lead("bin").over(w), F.lit(n - 1)))
    steps = bins.select(
        "signal", "bin", "n_pos", "n_neg", "lo", "hi",
        F.sum("pos").over(upto).alias("pos_below"), F.sum("neg").over(upto).alias("neg_below"),
        F.lead("bin").over(w).alias("_next"), spread.alias("_to"),
        F.row_number().over(w).alias("_r"),
    )
    first = steps.where("_r = 1").select(
        "signal", "n_pos", "n_neg", "lo", "hi", F.lit(0).cast("long").alias("pos_below"), F.lit(0).cast("long").alias("neg_below"),
        F.explode(F.sequence(F.lit(0), F.col("bin"))).alias("idx"),
    )
    rest = steps.where((F.col("bin") < n - 1)).select(
        "signal", "n_pos", "n_neg", "lo", "hi", "pos_below", "neg_below", F.explode("_to").alias("idx")
    )
    far = F.lit(1.0) - F.col("neg_below") / F.col("n_neg")
    frr = F.col("pos_below") / F.col("n_pos")
    right = F.col("n_pos") - F.col("pos_below") + F.col("neg_below")
    return first.unionByName(rest).select(
        "signal", "idx",
        _grid_value(F.col("idx"), F.col("lo"), F.col("hi"), n).alias("threshold"),
        ((F.col("n_neg") - F.col("neg_below")) / F.col("n_neg")).alias("far"),
        frr.alias("frr"),
        (right / (F.col("n_pos") + F.col("n_neg"))).alias("accuracy"),
        # exact integer measure of |FAR - FRR|
        F.abs((F.col("n_neg") - F.col("neg_below")) * F.col("n_pos") - F.col("pos_below") * F.col("n_neg")).alias("gap"),
    )


def curve_points(curve: DataFrame) -> DataFrame:
    """Curve in percent, two decimals."""
    return curve.select(
        "signal", "idx", round_dp("threshold", 2).alias("threshold"),
        *[round_dp(F.col(c) * F.lit(100.0), 2).alias(c) for c in ("far", "frr", "accuracy")],
    )


def thin_curve(curve: DataFrame, every: int = 20) -> DataFrame:
    return curve.where(F.col("idx") % every == 0)


def equal_error(curve: DataFrame) -> DataFrame:
    """First threshold where FAR and FRR are closest."""
    first = F.min_by(F.struct("threshold", "far", "frr"), F.struct("gap", "idx"))
    return curve.groupBy("signal").agg(first.alias("b")).select(
        "signal",
        round_dp((F.col("b.far") + F.col("b.frr")) / F.lit(2.0) * F.lit(100.0), 2).alias("eer_pct"),
        round_dp("b.threshold", 2).alias("optimal_threshold"),
    )


def _target_name(t: float) -> str:
    return f"FAR_{int(t * 1000)}bps" if t < 0.01 else f"FAR_{int(t * 100)}pct"


def operating_points(scores: DataFrame, targets: Sequence[float] = K.TARGET_FARS) -> DataFrame:
    """Threshold, measured FAR and FRR per signal and target FAR.

    The threshold is the ascending negative at index min(int((1-f)*n), n-1).
    """
    return _points(_cumulative(score_counts(scores)), targets)


def _points(cum: DataFrame, targets: Sequence[float]) -> DataFrame:
    n = F.col("n_neg")
    pick = F.array(
        *[
            F.struct(
                F.lit(_target_name(t)).alias("point"), F.lit(float(t)).alias("target_far"),
                F.least(F.floor(F.lit(1.0 - t) * n), n - 1).alias("at"),
            )
            for t in targets
        ]
    )
    here = F.filter(pick, lambda r: (F.col("neg_upto") - F.col("neg") <= r["at"]) & (r["at"] < F.col("neg_upto")))
    d = cum.where("neg > 0").withColumn("hit", F.explode(here))
    far = (n - F.col("neg_upto") + F.col("neg")) / n
    frr = F.when(F.col("n_pos") > 0, (F.col("pos_upto") - F.col("pos")) / F.nullif(F.col("n_pos"), F.lit(0))).otherwise(1.0)
    return d.select(
        "signal", "hit.point", "hit.target_far",
        round_dp("score", 2).alias("threshold"),
        round_dp(far * F.lit(100.0), 2).alias("actual_far_pct"),
        round_dp(frr * F.lit(100.0), 2).alias("actual_frr_pct"),
        (far <= F.col("hit.target_far")).alias("met_target"),
    )


def evaluate_signals(scores: DataFrame, n: int = K.CURVE_THRESHOLDS) -> DataFrame:
    """AUC, EER, optimal threshold and class means per signal."""
    cum = _cumulative(score_counts(scores))
    means = scores.groupBy("signal").agg(
        F.coalesce(F.avg(F.when(F.col("label") == 1, F.col("score"))), F.lit(0.0)).alias("mean_positive"),
        F.coalesce(F.avg(F.when(F.col("label") == 0, F.col("score"))), F.lit(0.0)).alias("mean_negative"),
    )
    return (
        _auc(cum).join(equal_error(_curve(cum, n)), "signal", "left").join(means, "signal")
        .fillna(50.0, subset=["eer_pct", "optimal_threshold"])
    )


def inverse_error_weights(report: DataFrame, residue_to: str = "neural_identity") -> DataFrame:
    """Weights proportional to 1/max(1, EER), three decimals, the rounding residue on one signal.

    ``report`` has one row per signal, so the global window is a handful of rows.
    """
    everything = Window.partitionBy()
    inv = F.lit(1.0) / F.greatest(F.lit(1.0), F.col("eer_pct"))
    d = report.withColumn("_inv", inv).withColumn("_w", round_dp(F.col("_inv") / F.sum("_inv").over(everything), 3))
    residue = round_dp(F.lit(1.0) - F.sum("_w").over(everything), 3)
    return d.withColumn(
        "weight", F.when(F.col("signal") == residue_to, round_dp(F.col("_w") + residue, 3)).otherwise(F.col("_w"))
    ).drop("_inv", "_w")


def category_accuracy(items: DataFrame) -> DataFrame:
    """Overall, bona-fide and synthetic accuracy, false-positive rate and splice recall, in percent."""
    hit = (F.col("pred") == F.col("truth")).cast("int")

    def share(x: Column) -> Column:
        return F.coalesce(F.avg(x) * F.lit(100.0), F.lit(0.0))

    bona = share(F.when(F.col("truth") == K.AUTHENTIC, hit))
    found = (F.col("pred") == K.SPLICED) | (F.col("n_intervals") > 0) | (F.col("n_boundaries") > 0)
    return items.agg(
        round_dp(share(hit), 2).alias("category_accuracy_pct"),
        round_dp(bona, 2).alias("bona_fide_accuracy_pct"),
        round_dp(F.lit(100.0) - bona, 2).alias("bona_fide_fpr_pct"),
        round_dp(share(F.when(F.col("truth") == K.SYNTHETIC, hit)), 2).alias("synthetic_accuracy_pct"),
        round_dp(share(F.when(F.col("spliced"), found.cast("int"))), 2).alias("splice_recall_pct"),
    )


def confusion_matrix(items: DataFrame) -> DataFrame:
    names = [K.AUTHENTIC, K.SYNTHETIC, K.SPLICED]
    return items.groupBy("truth").pivot("pred", names).agg(F.count(F.lit(1))).fillna(0)


def class_counts(items: DataFrame) -> DataFrame:
    """Items per class and how many were skipped with an error."""
    return items.agg(
        F.count_if(F.col("error").isNull()).alias("sample_size"),
        F.count_if(F.col("error").isNull() & (F.col("truth") == K.AUTHENTIC)).alias("bona_fide"),
        F.count_if(F.col("error").isNull() & (F.col("truth") != K.AUTHENTIC)).alias("synthetic"),
        F.count_if(F.col("error").isNull() & F.col("spliced")).alias("spliced"),
        F.count_if(F.col("error").isNotNull()).alias("skipped"),
    )


def valid_items(items: DataFrame, errors: DataFrame) -> DataFrame:
    """Items whose analysis did not fail."""
    return items.join(errors, "item_id", "left_anti")


