"""Calibration of pair and scan scores against labels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxledger import constants as K
from voxledger.operators import evaluate as E

SCAN_SIGNALS = ("model", "vocoder", "spectral", "prosody")


def pair_calibration(fused: DataFrame, labels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(report per dimension and for the fused score, proposed weights) from ``pair_id, label``.

    Dimensions a pair lacks count as 50; pairs that could not be compared are left out.
    """
    dims = list(K.DIMENSION_ORDER)
    d = E.impute(fused.where("NOT no_speech").join(labels, "pair_id"), dims, K.IMPUTE_PAIR)
    report = E.evaluate_signals(E.long_scores(d, [*dims, "similarity"]))
    weights = E.inverse_error_weights(report.where(F.col("signal") != "similarity"))
    return report, weights


def scan_calibration(clips: DataFrame, truth: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(report per signal and composite, category accuracy) from ``clip_id, label, truth, spliced``."""
    verdicts = clips.select("clip_id", *SCAN_SIGNALS, "composite", "category", "n_intervals", "n_boundaries")
    d = E.impute(verdicts.join(truth, "clip_id"), SCAN_SIGNALS, K.IMPUTE_SCAN)
    report = E.evaluate_signals(E.long_scores(d, [*SCAN_SIGNALS, "composite"]))
    return report, E.category_accuracy(d.withColumnRenamed("category", "pred"))
