"""Whitening of embeddings by shifted CholeskyQR.

Entries become whole numbers ``x = floor(1024 * c) + 100000``, so counts and sums
are exact and rows are centred exactly (``x - S/n`` as a small whole number less
a fraction below one) before anything is multiplied.  Each pass over the rows is
distributed: a task multiplies its centred rows by the inverse of R, a column at
a time, and adds up their Gram matrix; Spark adds the matrices of the tasks.
The Cholesky factor of the sum, shifted in the first pass so that it exists for
nearly dependent columns, is multiplied into R.  After three passes the rows
times R inverse are orthonormal to double precision, and the singular vectors
and values of R are those of the rows.

On the driver there are matrices of dimension x dimension, nothing that grows
with the rows.

Defined cases: rows whose vector is null, empty, holds null or non-finite
entries, or entries beyond 2**52 are dropped, as are vectors of another length
than most (of equally frequent lengths the longer counts).  Components whose
standard deviation is below 1e-11 of the largest are left out, for nothing can
be divided by zero: n = 1 or equal vectors give no rows.  Repeated rows and ids
count as often as they occur; a null id stays null.  An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed by the contract.
SCALE, OFFSET = 1024.0, 100_000
COMPONENTS = 8
#: Entries beyond this cannot be told apart as doubles.
LARGEST = 2.0**52
PASSES = 3
#: Smallest standard deviation of a component, as a share of the largest.
LEAST = 1e-11


@dataclass(frozen=True)
class Whitening:
    """n rows with integer sums; unit components (columns) by falling eigenvalue of the covariance."""

    n: int
    sums: tuple[int, ...]
    components: np.ndarray
    eigenvalues: np.ndarray
    trace: float

    @property
    def explained(self) -> np.ndarray:
        return self.eigenvalues / self.trace


def _clean(column: pa.Array, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the usable vectors of a length, and x of these as rows of a matrix."""
    sizes = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    at = np.flatnonzero(sizes == length)
    flat = column.take(pa.array(at)).flatten()
    c = np.asarray(flat.to_numpy(zero_copy_only=False), np.float64).reshape(-1, length)
    with np.errstate(invalid="ignore", over="ignore"):
        good = (np.abs(c * SCALE) < LARGEST).all(1)  # false for null, which is nan here, and for infinity
    return at[good], np.floor(c[good] * SCALE).astype(np.int64) + OFFSET


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(length, place, n, sum) of a task; sums are added as text of whole numbers of any size."""
    n: dict[int, int] = {}
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        column = batch.column(0)
        lengths = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
        for length in {int(v) for v in lengths if v > 0}:
            _, x = _clean(column, length)
            # halves, so that no sum of a batch leaves 64 bits
            high, low = x >> 26, x & ((1 << 26) - 1)
            total = high.sum(0).astype(object) * (1 << 26) + low.sum(0).astype(object)
            n[length] = n.get(length, 0) + len(x)
            sums[length] = sums.get(length, 0) + total
    for length, total in sums.items():
        if n[length]:
            yield pa.RecordBatch.from_pydict(
                {"length": [length] * length, "place": list(range(length)), "n": [n[length]] * length, "sum": [str(v) for v in total]}
            )


def _centred(x: np.ndarray, n: int, sums: tuple[int, ...]) -> np.ndarray:
    whole = np.array([s // n for s in sums], np.int64)
    return (x - whole) - np.array([(s % n) / n for s in sums])


def _solved(y: np.ndarray, r: np.ndarray) -> np.ndarray:
    """y times the inverse of the upper triangular r, by substitution from the first column on."""
    q = np.empty_like(y)
    for j in range(y.shape[1]):
        q[:, j] = (y[:, j] - q[:, :j] @ r[:j, j]) / r[j, j]
    return q


def _gram(df: DataFrame, column: str, n: int, sums: tuple[int, ...], image) -> np.ndarray:
    """Sum over all rows of the outer product of image(centred row) with itself."""
    width = len(sums)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            z = image(_centred(_clean(batch.column(0), width)[1], n, sums))
            total = z.T @ z if total is None else total + z.T @ z
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()), pa.array(list(total), pa.list_(pa.float64()))], names=["i", "g"])

    parts = df.select(column).mapInArrow(run, "i int, g array<double>")
    size = image(np.zeros((1, width))).shape[1]
    rows = parts.groupBy("i").agg(F.array(*[F.sum(F.col("g")[j]) for j in range(size)]).alias("g")).collect()
    total = np.zeros((size, size))
    for row in rows:
        total[row["i"]] = row["g"]
    return (total + total.T) / 2


def _factor(gram: np.ndarray, n: int, shift: bool) -> np.ndarray:
    """Upper triangular R with R'R the Gram matrix, plus a shift where it is asked for or needed."""
    d = len(gram)
    small = 11 * (n * d + d * (d + 1)) * np.finfo(float).eps * max(np.trace(gram), np.finfo(float).tiny)
    while True:
        try:
            return np.linalg.cholesky(gram + small * shift * np.eye(d)).T
        except np.linalg.LinAlgError:
            small, shift = small * (10 if shift else 1), True


def fit(df: DataFrame, column: str = "embedding", k: int = COMPONENTS) -> Whitening | None:
    """The whitening of all usable vectors of a table; None where there are none or they do not vary."""
    totals = (
        df.select(column).mapInArrow(_sums, "length long, place long, n long, sum string")
        .groupBy("length", "place").agg(F.sum("n").alias("n"), F.sum(F.col("sum").cast("decimal(38,0)")).alias("sum"))
    )
    most = totals.where("place = 0").orderBy(F.desc("n"), F.desc("length")).limit(1)
    found = totals.join(most.select("length"), "length").orderBy("place").collect()
    if not found:
        return None
    n, sums = found[0]["n"], tuple(int(r["sum"]) for r in found)
    r = np.eye(len(sums))
    for step in range(PASSES):
        factor = _factor(_gram(df, column, n, sums, lambda y, r=r: _solved(y, r)), n, step == 0)
        if step == 0 and factor[0, 0] < 1e-150:
            return None
        r = factor @ r
    _, sigma, rows = np.linalg.svd(r)
    keep = sigma[:k] > LEAST * sigma[0] if sigma[0] > 1e-100 else np.zeros(len(sigma[:k]), bool)
    if not keep.any():
        return None
    values = sigma**2 / n
    return Whitening(n, sums, rows[:k][keep].T.copy(), values[:k][keep], float(values.sum()))


def identity_error(df: DataFrame, model: Whitening, column: str = "embedding") -> float:
    """Largest absolute entry of the covariance of the whitened rows minus the identity, measured on all rows."""
    scaled = model.components / np.sqrt(model.eigenvalues)
    covariance = _gram(df, column, model.n, model.sums, lambda y: y @ scaled) / model.n
    return float(np.abs(covariance - np.eye(len(covariance))).max())


def _deviation(x: np.ndarray, n: int, sums: tuple[int, ...]) -> list[int | None]:
    """Sum over the entries of (n x - S)**2, exact; null where it does not fit 64 bits."""
    whole, part = np.array([s // n for s in sums], np.int64), np.array([s % n for s in sums], np.int64)
    near = x - whole
    if len(x) and (np.abs(near).max() + 1.0) ** 2 * n * n * x.shape[1] < 2.0**62:
        return ((n * near - part) ** 2).sum(1).tolist()
    exact = ((near.astype(object) * n - part.astype(object)) ** 2).sum(1)
    return [int(v) if v < 2**63 else None for v in exact]


def whitened(df: DataFrame, model: Whitening, column: str = "embedding", key: str = "vec_id") -> DataFrame:
    """(key, deviation, whitened array) of the usable rows of a table."""
    scaled = model.components / np.sqrt(model.eigenvalues)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, x = _clean(batch.column(1), len(model.sums))
            w = _centred(x, model.n, model.sums) @ scaled
            deviation = pa.array(_deviation(x, model.n, model.sums), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), deviation, pa.array(list(w), pa.list_(pa.float64()))], names=[key, "deviation", "whitened"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, column).mapInArrow(run, f"`{key}` {kind}, deviation long, whitened array<double>")


def component_rows(df: DataFrame, column: str = "embedding", key: str = "vec_id", k: int = COMPONENTS) -> DataFrame:
    """One row per usable vector and component, with the figures of the whole fit."""
    model = fit(df, column, k)
    if model is None:
        kind = df.schema[key].dataType.simpleString()
        return df.sparkSession.createDataFrame([], f"{key} {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double")
    error = identity_error(df, model, column)
    explained = F.array(*[F.lit(float(v)) for v in model.explained])
    return whitened(df, model, column, key).select(
        key, F.lit(model.n).cast("long").alias("n"), "deviation", F.posexplode("whitened").alias("at", "whitened")
    ).select(
        key, (F.col("at") + 1).cast("int").alias("component"), "n", "deviation", "whitened",
        F.element_at(explained, F.col("at") + 1).alias("explained"), F.lit(error).alias("identity_error"),
    )
