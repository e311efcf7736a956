"""Vector arithmetic on array columns (higher-order functions, no Python)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from voxledger.functions.numbers import clip, col


def _add(s: Column, x: Column) -> Column:
    return s + x


def total(v: Column | str) -> Column:
    return F.aggregate(col(v), F.lit(0.0), lambda s, x: s + x.cast("double"))


def dot(a: Column | str, b: Column | str) -> Column:
    prods = F.zip_with(col(a), col(b), lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(prods, F.lit(0.0), _add)


def l2norm(v: Column | str) -> Column:
    return F.sqrt(dot(v, v))


def scaled(v: Column | str, by: Column, fn=lambda x, k: x / k) -> Column:
    """Apply ``fn(element, by)``; ``by`` is worked out once per row, not once per element."""
    one = F.transform(F.array(by), lambda k: F.transform(col(v), lambda x: fn(x.cast("double"), k)))
    return F.get(one, F.lit(0))


def l2_normalise(v: Column | str) -> Column:
    """Divide by the norm; a zero vector stays zero."""
    return scaled(v, F.greatest(l2norm(v), F.lit(1e-12)))


def cosine(a: Column | str, b: Column | str) -> Column:
    """Cosine; null where either vector is zero."""
    n = l2norm(a) * l2norm(b)
    return F.when(n > 0, dot(a, b) / F.nullif(n, F.lit(0.0)))


def cosine_pct(a: Column | str, b: Column | str) -> Column:
    """Cosine mapped to 0..100."""
    return clip((cosine(a, b) + 1.0) * 50.0, 0, 100)


def euclid(a: Column | str, b: Column | str) -> Column:
    sq = F.zip_with(
        col(a), col(b), lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))
    )
    return F.sqrt(F.aggregate(sq, F.lit(0.0), _add))


def mean_vector(v: str, size: int) -> Column:
    """Aggregate: element-wise mean, as ``size`` plain averages (map-side combined)."""
    return F.array(*[F.avg(F.get(F.col(v), i).cast("double")) for i in range(size)])


def var_vector(v: str, size: int) -> Column:
    return F.array(*[F.var_pop(F.get(F.col(v), i).cast("double")) for i in range(size)])
