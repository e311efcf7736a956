"""Column expressions for numbers and text, all JVM-side."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: Column | str) -> Column:
    """A column, or SQL text; text is one call to the JVM however long it is."""
    return F.expr(c) if isinstance(c, str) else c


def _bits(n: int) -> list[int]:
    """Powers of two that add up to ``n``, largest first."""
    return [1 << i for i in range(n.bit_length() - 1, -1, -1) if n >> i & 1]


def round_sql(x: str, d: int = 0) -> str:
    """SQL text of ``round_dp``."""
    if d == 0:
        return f"(rint({x})+0D)"
    p = f"(({x})*{10**d}D)"
    *high, low = _bits(10**d)
    rest = p
    for bit in high:
        rest = f"({rest}-({x})*{bit}D)"
    lost = f"(({x})*{low}D-{rest})"
    return (
        f"((CASE WHEN abs({p}-rint({p})) < 0.5D THEN rint({p}) "
        f"ELSE coalesce({p}+nullif(signum({lost}),0D)*0.5D, rint({p})) END)/{10**d}D+0D)"
    )


def round_dp(x: Column | str, d: int = 0) -> Column:
    """Round a double to ``d`` places by its exact binary value, ties to even.

    ``F.round`` rounds the printed decimal half up, which disagrees with IEEE
    rounding on values such as 0.125 or 2.675.  The product p = x*10^d may land
    on .5 only by its own rounding; what it lost is found by taking the powers
    of two in 10^d off again one by one, each step of which is exact.
    """
    if isinstance(x, str):
        return F.expr(round_sql(f"CAST({x} AS DOUBLE)", d))
    x = x.cast("double")
    if d == 0:
        return F.rint(x) + F.lit(0.0)
    b = F.lit(float(10**d))
    p = x * b
    *high, low = _bits(10**d)
    rest = p
    for bit in high:
        rest = rest - x * F.lit(float(bit))
    lost = x * F.lit(float(low)) - rest
    tie = F.coalesce(p + F.nullif(F.signum(lost), F.lit(0.0)) * F.lit(0.5), F.rint(p))
    return F.when(F.abs(p - F.rint(p)) < 0.5, F.rint(p)).otherwise(tie) / b + F.lit(0.0)


def clip(x: Column | str, lo: float, hi: float) -> Column:
    """Limit to [lo, hi]; null stays null."""
    x = col(x)
    return F.when(x.isNotNull(), F.greatest(F.lit(float(lo)), F.least(F.lit(float(hi)), x)))


def fixed(x: Column | str, d: int) -> Column:
    """Text with exactly ``d`` decimals, rounded as ``round_dp``; null stays null."""
    r = round_dp(x, d)
    return F.when(r.isNotNull(), F.format_string(f"%.{d}f", r))


def ladder(x: Column | str, steps: Sequence[tuple[float, object]], below: object) -> Column:
    """Value of the first step whose lower bound is reached, else ``below``."""
    if isinstance(x, str):
        whens = " ".join(f"WHEN {x} >= {float(bound)}D THEN '{value}'" for bound, value in steps)
        return F.expr(f"CASE {whens} ELSE '{below}' END")
    out = None
    for bound, value in steps:
        cond = x >= F.lit(float(bound))
        out = F.when(cond, F.lit(value)) if out is None else out.when(cond, F.lit(value))
    return out.otherwise(F.lit(below))


def named(key: str, names: dict[str, str]) -> Column:
    """Look a text up in a fixed table; null where it is not listed."""
    whens = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in names.items())
    return F.expr(f"CASE {key} {whens} END")


def present(*items: Column) -> Column:
    """Array of the non-null items, in order."""
    return F.filter(F.array(*items), lambda s: s.isNotNull())


def linear_similarity(
    pairs: Sequence[tuple[Column | str, Column | str]],
    tolerances: Sequence[float],
    weights: Sequence[float],
) -> Column:
    """Sum of weight * max(0, 1 - |a-b|/tolerance)."""
    total = None
    for (a, b), tol, w in zip(pairs, tolerances, weights, strict=True):
        near = F.greatest(F.lit(0.0), F.lit(1.0) - F.abs(col(a) - col(b)) / F.lit(float(tol)))
        total = near * F.lit(w) if total is None else total + near * F.lit(w)
    return total


def weighted_mean_present(weights: dict[str, float]) -> Column:
    """Weighted mean over the non-null columns; weights renormalised."""
    num = " + ".join(f"coalesce({c} * {w}D, 0D)" for c, w in weights.items())
    den = " + ".join(f"if({c} IS NULL, 0D, {w}D)" for c, w in weights.items())
    return F.expr(f"coalesce(({num}) / nullif({den}, 0D), 0D)")
