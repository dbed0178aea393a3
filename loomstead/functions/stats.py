"""Interval and paired-test statistics as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def wilson(k: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """The Wilson interval of k of n, within [0, 1]; (0, 0) for n = 0."""
    k, n = k.cast("double"), n.cast("double")
    p = k / F.nullif(n, F.lit(0.0))
    den = 1 + z * z / F.nullif(n, F.lit(0.0))
    mid = (p + z * z / (2 * F.nullif(n, F.lit(0.0)))) / den
    half = z * F.sqrt((p * (1 - p) + z * z / (4 * F.nullif(n, F.lit(0.0)))) / F.nullif(n, F.lit(0.0))) / den
    zero = F.lit(0.0)
    return F.coalesce(F.greatest(zero, mid - half), zero), F.coalesce(F.least(F.lit(1.0), mid + half), zero)


def mcnemar(b: str, c: str) -> Column:
    """The exact two-sided p-value of discordant counts (column names); null if there are none.

    Summed downwards from the largest term, with its logarithm, so that large
    counts neither overflow nor vanish. Terms are summed until they vanish:
    some nine times the root of the counts, and no more of them than there are.
    """
    n, k = f"cast({b} + {c} as bigint)", f"cast(least({b}, {c}) as bigint)"
    top = f"{_ln_factorial(n)} - {_ln_factorial(k)} - {_ln_factorial(f'({n} - {k})')} - {n} * ln(2D)"
    most = f"least({k}, cast(9 * sqrt({n}) as bigint) + 100)"
    rest = f"aggregate(sequence(0L, {most}), named_struct('t', 1D, 's', 0D), (a, i) -> named_struct('t', a.t * cast({k} - i as double) / cast({n} - {k} + i + 1 as double), 's', a.s + a.t), a -> a.s)"
    return F.expr(f"if({n} = 0, null, least(1D, 2D * exp({top}) * {rest}))")


def _ln_factorial(x: str) -> str:
    """SQL for ln(x!): a sum for small x, Stirling's series beyond, where its error is below that of a double."""
    large = f"(({x} + 0.5D) * ln({x}) - {x} + 0.91893853320467274178D + 1D / (12D * {x}) - 1D / (360D * pow({x}, 3)) + 1D / (1260D * pow({x}, 5)))"
    return f"if({x} < 64, aggregate(sequence(1L, greatest(1L, least(64L, {x}))), 0D, (s, i) -> s + ln(cast(i as double))), {large})"


def ratio(a: Column, b: Column, empty: float = 0.0) -> Column:
    """a / b, or ``empty`` where b is zero."""
    return F.when(b == 0, F.lit(empty)).otherwise(a.cast("double") / F.when(b != 0, b))


def f1(p: Column, r: Column, empty: float = 0.0) -> Column:
    return F.when(p + r == 0, F.lit(empty)).otherwise(2 * p * r / F.when(p + r != 0, p + r))
