"""Small column expressions shared by the operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F

# Clipping of probabilities before the logit, and the guard added to denominators.
LOGIT_EPS = 1e-6
DIV_EPS = 1e-10


def dbl(x: float) -> Column:
    return F.lit(float(x))


def clean(c: Column) -> Column:
    """NaN, infinities and nulls become 0."""
    return F.when(c.isNull() | F.isnan(c) | (F.abs(c) == F.lit(float("inf"))), dbl(0)).otherwise(c)


def no_nan(c: Column) -> Column:
    """NaN counts as missing."""
    return F.when(~F.isnan(c), c)


def logit(p: Column) -> Column:
    q = F.greatest(dbl(LOGIT_EPS), F.least(dbl(1 - LOGIT_EPS), p))
    return F.when(p.isNotNull(), F.ln(q / (dbl(1) - q)))


def wilson(p: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """Wilson interval, clipped to [0, 1]; (0, 0) when n is 0."""
    n = n.cast("double")
    safe = F.when(n > 0, n)
    denom = dbl(1) + dbl(z * z) / safe
    centre = (p + dbl(z * z) / (dbl(2) * safe)) / denom
    half = dbl(z) * F.sqrt(p * (dbl(1) - p) / safe + dbl(z * z) / (dbl(4) * safe * safe)) / denom
    # greatest/least skip nulls, so the empty case is settled here.
    lo = F.when(n > 0, F.greatest(dbl(0), centre - half)).otherwise(dbl(0))
    hi = F.when(n > 0, F.least(dbl(1), centre + half)).otherwise(dbl(0))
    return lo, hi


def wald(p: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """Normal-approximation interval, clipped to [0, 1]."""
    n = n.cast("double")
    half = dbl(z) * F.sqrt(F.greatest(p * (dbl(1) - p), dbl(0)) / F.when(n > 0, n))
    half = F.coalesce(half, dbl(0))
    return F.greatest(dbl(0), p - half), F.least(dbl(1), p + half)


def pooled_d(m0: Column, v0: Column, n0: Column, m1: Column, v1: Column, n1: Column) -> Column:
    """(m1 - m0) / pooled sample standard deviation; 0 when there is no spread, null when undefined."""
    pooled = F.sqrt(((n0 - 1) * v0 + (n1 - 1) * v1) / F.when(n0 + n1 > 2, n0 + n1 - 2))
    return F.when(pooled == 0, dbl(0)).otherwise((m1 - m0) / F.when(pooled != 0, pooled))


def grid_bucket(p: Column) -> Column:
    """Largest integer k with p >= k/100, immune to the rounding of p*100."""
    k = F.floor(p * 100)
    return (
        F.when(p >= (k + 1).cast("double") / 100.0, k + 1)
        .when(p < k.cast("double") / 100.0, k - 1)
        .otherwise(k)
        .cast("int")
    )


def first_match(c: Column, rules: Sequence[tuple[str, str]], other: str) -> Column:
    """Ordered regular expressions; the first that matches names the class."""
    out = None
    for name, pattern in rules:
        out = F.when(c.rlike(pattern), F.lit(name)) if out is None else out.when(c.rlike(pattern), F.lit(name))
    return out.otherwise(F.lit(other)) if out is not None else F.lit(other)


def logs_class(c: Column, rules, other: str = "other", unreadable: str = "unreadable") -> Column:
    """Class of a text log; a log that could not be read (null) is ``unreadable``."""
    return F.when(c.isNull(), F.lit(unreadable)).otherwise(first_match(c, rules, other))
