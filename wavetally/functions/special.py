"""Tail probabilities for test statistics, one value per compared group.

They see one row per kernel, never telemetry rows, so they run as small Arrow
functions after the aggregates.
"""

from __future__ import annotations

import functools
import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function, evaluated from the
    far end with the number of terms fixed by its convergence."""
    terms = int(60 + 3 * math.sqrt(max(a, b)))
    tail = 0.0
    for m in range(terms, 0, -1):
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        tail = even / (1.0 + odd / (1.0 + tail))
    first = -(a + b) * x / (a + 1.0)
    return 1.0 / (1.0 + first / (1.0 + tail))


def beta_inc(a: float, b: float, x: float) -> float:
    """Regularized incomplete beta function."""
    if x <= 0.0:
        return 0.0
    if x >= 1.0:
        return 1.0
    if x > (a + 1.0) / (a + b + 2.0):
        return 1.0 - beta_inc(b, a, 1.0 - x)
    log_front = math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)
    return math.exp(log_front) * _beta_fraction(a, b, x) / a


def t_two_sided(t: float, df: float) -> float:
    """P(|T| >= |t|) of Student's t."""
    if t is None or df is None or math.isnan(t) or math.isnan(df):
        return math.nan
    if math.isinf(t):
        return 0.0
    return beta_inc(df / 2.0, 0.5, df / (df + t * t))


def t_quantile(p: float, df: float) -> float:
    """Upper quantile for p > 0.5, by bisection on the two-sided tail."""
    lo, hi = 0.0, 1.0
    goal = 2.0 * (1.0 - p)
    while t_two_sided(hi, df) > goal:
        hi *= 2.0
    for _ in range(200):
        mid = (lo + hi) / 2.0
        if t_two_sided(mid, df) > goal:
            lo = mid
        else:
            hi = mid
        if hi - lo <= 1e-14 * hi:
            break
    return (lo + hi) / 2.0


def normal_two_sided(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2.0))


def kolmogorov_tail(lam: float) -> float:
    """Limit distribution of the two-sample distance."""
    if lam < 0.2:
        return 1.0
    total = sum((-1) ** (k - 1) * math.exp(-2.0 * (k * lam) ** 2) for k in range(1, 101))
    return min(1.0, max(0.0, 2.0 * total))


# Sample sizes up to which a test takes its exact distribution: the smaller sample of a rank test without ties, the larger of a
# distance of two distribution curves. Fixed values.
EXACT_RANKS = 8
EXACT_PATHS = 10_000


@functools.cache
def _partition_counts(m: int) -> tuple[int, list[int]]:
    """Counting sums of parts 1, 1, 2, ..., m: the period L of the count, and the numerator over (1 - q^L)^(m + 1)."""
    period = math.lcm(*range(1, m + 1))
    numerator = [1]
    for part in (1, *range(1, m + 1)):
        out = [0] * (len(numerator) + period - part)
        for k in range(0, period, part):
            for i, v in enumerate(numerator):
                out[i + k] += v
        numerator = out
    return period, numerator


def _partitions_up_to(k: int, m: int) -> int:
    """Number of ways to write the numbers 0 to ``k`` as sums of parts 1 to ``m``."""
    if k < 0:
        return 0
    period, numerator = _partition_counts(m)
    first = k % period
    return sum(numerator[r] * math.comb((k - r) // period + m, m) for r in range(first, min(k + 1, len(numerator)), period))


def rank_test_exact(u: float, n1: int, n2: int) -> float:
    """Two-sided probability of a rank sum test without ties, for any sizes of which the smaller is small.

    Rank sums below a bound are partitions into at most ``m`` parts of at most ``n``; those with parts that are too large are
    taken out by inclusion and exclusion. The work depends on ``m`` alone."""
    m, n = sorted((n1, n2))
    low = int(min(u, m * n - u))
    count = 0
    for large in range(1 << m):
        chosen = [i + 1 for i in range(m) if large >> i & 1]
        ways = _partitions_up_to(low - sum(chosen) - len(chosen) * n, m)
        count += -ways if len(chosen) % 2 else ways
    return min(1.0, 2 * count / math.comb(m + n, m))


def distance_exact(d: float, n1: int, n2: int) -> float:
    """Probability that two samples of one distribution are at least ``d`` apart.

    A way through the ordered samples steps to the right for one and up for the other. Step by step, the share of all ways that has
    come as far as ``d`` apart leaves; shares only add up, so small probabilities are exact as well."""
    bound = round(d * n1 * n2)
    i = np.arange(n1 + 1)
    inside, gone = np.zeros(n1 + 1), 0.0
    inside[0] = 1.0
    for s in range(n1 + n2):
        left = n1 + n2 - s
        right = inside * (n1 - i) / left
        inside = inside * np.maximum(n2 - (s - i), 0) / left
        inside[1:] += right[:-1]
        out = np.abs(i * n2 - (s + 1 - i) * n1) >= bound
        gone += float(inside[out].sum())
        inside[out] = 0.0
    return min(1.0, gone)


@F.pandas_udf(T.DoubleType())
def rank_test_pvalue(z: pd.Series, u: pd.Series, n1: pd.Series, n2: pd.Series, ties: pd.Series) -> pd.Series:
    """Exact where one sample is small and nothing is tied, else the normal limit."""

    def one(z, u, a, b, tied):
        if pd.isna(z):
            return None
        if 0 < min(a, b) <= EXACT_RANKS and tied == 0:
            return rank_test_exact(u, int(a), int(b))
        return normal_two_sided(z)

    return pd.Series([one(*r) for r in zip(z, u, n1, n2, ties)], dtype="float64")


@F.pandas_udf(T.DoubleType())
def distance_pvalue(d: pd.Series, n1: pd.Series, n2: pd.Series) -> pd.Series:
    """Exact for samples that are not large, else the limit distribution."""

    def one(d, a, b):
        if pd.isna(d):
            return None
        if max(a, b) <= EXACT_PATHS:
            return distance_exact(d, int(a), int(b))
        return kolmogorov_tail(math.sqrt(a * b / (a + b)) * d)

    return pd.Series([one(*r) for r in zip(d, n1, n2)], dtype="float64")


@F.pandas_udf(T.DoubleType())
def t_pvalue(t: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series([None if pd.isna(a) or pd.isna(b) else t_two_sided(a, b) for a, b in zip(t, df)], dtype="float64")


@F.pandas_udf(T.DoubleType())
def t_critical(p: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series(
        [None if pd.isna(b) or b < 1 else t_quantile(a, b) for a, b in zip(p, df)], dtype="float64"
    )


@F.pandas_udf(T.DoubleType())
def normal_pvalue(z: pd.Series) -> pd.Series:
    return z.map(lambda v: None if pd.isna(v) else normal_two_sided(v)).astype("float64")

