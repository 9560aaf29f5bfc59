"""Tail probabilities, in NumPy; for p-values of statistics that Spark has reduced to a row for each test."""

from __future__ import annotations

import functools
import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def _beta_fraction(a: float, b: float, x: float) -> float:
    """The continued fraction of the incomplete beta function, by the modified Lentz method."""
    tiny = 1e-300
    c, d = 1.0, 1.0 / (1 - (a + b) * x / (a + 1) or tiny)
    h = d
    for m in range(1, 500):
        for top in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1.0 / (1 + top * d or tiny)
            c = 1 + top / c or tiny
            h *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return h


def incomplete_beta(a: float, b: float, x: float) -> float:
    """The regularised incomplete beta function."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    return front * _beta_fraction(a, b, x) / a if x < (a + 1) / (a + b + 2) else 1 - front * _beta_fraction(b, a, 1 - x) / b


def t_two_sided(t: float, df: float) -> float:
    """Two-sided p of Student's t."""
    return incomplete_beta(df / 2, 0.5, df / (df + t * t))


def correlation_p(r: float, n: int) -> float:
    """Two-sided p of a rank correlation from the t distribution with n - 2 degrees of freedom."""
    if n < 3 or not math.isfinite(r):
        return math.nan
    return 0.0 if abs(r) >= 1 else t_two_sided(r * math.sqrt((n - 2) / ((1 - r) * (1 + r))), n - 2)


def normal_two_sided(z: float) -> float:
    """Two-sided p of a standard normal."""
    return math.erfc(abs(z) / math.sqrt(2))


@functools.lru_cache(64)
def _signed_rank_tails(n: int) -> np.ndarray:
    """P(W <= w) of the sum of positive ranks of ``n`` untied differences, for w from 0 to n (n + 1) / 2."""
    ways = np.ones(1)
    for rank in range(1, n + 1):
        # each rank is in the sum or not
        ways = np.pad(ways, (0, rank)) + np.pad(ways, (rank, 0))
    return np.cumsum(ways) / 2.0**n


def signed_rank_p(statistic: float, n: int) -> float:
    """Exact two-sided p of the smaller rank sum of ``n`` differences without zeros and ties."""
    return min(1.0, 2.0 * float(_signed_rank_tails(n)[int(statistic)]))


@F.pandas_udf(DoubleType())
def _signed_p(statistic: pd.Series, n: pd.Series, z: pd.Series, exact: pd.Series) -> pd.Series:
    return pd.Series([signed_rank_p(w, int(m)) if e else normal_two_sided(v) if pd.notna(v) else np.nan for w, m, v, e in zip(statistic, n, z, exact, strict=True)])


@F.pandas_udf(DoubleType())
def _correlation_p(r: pd.Series, n: pd.Series) -> pd.Series:
    return pd.Series([correlation_p(a, int(b)) if pd.notna(a) and pd.notna(b) else np.nan for a, b in zip(r, n, strict=True)])


@F.pandas_udf(DoubleType())
def _normal_p(z: pd.Series) -> pd.Series:
    return pd.Series([normal_two_sided(a) if pd.notna(a) else np.nan for a in z])


def p_of_correlation(r: Column, n: Column) -> Column:
    """p-values of correlations; the input is one row for each test."""
    return _correlation_p(r.cast("double"), n.cast("long"))


def p_of_z(z: Column) -> Column:
    """p-values of z statistics; the input is one row for each test."""
    return _normal_p(z.cast("double"))


def p_of_signed_ranks(statistic: Column, n: Column, z: Column, exact: Column) -> Column:
    """p-values of signed-rank tests, exact where ``exact`` says so, else those of z; the input is one row for each test."""
    p = _signed_p(statistic.cast("double"), n.cast("long"), z.cast("double"), exact.cast("boolean"))
    return F.when(~F.isnan(p), p)
