"""Quantiles and tail probabilities for already aggregated rows.

Only one value per group reaches these Arrow functions; the sums behind them are native.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

_TINY = 1e-300


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function (modified Lentz evaluation)."""
    c, d = 1.0, 1.0 / max(abs(1.0 - (a + b) * x / (a + 1.0)), _TINY)
    out = d
    for m in range(1, 500):
        for top in (
            m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
            -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)),
        ):
            d = 1.0 + top * d
            c = 1.0 + top / c
            d = 1.0 / (d if abs(d) > _TINY else _TINY)
            c = c if abs(c) > _TINY else _TINY
            out *= c * d
        if abs(c * d - 1.0) < 1e-15:
            break
    return out


def regularized_beta(a: float, b: float, x: float) -> float:
    if x <= 0.0:
        return 0.0
    if x >= 1.0:
        return 1.0
    front = math.exp(
        math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)
    )
    if x < (a + 1.0) / (a + b + 2.0):
        return front * _beta_fraction(a, b, x) / a
    return 1.0 - front * _beta_fraction(b, a, 1.0 - x) / b


def t_cdf(t: float, df: float) -> float:
    tail = 0.5 * regularized_beta(df / 2.0, 0.5, df / (df + t * t))
    return 1.0 - tail if t > 0 else tail


@lru_cache(maxsize=4096)
def t_quantile(p: float, df: float) -> float:
    """Student t quantile by bisection on the distribution function."""
    if p == 0.5:
        return 0.0
    if p < 0.5:
        return -t_quantile(1.0 - p, df)
    low, high = 0.0, 1.0
    while t_cdf(high, df) < p:
        high *= 2.0
    for _ in range(200):
        mid = 0.5 * (low + high)
        if t_cdf(mid, df) < p:
            low = mid
        else:
            high = mid
    return 0.5 * (low + high)


@F.pandas_udf(T.DoubleType())
def t_half_width_factor(df: pd.Series) -> pd.Series:
    """The factor of the standard error in a two-sided 95 % interval; NULL below one degree."""
    return df.map(lambda v: t_quantile(0.975, float(v)) if pd.notna(v) and v >= 1 else None)


@lru_cache(maxsize=64)
def _signed_rank_counts(n: int) -> tuple[float, ...]:
    """How many sign patterns of ranks 1..n give each sum of positive ranks."""
    ways = np.zeros(n * (n + 1) // 2 + 1)
    ways[0] = 1.0
    for rank in range(1, n + 1):
        moved = np.zeros_like(ways)
        moved[rank:] = ways[:-rank]
        ways = ways + moved
    return tuple(ways)


def signed_rank_p(w_plus: float, n: int, tie_term: float, exact: bool) -> float:
    """Two-sided p of the signed-rank statistic; exact null only for small n without ties."""
    if n == 0:
        return float("nan")
    low = min(w_plus, n * (n + 1) / 2 - w_plus)
    if exact:
        ways = _signed_rank_counts(n)
        return min(1.0, 2.0 * sum(ways[: int(low) + 1]) / 2.0**n)
    mean = n * (n + 1) / 4.0
    variance = (n * (n + 1) * (2 * n + 1) - tie_term / 2.0) / 24.0
    if variance <= 0:
        return float("nan")
    return math.erfc(abs(low - mean) / math.sqrt(variance) / math.sqrt(2.0))


@F.pandas_udf(T.DoubleType())
def signed_rank_p_value(w_plus: pd.Series, n: pd.Series, tie_term: pd.Series, n_zero: pd.Series) -> pd.Series:
    out = []
    for w, k, t, z in zip(w_plus, n, tie_term, n_zero):
        if pd.isna(w) or pd.isna(k):
            out.append(None)
            continue
        exact = k <= 50 and t == 0 and z == 0
        p = signed_rank_p(float(w), int(k), float(t), exact)
        out.append(None if math.isnan(p) else p)
    return pd.Series(out, dtype="float64")
