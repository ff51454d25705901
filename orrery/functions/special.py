"""Special functions in numpy, as pandas UDFs where a column needs them."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

_log_gamma = np.vectorize(math.lgamma, otypes=[float])


def incomplete_beta(x: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Regularised incomplete beta function, by its continued fraction."""
    x, a, b = (np.asarray(v, float) for v in np.broadcast_arrays(x, a, b))
    inside = np.clip(x, 1e-300, 1 - 1e-16)
    swap = inside > (a + 1) / (a + b + 2)
    p, q, z = np.where(swap, b, a), np.where(swap, a, b), np.where(swap, 1 - inside, inside)
    front = np.exp(_log_gamma(p + q) - _log_gamma(p) - _log_gamma(q) + p * np.log(z) + q * np.log1p(-z)) / p
    tiny = 1e-300
    c, d = np.ones_like(z), 1 - (p + q) * z / (p + 1)
    d = 1 / np.where(np.abs(d) < tiny, tiny, d)
    h = d.copy()
    for m in range(1, 300):
        for t in (m * (q - m) * z / ((p + 2 * m - 1) * (p + 2 * m)), -(p + m) * (p + q + m) * z / ((p + 2 * m) * (p + 2 * m + 1))):
            d = 1 + t * d
            d = 1 / np.where(np.abs(d) < tiny, tiny, d)
            c = 1 + t / c
            c = np.where(np.abs(c) < tiny, tiny, c)
            h = h * c * d
        if np.all(np.abs(c * d - 1) < 1e-14):
            break
    out = np.where(swap, 1 - front * h, front * h)
    return np.where(x <= 0, 0.0, np.where(x >= 1, 1.0, out))


def beta_quantile(p: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Quantile of the Beta distribution, by bisection."""
    p, a, b = (np.asarray(v, float) for v in np.broadcast_arrays(p, a, b))
    lo, hi = np.zeros_like(p), np.ones_like(p)
    for _ in range(60):
        mid = (lo + hi) / 2
        under = incomplete_beta(mid, a, b) < p
        lo, hi = np.where(under, mid, lo), np.where(under, hi, mid)
    return (lo + hi) / 2


def incomplete_gamma(a: float, x: float) -> float:
    """Regularised lower incomplete gamma function."""
    if x <= 0:
        return 0.0
    front = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        n = a
        while abs(term) > abs(total) * 1e-15:
            n += 1
            term *= x / n
            total += term
        return front * total
    b, c, d = x + 1 - a, 1e300, 1 / (x + 1 - a)
    h = d
    for i in range(1, 500):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b)
        c = b + an / c
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return 1 - front * h


def chi_square_tail(x: float, k: float) -> float:
    """Probability of a chi-square of k degrees over x."""
    return 1 - incomplete_gamma(k / 2, x / 2)


@F.pandas_udf(DoubleType())
def beta_cdf(x: pd.Series, a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series(incomplete_beta(x.to_numpy(), a.to_numpy(), b.to_numpy()))


@F.pandas_udf(DoubleType())
def beta_ppf(p: pd.Series, a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series(beta_quantile(p.to_numpy(), a.to_numpy(), b.to_numpy()))


@F.pandas_udf(DoubleType())
def chi_tail(x: pd.Series, k: pd.Series) -> pd.Series:
    return pd.Series([chi_square_tail(a, b) for a, b in zip(x, k)])
