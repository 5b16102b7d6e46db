"""Normal and gamma distribution helpers.

Normal quantiles at fixed levels are constants; gamma fits run as Arrow-batched numpy, because Spark
has no incomplete gamma function.
"""

from __future__ import annotations

from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

_NORMAL = NormalDist()


def z(q: float) -> float:
    return _NORMAL.inv_cdf(q)


def _digamma(x: np.ndarray) -> np.ndarray:
    out = np.zeros_like(x)
    y = x.copy()
    for _ in range(8):
        low = y < 8
        out = np.where(low, out - 1.0 / y, out)
        y = np.where(low, y + 1.0, y)
    r = 1.0 / (y * y)
    return out + np.log(y) - 0.5 / y - r * (1 / 12 - r * (1 / 120 - r * (1 / 252 - r * (1 / 240 - r / 132))))


def _trigamma(x: np.ndarray) -> np.ndarray:
    out = np.zeros_like(x)
    y = x.copy()
    for _ in range(8):
        low = y < 8
        out = np.where(low, out + 1.0 / (y * y), out)
        y = np.where(low, y + 1.0, y)
    r = 1.0 / (y * y)
    return out + 1.0 / y + 0.5 * r + r / y * (1 / 6 - r * (1 / 30 - r * (1 / 42 - r / 30)))


def gamma_shape(mean: np.ndarray, mean_log: np.ndarray) -> np.ndarray:
    """Maximum-likelihood shape with location 0, from the mean and the mean logarithm."""
    s = np.log(mean) - mean_log
    k = (3 - s + np.sqrt((s - 3) ** 2 + 24 * s)) / (12 * s)
    for _ in range(12):
        k = np.maximum(k - (np.log(k) - _digamma(k) - s) / (1 / k - _trigamma(k)), k / 10)
    return k


def _log_gamma(x: np.ndarray) -> np.ndarray:
    from math import lgamma

    return np.array([lgamma(v) for v in x])


def gamma_cdf(a: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Regularised lower incomplete gamma P(a, x): power series, or continued fraction for x > a + 1."""
    front = np.exp(a * np.log(x) - x - _log_gamma(a))
    term = 1.0 / a
    total = term.copy()
    n = a.copy()
    for _ in range(2000):
        n = n + 1
        term = term * x / n
        total = total + term
        if np.all(term <= total * 1e-16):
            break
    series = front * total
    tiny = 1e-300
    b = x + 1 - a
    c = np.full_like(x, 1 / tiny)
    d = 1 / np.where(np.abs(b) < tiny, tiny, b)
    h = d.copy()
    for i in range(1, 2000):
        an = -i * (i - a)
        b = b + 2
        d = an * d + b
        d = 1 / np.where(np.abs(d) < tiny, tiny, d)
        c = b + an / c
        c = np.where(np.abs(c) < tiny, tiny, c)
        h = h * d * c
        if np.all(np.abs(d * c - 1) < 1e-15):
            break
    return np.where(x <= a + 1, series, 1 - front * h)


def _cdf(x: pd.Series, shape: np.ndarray, scale: np.ndarray) -> np.ndarray:
    out = np.full(len(x), np.nan)
    v = x.to_numpy(float)
    with np.errstate(all="ignore"):
        ok = np.isfinite(v) & np.isfinite(shape) & np.isfinite(scale) & (v > 0) & (shape > 0) & (scale > 0)
        if ok.any():
            out[ok] = gamma_cdf(shape[ok], v[ok] / scale[ok])
    return out


@F.pandas_udf(DoubleType())
def gamma_probability(x: pd.Series, shape: pd.Series, scale: pd.Series) -> pd.Series:
    p = pd.Series(_cdf(x, shape.to_numpy(float), scale.to_numpy(float)))
    return p.astype(object).where(p.notna(), None)


@F.pandas_udf(DoubleType())
def fitted_gamma_score(x: pd.Series, mean: pd.Series, mean_log: pd.Series) -> pd.Series:
    """Normal quantile of x under the gamma fitted to (mean, mean log), clipped to [1e-6, 1 - 1e-6]."""
    m = mean.to_numpy(float)
    with np.errstate(all="ignore"):
        shape = gamma_shape(m, mean_log.to_numpy(float))
    p = np.clip(_cdf(x, shape, m / shape), 1e-6, 1 - 1e-6)
    return pd.Series([_NORMAL.inv_cdf(v) if v == v else None for v in p], dtype=object)


def normal_quantile(p: Column) -> Column:
    """Abramowitz & Stegun 26.2.23 rational approximation."""
    # Coefficients c0..c2 and d1..d3 of formula 26.2.23.
    c0, c1, c2 = 2.515517, 0.802853, 0.010328
    d1, d2, d3 = 1.432788, 0.189269, 0.001308
    t = F.sqrt(F.log(F.when(p < 0.5, p).otherwise(1 - p)) * -2.0)
    x = t - (F.lit(c0) + t * c1 + t * t * c2) / (F.lit(1.0) + t * d1 + t * t * d2 + t * t * t * d3)
    return F.when(p < 0.5, -x).otherwise(x)
