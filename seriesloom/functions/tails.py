"""Upper tail probabilities of the normal, chi-square, F and t laws.

Spark has no error or incomplete beta function, so these are Arrow-batched pandas
functions. They run on result rows (one per test), never on raw observations.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _each(fn, x) -> np.ndarray:
    x = np.asarray(x, float)
    return np.array([fn(v) for v in x.ravel()]).reshape(x.shape)


def _lgamma(x) -> np.ndarray:
    return _each(math.lgamma, x)


def _erfc(x) -> np.ndarray:
    return _each(math.erfc, x)


def beta_cdf(x: np.ndarray, a: np.ndarray, b: np.ndarray, steps: int = 400) -> np.ndarray:
    """Regularised incomplete beta function by its continued fraction (modified Lentz)."""
    x, a, b = (np.asarray(v, float) for v in np.broadcast_arrays(x, a, b))
    flip = x > (a + 1.0) / (a + b + 2.0)
    xx, aa, bb = np.where(flip, 1 - x, x), np.where(flip, b, a), np.where(flip, a, b)
    tiny = 1e-300
    with np.errstate(all="ignore"):
        front = np.exp(_lgamma(aa + bb) - _lgamma(aa) - _lgamma(bb) + aa * np.log(xx) + bb * np.log1p(-xx)) / aa
        c = np.ones_like(xx)
        d = 1.0 - (aa + bb) * xx / (aa + 1.0)
        d = 1.0 / np.where(np.abs(d) < tiny, tiny, d)
        h = d.copy()
        for m in range(1, steps):
            even = m * (bb - m) * xx / ((aa + 2 * m - 1) * (aa + 2 * m))
            odd = -(aa + m) * (aa + bb + m) * xx / ((aa + 2 * m) * (aa + 2 * m + 1))
            for coef in (even, odd):
                d = 1.0 + coef * d
                d = 1.0 / np.where(np.abs(d) < tiny, tiny, d)
                c = 1.0 + coef / c
                c = np.where(np.abs(c) < tiny, tiny, c)
                step = d * c
                h = h * step
            if np.all(np.abs(step[np.isfinite(step)] - 1.0) < 1e-15):
                break
        out = front * h
    out = np.where(flip, 1.0 - out, out)
    return np.where(x <= 0, 0.0, np.where(x >= 1, 1.0, out))


def gamma_tail(a: np.ndarray, x: np.ndarray, steps: int = 2000) -> np.ndarray:
    """Regularised upper incomplete gamma: series below ``a + 1``, continued fraction above."""
    a, x = (np.asarray(v, float) for v in np.broadcast_arrays(a, x))
    tiny = 1e-300
    with np.errstate(all="ignore"):
        front = np.exp(a * np.log(x) - x - _lgamma(a))
        term = 1.0 / a
        total = term.copy()
        for i in range(1, steps):
            term = term * x / (a + i)
            total = total + term
            if np.nanmax(np.where(x < a + 1, np.abs(term / total), 0.0), initial=0.0) < 1e-16:
                break
        lower = front * total
        b = x + 1.0 - a
        c = np.full_like(x, 1.0 / tiny)
        d = 1.0 / np.where(b == 0, tiny, b)
        h = d.copy()
        for i in range(1, steps):
            coef = -i * (i - a)
            b = b + 2.0
            d = coef * d + b
            d = 1.0 / np.where(np.abs(d) < tiny, tiny, d)
            c = b + coef / c
            c = np.where(np.abs(c) < tiny, tiny, c)
            h = h * d * c
            if np.nanmax(np.where(x >= a + 1, np.abs(d * c - 1.0), 0.0), initial=0.0) < 1e-15:
                break
        upper = front * h
    return np.where(x <= 0, 1.0, np.where(x < a + 1, 1.0 - lower, upper))


def normal_tail(z: np.ndarray) -> np.ndarray:
    return 0.5 * _erfc(np.asarray(z, float) / math.sqrt(2.0))


def t_tail(t: np.ndarray, df: np.ndarray) -> np.ndarray:
    t, df = np.broadcast_arrays(np.asarray(t, float), np.asarray(df, float))
    half = 0.5 * beta_cdf(df / (df + t * t), df / 2.0, np.full_like(df, 0.5))
    return np.where(t >= 0, half, 1.0 - half)


def f_tail(f: np.ndarray, df1: np.ndarray, df2: np.ndarray) -> np.ndarray:
    f, df1, df2 = np.broadcast_arrays(*(np.asarray(v, float) for v in (f, df1, df2)))
    return np.where(f <= 0, 1.0, beta_cdf(df2 / (df2 + df1 * f), df2 / 2.0, df1 / 2.0))


def _guarded(fn, x: pd.Series, *dfs: pd.Series) -> pd.Series:
    """Apply a tail to the rows with a statistic and positive degrees of freedom; NULL elsewhere."""
    usable = x.notna().to_numpy()
    for df in dfs:
        usable &= (df.fillna(0.0) > 0).to_numpy()
    out = np.full(len(x), None, dtype=object)
    if usable.any():
        out[usable] = fn(x[usable].to_numpy(float), *(d[usable].to_numpy(float) for d in dfs))
    return pd.Series(out)


@F.pandas_udf(T.DoubleType())
def normal_sf(z: pd.Series) -> pd.Series:
    return _guarded(normal_tail, z)


@F.pandas_udf(T.DoubleType())
def chi2_sf(x: pd.Series, df: pd.Series) -> pd.Series:
    return _guarded(lambda v, d: gamma_tail(d / 2.0, v / 2.0), x, df)


@F.pandas_udf(T.DoubleType())
def t_sf(t: pd.Series, df: pd.Series) -> pd.Series:
    return _guarded(t_tail, t, df)


@F.pandas_udf(T.DoubleType())
def f_sf(f: pd.Series, df1: pd.Series, df2: pd.Series) -> pd.Series:
    return _guarded(f_tail, f, df1, df2)
