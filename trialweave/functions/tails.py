"""Tail probabilities of already aggregated statistics, as vectorised UDFs on small result tables."""

from __future__ import annotations

import math
import sys

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import functions as F
from pyspark.sql import types as T

if __name__ in sys.modules:
    # Ship this module with the UDFs, so that workers need not be able to import the package.
    cloudpickle.register_pickle_by_value(sys.modules[__name__])


def _each(fn, x) -> np.ndarray:
    x = np.asarray(x, dtype=float)
    return np.array([fn(v) for v in x.ravel()], dtype=float).reshape(x.shape)


def normal_two_sided(z: np.ndarray) -> np.ndarray:
    return 1.0 - _each(math.erf, np.abs(z) / math.sqrt(2.0))


def beta_inc(a, b, x) -> np.ndarray:
    """Regularised incomplete beta function by its continued fraction."""
    a, b, x = (np.array(v, dtype=float, copy=True) for v in np.broadcast_arrays(a, b, x))
    swap = x > (a + 1) / (a + b + 2)
    a2, b2, x2 = np.where(swap, b, a), np.where(swap, a, b), np.where(swap, 1 - x, x)
    tiny = 1e-300
    c = np.ones_like(x2)
    d = 1 - (a2 + b2) * x2 / (a2 + 1)
    d = 1 / np.where(np.abs(d) < tiny, tiny, d)
    h = d.copy()
    m, moved = 0, True
    while moved:  # about the root of the larger parameter in steps
        m += 1
        moved = False
        for num in (
            m * (b2 - m) * x2 / ((a2 + 2 * m - 1) * (a2 + 2 * m)),
            -(a2 + m) * (a2 + b2 + m) * x2 / ((a2 + 2 * m) * (a2 + 2 * m + 1)),
        ):
            d = 1 + num * d
            d = 1 / np.where(np.abs(d) < tiny, tiny, d)
            c = 1 + num / c
            c = np.where(np.abs(c) < tiny, tiny, c)
            h = h * c * d
            moved = bool(np.any(np.abs(c * d - 1) > 1e-15))
    with np.errstate(divide="ignore", invalid="ignore"):
        logs = a2 * np.log(x2) + b2 * np.log1p(-x2)
    norm = _each(math.lgamma, a2 + b2) - _each(math.lgamma, a2) - _each(math.lgamma, b2)
    front = np.where((x2 <= 0) | (x2 >= 1), 0.0, np.exp(logs + norm)) / a2
    val = np.where(x2 >= 1, 1.0, front * h)
    return np.where(swap, 1 - val, val)


#: From here on the uniform expansion of the gamma tail is good to about 1e-11.
LARGE_SHAPE = 1e5


def _gamma_tail_large(a: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Leading terms of the uniform asymptotic expansion in the shape."""
    ratio = x / a
    gap = ratio - 1
    near = np.abs(gap) < 1e-3
    with np.errstate(divide="ignore", invalid="ignore"):
        half = np.where(near, gap**2 / 2 - gap**3 / 3 + gap**4 / 4, gap - np.log(ratio))
        eta = np.sign(gap) * np.sqrt(2 * np.maximum(half, 0))
        first = np.where(near, -1 / 3 + eta / 12, 1 / gap - 1 / eta)
        body = _each(math.erfc, eta * np.sqrt(a / 2)) / 2
        return np.clip(body + np.exp(-a * eta**2 / 2) / np.sqrt(2 * math.pi * a) * first, 0.0, 1.0)


def gamma_tail(a, x) -> np.ndarray:
    """Upper regularised incomplete gamma function: series below a + 1, continued fraction above, expansion for large shapes."""
    a, x = (np.array(v, dtype=float, copy=True) for v in np.broadcast_arrays(a, x))
    large = (a > LARGE_SHAPE) & (x > 0)
    tail = _gamma_tail_large(np.where(large, a, 1.0), np.where(large, x, 1.0))
    a = np.where(large, 1.0, a)
    safe = np.where((x > 0) & ~large, x, 1.0)
    front = np.exp(-safe + a * np.log(safe) - _each(math.lgamma, a))
    term = 1 / a
    total = term.copy()
    n = 0
    below = safe < a + 1
    while np.any(below & (term > 1e-17 * total)):
        n += 1
        term = term * safe / (a + n)
        total = total + term
    low = 1 - front * total
    tiny = 1e-300
    b = np.where(below, a + 2, safe) + 1 - a  # rows of the series take no part
    c = np.full_like(b, 1 / tiny)
    d = 1 / np.where(np.abs(b) < tiny, tiny, b)
    h = d.copy()
    i, moved = 0, True
    while moved:
        i += 1
        an = -i * (i - a)
        b = b + 2
        d = an * d + b
        d = 1 / np.where(np.abs(d) < tiny, tiny, d)
        c = b + an / c
        c = np.where(np.abs(c) < tiny, tiny, c)
        h = h * d * c
        moved = bool(np.any(np.abs(c * d - 1) > 1e-15))
    return np.where(large, tail, np.where(x <= 0, 1.0, np.where(below, low, front * h)))


def _rank_sum_tail(n1: int, n2: int, u: int) -> float:
    """Share of arrangements whose U is at most ``u``: coefficients of the Gaussian binomial up to that power."""
    ways = np.zeros(u + 1)
    ways[0] = 1
    for i in range(1, n1 + 1):
        if n2 + i <= u:
            ways[n2 + i :] = ways[n2 + i :] - ways[: -(n2 + i)]
        for r in range(min(i, u + 1)):
            ways[r::i] = np.cumsum(ways[r::i])
    return float(ways.sum() / math.comb(n1 + n2, n1))


def mann_whitney_p(u, n1, n2, ties, method: str = "auto") -> np.ndarray:
    """Two-sided p: ``exact`` counts arrangements, ``normal`` corrects for ties and continuity; ``auto`` is exact when the smaller
    sample has eight values at most and there are no ties."""
    u, n1, n2, ties = (np.asarray(v, dtype=float) for v in (u, n1, n2, ties))
    big = np.maximum(u, n1 * n2 - u)
    n = n1 + n2
    with np.errstate(divide="ignore", invalid="ignore"):
        sd = np.sqrt(n1 * n2 / 12 * ((n + 1) - ties / (n * (n - 1))))
        z = (big - n1 * n2 / 2 - 0.5) / sd
    p = np.minimum(1.0, normal_two_sided(np.maximum(z, 0)))
    exact = (n1 > 0) & (n2 > 0)
    if method == "auto":
        exact &= (np.minimum(n1, n2) <= 8) & (ties == 0)
    for i in np.flatnonzero(exact) if method != "normal" else []:
        below = int(n1[i] * n2[i] - math.ceil(big[i]))
        p[i] = min(1.0, 2 * _rank_sum_tail(min(int(n1[i]), int(n2[i])), max(int(n1[i]), int(n2[i])), below))
    return np.where(np.isfinite(sd) & (sd > 0), p, np.nan)


@F.pandas_udf(T.DoubleType())
def p_mann_whitney(u: pd.Series, n1: pd.Series, n2: pd.Series, ties: pd.Series) -> pd.Series:
    return pd.Series(mann_whitney_p(u, n1, n2, ties))


@F.pandas_udf(T.DoubleType())
def p_student(t: pd.Series, df: pd.Series) -> pd.Series:
    t, df = t.astype(float).to_numpy(), df.astype(float).to_numpy()
    with np.errstate(invalid="ignore"):
        return pd.Series(np.where(df > 0, beta_inc(np.maximum(df, 1) / 2, 0.5, df / (df + t * t)), np.nan))


@F.pandas_udf(T.DoubleType())
def p_f(f: pd.Series, d1: pd.Series, d2: pd.Series) -> pd.Series:
    f, d1, d2 = (s.astype(float).to_numpy() for s in (f, d1, d2))
    return pd.Series(beta_inc(d2 / 2, d1 / 2, d2 / (d2 + d1 * f)))


@F.pandas_udf(T.DoubleType())
def p_chi2(x: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series(gamma_tail(df.astype(float).to_numpy() / 2, x.astype(float).to_numpy() / 2))


@F.pandas_udf(T.DoubleType())
def p_normal(z: pd.Series) -> pd.Series:
    return pd.Series(normal_two_sided(z.astype(float).to_numpy()))
