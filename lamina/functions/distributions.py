"""Student's t and normal distributions over whole columns: numpy in Arrow batches, as there is no expression for them."""

from __future__ import annotations

from math import lgamma, log, sqrt

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

TINY = 1e-300


def beta_fraction(a: float, b: float, x: np.ndarray, rounds: int = 300) -> np.ndarray:
    """The continued fraction of the incomplete beta function, by Lentz's method on all x at once."""
    c, d = np.ones_like(x), 1 - (a + b) * x / (a + 1)
    d = 1 / np.where(np.abs(d) < TINY, TINY, d)
    out = d.copy()
    for m in range(1, rounds):
        for top in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d, c = 1 + top * d, 1 + top / c
            d = 1 / np.where(np.abs(d) < TINY, TINY, d)
            c = np.where(np.abs(c) < TINY, TINY, c)
            out *= d * c
        if np.all(np.abs(d * c - 1) < 1e-14):
            break
    return out


def incomplete_beta(a: float, b: float, x: np.ndarray) -> np.ndarray:
    """Regularised; x outside 0..1 is clipped."""
    x = np.clip(np.asarray(x, float), 0, 1)
    front = np.exp(lgamma(a + b) - lgamma(a) - lgamma(b) + a * np.log(np.maximum(x, TINY)) + b * np.log(np.maximum(1 - x, TINY)))
    low = x < (a + 1) / (a + b + 2)
    out = np.where(low, front * beta_fraction(a, b, np.where(low, x, 0.0)) / a, 1 - front * beta_fraction(b, a, np.where(low, 0.0, 1 - x)) / b)
    return np.where(x <= 0, 0.0, np.where(x >= 1, 1.0, out))


def t_tail(t: np.ndarray, freedom: float) -> np.ndarray:
    """Two-tailed p of t."""
    t = np.asarray(t, float)
    return incomplete_beta(freedom / 2, 0.5, freedom / (freedom + t * t))


def z_tail(z: np.ndarray) -> np.ndarray:
    from math import erfc

    return np.vectorize(lambda v: erfc(abs(v) / sqrt(2)), otypes=[float])(np.asarray(z, float))


def inverse(tail, p: np.ndarray, most: float = 1e4) -> np.ndarray:
    """The x >= 0 with tail(x) = p, by bisection on all p at once."""
    p = np.asarray(p, float)
    lo, hi = np.zeros_like(p), np.full_like(p, most)
    for _ in range(int(log(most * 1e12, 2)) + 1):
        mid = (lo + hi) / 2
        above = tail(mid) > p
        lo, hi = np.where(above, mid, lo), np.where(above, hi, mid)
    return (lo + hi) / 2


def t_to_p(t: Column, freedom: float) -> Column:
    return F.pandas_udf(lambda x: pd.Series(t_tail(x.to_numpy(float), freedom)), "double")(t)


def p_to_t(p: Column, freedom: float) -> Column:
    return F.pandas_udf(lambda x: pd.Series(inverse(lambda v: t_tail(v, freedom), x.to_numpy(float))), "double")(p)


def z_to_p(z: Column) -> Column:
    return F.pandas_udf(lambda x: pd.Series(z_tail(x.to_numpy(float))), "double")(z)


def p_to_z(p: Column) -> Column:
    return F.pandas_udf(lambda x: pd.Series(inverse(z_tail, x.to_numpy(float), 40.0)), "double")(p)


def t_to_z(t: Column, freedom: float) -> Column:
    """The normal deviate of equal two-tailed probability, with t's sign."""

    def f(x: pd.Series) -> pd.Series:
        v = x.to_numpy(float)
        return pd.Series(np.sign(v) * inverse(z_tail, t_tail(v, freedom), 40.0))

    return F.pandas_udf(f, "double")(t)
