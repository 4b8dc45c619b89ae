"""What the operators on embeddings share: usable rows, their common length, Arrow columns as matrices, exact sums as pairs of doubles."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def finite(vector: Column) -> Column:
    """True for a vector that is there and has no null, NaN or infinite entry."""
    inf = F.lit(float("inf"))
    return F.coalesce(F.forall(vector, lambda c: F.coalesce(F.abs(c.cast("double")) < inf, F.lit(False))), F.lit(False))


def common_length(df: DataFrame, vector: str) -> int:
    """The length that most rows have (of several, the largest); 0 for an empty table. One row a length."""
    best = df.groupBy(F.size(vector).alias("d")).count().agg(F.max(F.struct("count", "d")).alias("m")).first()
    return best["m"]["d"] if best["m"] else 0


def matrix(column: pa.Array, d: int) -> np.ndarray:
    """An Arrow list column whose lists all have d entries, as rows of a matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def two_sum(a, b):
    """a + b as a rounded sum and its exact error."""
    s = a + b
    t = s - a
    return s, (a - (s - t)) + (b - t)


def two_product(a, b):
    """a * b as a rounded product and its exact error; factors are split into halves of 26 bits."""
    p = a * b
    ta, tb = a * 134217729.0, b * 134217729.0
    ah, bh = ta - (ta - a), tb - (tb - b)
    al, bl = a - ah, b - bh
    return p, ((ah * bh - p) + ah * bl + al * bh) + al * bl


def add(a, b):
    """Sum of two numbers that are (high, low) pairs of doubles."""
    s, e = two_sum(a[0], b[0])
    t, f = two_sum(a[1], b[1])
    s, e = two_sum(s, e + t)
    return two_sum(s, e + f)


def multiply(a, b):
    """Product of two numbers that are (high, low) pairs of doubles."""
    p, e = two_product(a[0], b[0])
    return two_sum(p, e + (a[0] * b[1] + a[1] * b[0]))


def total(pair):
    """Sum over the first axis of (high, low) pairs, in halves."""
    h, l = pair  # noqa: E741
    while len(h) > 1:
        half = len(h) // 2
        rest = (h[2 * half :], l[2 * half :])
        h, l = add((h[:half], l[:half]), (h[half : 2 * half], l[half : 2 * half]))  # noqa: E741
        h, l = np.concatenate([h, rest[0]]), np.concatenate([l, rest[1]])  # noqa: E741
    return h[0], l[0]
