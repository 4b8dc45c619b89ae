"""Whitening of embeddings by a compensated covariance.

Entries become whole numbers, so sums are exact. Centred outer products are accumulated in each task as pairs of doubles
(error-free sums and products); the tasks' high and low parts are merged by a tree of additions of at most FAN rows a group.
The eigenvectors come from LAPACK's syevd (Householder tridiagonal form, then divide and conquer) on the d x d covariance,
and are refined with residuals in pairs of doubles, since the high part alone limits them.
"""

from __future__ import annotations

from fractions import Fraction
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keep
from .vectors import add, common_length, finite, matrix, multiply, total, two_product, two_sum

SCALE, SHIFT = 64, 1_000_000
#: Entries of this size or more have no whole number that a double holds exactly.
LARGEST = float(1 << 46)
FAN = 6  # bits of the task's number that one round of merging drops


class Whitening(NamedTuple):
    n: int
    sums: list[int]
    mean: tuple[np.ndarray, np.ndarray]  # high and low parts
    values: np.ndarray  # falling eigenvalues of the components
    components: np.ndarray  # one unit vector a column
    explained: np.ndarray


def whole_entries(df: DataFrame, id_col: str, vector: str) -> DataFrame:
    """vec_id, x: floor(64 c) + 1,000,000 of each entry c; rows whose vector is null or not finite are dropped, as are those with |c| >= 2**46."""
    c = F.col(vector)
    fits = finite(c) & F.forall(c, lambda v: F.abs(v.cast("double")) < LARGEST)
    x = F.transform(c, lambda v: (F.floor(v.cast("double") * SCALE) + SHIFT).cast("long"))
    return df.where(fits).select(F.col(id_col).alias("vec_id"), x.alias("x"))


def covariance(df: DataFrame, vector: str, mean: tuple[np.ndarray, np.ndarray], n: int) -> tuple[np.ndarray, np.ndarray]:
    """Covariance with divisor n as a high and a low part: the driver gets d rows, whatever the table's size."""
    d = len(mean[0])
    step = max(1, (1 << 17) // max(1, d * d))

    def centred(batches):
        part, sums = TaskContext.get().partitionId(), None
        for batch in batches:
            x = matrix(batch.column(0), d).astype(np.float64)
            for at in range(0, len(x), step):
                h, l = two_sum(x[at : at + step], -mean[0])  # noqa: E741
                c = two_sum(h, l - mean[1])
                here = total(multiply((c[0][:, :, None], c[1][:, :, None]), (c[0][:, None, :], c[1][:, None, :])))
                sums = here if sums is None else add(sums, here)
        if sums is not None:
            parts = [[np.ascontiguousarray(s[i]).tobytes() for i in range(d)] for s in sums]
            yield pa.RecordBatch.from_arrays([pa.array([part] * d, pa.int32()), pa.array(range(d), pa.int32()), *(pa.array(p, pa.binary()) for p in parts)], ["part", "i", "high", "low"])

    def merge(t: pa.Table) -> pa.Table:
        t = t.sort_by("high")  # an order that does not depend on the shuffle
        rows = [np.stack([np.frombuffer(b) for b in t.column(c).to_pylist()]) for c in ("high", "low")]
        h, l = total((rows[0], rows[1]))  # noqa: E741
        return pa.table({"part": t.column("part")[:1], "i": t.column("i")[:1], "high": pa.array([h.tobytes()], pa.binary()), "low": pa.array([l.tobytes()], pa.binary())})

    kind = "part int, i int, high binary, low binary"
    rows = df.select(vector).mapInArrow(centred, kind)
    for _ in range(3):  # 2**18 tasks end in one row a line of the matrix; more in a few
        rows = rows.withColumn("part", F.shiftright("part", FAN)).groupBy("part", "i").applyInArrow(merge, kind)
    out = (np.zeros((d, d)), np.zeros((d, d)))
    for r in sorted(rows.collect(), key=lambda r: (r["part"], r["i"])):
        i = r["i"]
        out[0][i], out[1][i] = add((out[0][i], out[1][i]), (np.frombuffer(r["high"]), np.frombuffer(r["low"])))
    # Division by n: the quotient, then the remainder's.
    q = out[0] / n
    p, e = two_product(q, np.float64(n))
    return two_sum(q, ((out[0] - p) - e + out[1]) / n)


def product(a, b):
    """Matrix product of (high, low) pairs."""
    out = (np.zeros((a[0].shape[0], b[0].shape[1])), np.zeros((a[0].shape[0], b[0].shape[1])))
    for k in range(a[0].shape[1]):
        out = add(out, multiply((a[0][:, k, None], a[1][:, k, None]), (b[0][None, k], b[1][None, k])))
    return out


def eigen(v: tuple[np.ndarray, np.ndarray], rounds: int = 2) -> tuple[np.ndarray, np.ndarray]:
    """Falling eigenvalues and unit eigenvectors (columns) of a symmetric matrix given as a high and a low part.

    Each round corrects all vectors at once: with R = I - X'X and S = X'VX in pairs of doubles, X gains X E, where
    E_ij = (S_ij + l_j R_ij) / (l_j - l_i), or R_ij / 2 where two eigenvalues cannot be told apart.
    """
    d = len(v[0])
    _, x = np.linalg.eigh(v[0])
    pair = (x, np.zeros_like(x))
    values = np.zeros(d)
    for at in range(rounds + 1):
        turned = (pair[0].T, pair[1].T)
        r = add((np.eye(d), np.zeros((d, d))), tuple(-p for p in product(turned, pair)))
        s = product(turned, product(v, pair))
        r, s = r[0] + r[1], s[0] + s[1]
        values = np.diag(s) / (1 - np.diag(r))
        if at == rounds:
            break
        gap = values[None, :] - values[:, None]
        near = np.abs(gap) <= 2 * (np.linalg.norm(s - np.diag(np.diag(s))) + np.abs(values).max() * np.linalg.norm(r)) + 1e-300
        e = np.where(near, r / 2, (s + values[None, :] * r) / np.where(near, 1, gap))
        pair = add(pair, product(pair, (e, np.zeros_like(e))))
    order = np.argsort(-values, kind="stable")
    return values[order], pair[0][:, order]


def fit(rows: DataFrame, d: int, most: int = 32) -> Whitening:
    """From whole_entries rows of d entries. Components whose eigenvalue is 0 (to rounding) are left out: they cannot be whitened."""
    per = rows.select(F.posexplode("x")).groupBy("pos").agg(F.sum("col").alias("s"), F.count(F.lit(1)).alias("n")).collect()
    n, sums = per[0]["n"], [r["s"] for r in sorted(per, key=lambda r: r["pos"])]
    high = np.array([float(Fraction(s, n)) for s in sums])
    low = np.array([float(Fraction(s, n) - Fraction(h)) for s, h in zip(sums, high)])
    v = covariance(rows, "x", (high, low), n)
    values, x = eigen(v)
    some = [k for k in range(min(most, d)) if values[k] > 1e-13 * values[0] and values[0] > 0]
    return Whitening(n, sums, (high, low), values[some], x[:, some], values[some] / (np.trace(v[0]) + np.trace(v[1])))


def whiten(rows: DataFrame, w: Whitening) -> DataFrame:
    """vec_id, deviation, w (one entry a component). deviation: exact sum of (n x - S)**2; null beyond a long."""
    turn, sums, n, mean, d = w.components / np.sqrt(w.values), np.array(w.sums, object), w.n, w.mean, len(w.sums)

    def deviations(x: np.ndarray, c: np.ndarray) -> pa.Array:
        far = n * (float(np.abs(c).max(initial=0)) + 1)
        if far * far * d < 2**62 and n * float(np.abs(x).max(initial=0)) < 2**62 and max(map(abs, w.sums)) < 2**62:
            y = n * x - sums.astype(np.int64)
            return pa.array((y * y).sum(1), pa.int64())
        exact = [int(sum((n * int(v) - s) ** 2 for v, s in zip(row, w.sums))) for row in x]
        return pa.array([v if v < 2**63 else None for v in exact], pa.int64())

    def run(batches):
        for batch in batches:
            x = matrix(batch.column(1), d)
            c = (x - mean[0]) - mean[1]
            y = c @ turn
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * turn.shape[1], pa.int32()), pa.array(y.ravel(), pa.float64()))
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), deviations(x, c), lists], ["vec_id", "deviation", "w"])

    return rows.select("vec_id", "x").mapInArrow(run, "vec_id long, deviation long, w array<double>")


def identity_error(table: DataFrame, components: int, n: int) -> float:
    """Largest absolute entry of the whitened vectors' covariance minus the identity."""
    sums = table.select(F.posexplode("w")).groupBy("pos").agg(F.avg("col").alias("m")).collect()
    mean = np.array([r["m"] for r in sorted(sums, key=lambda r: r["pos"])])
    v = covariance(table, "w", (mean, np.zeros(components)), n)
    return float(np.abs(v[0] - np.eye(components) + v[1]).max())


def whitened(df: DataFrame, id_col: str = "vec_id", vector: str = "embedding", most: int = 32) -> DataFrame:
    """vec_id, component (from 1), n, deviation, whitened, explained, identity_error of each row and component.

    Rows whose vector is null or has null or non-finite entries are dropped, and so are vectors of another length than
    most have. Null and repeated ids and repeated rows are ordinary rows. A covariance of rank r gives r components, so
    a single row, equal rows and an empty table give no rows. Other columns are not read.
    """
    spark = df.sparkSession
    rows = keep(whole_entries(df, id_col, vector))
    d = common_length(rows, "x")
    rows = rows.where(F.size("x") == d)
    w = fit(rows, d, most) if d > 0 else None
    if w is None or not len(w.values):
        return spark.createDataFrame([], "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double")
    out = keep(whiten(rows, w))
    error = identity_error(out, len(w.values), w.n)
    explained = F.array(*[F.lit(float(x)) for x in w.explained])
    out = out.select("vec_id", "deviation", F.posexplode("w").alias("k", "whitened"))
    return out.select("vec_id", (F.col("k") + 1).cast("int").alias("component"), F.lit(w.n).cast("long").alias("n"), "deviation", "whitened", F.element_at(explained, F.col("k") + 1).alias("explained"), F.lit(error).alias("identity_error"))
