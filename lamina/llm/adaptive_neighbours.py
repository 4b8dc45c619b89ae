"""Approximate nearest neighbours by inner product: inverted lists whose vectors are scanned dimension by dimension.

A vector x gets one more entry, sqrt(m^2 - |x|^2) with m the largest norm of the table, and a query a 0, so that the
smallest distance is the largest inner product. All are turned by one random rotation. Every row is put into the list of
its nearest centroid; a list is cut into blocks of bounded rows, stored as columns of WIDTH rotated dimensions. While a block
is scanned, pairs are abandoned as soon as their partial distance is larger than that of a pair as near as the query's 20th best
can be: a random rotation makes a partial distance's share of the whole a beta variable, whose quantile is the test. Pairs
that pass all tests are scored on the original vectors in double precision.
"""

from __future__ import annotations

from math import isqrt
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import keep
from .vectors import common_length, finite, matrix

WIDTH = 16  # dimensions of a column block
BLOCK, CHUNK = 4096, 1024  # most vectors of a block; expected queries of a chunk
RUN = 512  # vectors between two updates of the queries' thresholds
ASSIGNED = "vec_id long, list int, vector binary"
FOUND = "query_id long, vec_id long, score double"


class Lists(NamedTuple):
    d: int  # entries of a vector
    norm: float  # largest norm of the table
    rotation: np.ndarray  # (d + 1) x (d + 1)
    centroids: np.ndarray  # not rotated, one a row
    probes: int  # lists that a query reads
    quantiles: np.ndarray  # of a partial distance's share after each column block but the last


def lengthened(x: np.ndarray, norm: float) -> np.ndarray:
    """Vectors over the largest norm, with the entry that makes all of them as long as it."""
    x = x.astype(np.float64) / norm
    return np.hstack([x, np.sqrt(np.maximum(0.0, 1.0 - (x * x).sum(1)))[:, None]])


def centroids(x: np.ndarray, k: int, rounds: int) -> np.ndarray:
    """k means by Lloyd's rounds from k rows at even places; an empty list keeps its centroid."""
    c = x[np.linspace(0, len(x) - 1, k).astype(int)].copy()
    for _ in range(rounds):
        near = np.argmax(x @ c.T - 0.5 * (c * c).sum(1), 1)
        n = np.bincount(near, minlength=k)
        order = np.argsort(near, kind="stable")
        some = np.flatnonzero(n)
        c[some] = np.add.reduceat(x[order], (np.cumsum(n) - n)[some], axis=0) / n[some, None]
    return c


def usable(df: DataFrame, id_col: str, vector: str) -> DataFrame:
    """vec_id, v (doubles), norm2 of rows with an id and a finite vector other than zero."""
    v = F.transform(vector, lambda c: c.cast("double"))
    rows = df.where(F.col(id_col).isNotNull() & finite(F.col(vector))).select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v"))
    norm2 = F.aggregate("v", F.lit(0.0), lambda a, c: a + c * c)
    return rows.withColumn("norm2", norm2).where("norm2 > 0")


def fit(rows: DataFrame, n: int, d: int, norm: float, top: int, sample: int = 16_384, most_lists: int = 1024, recall: float = 0.97, miss: float = 0.002, rounds: int = 8) -> Lists:
    """Lists from about `sample` of the n rows, those of the least hash of the id.

    There are sqrt(n) / 4 lists, at most most_lists. probes is the least number of lists that hold `recall` of the `top`
    nearest of 256 of the sample's rows; the whole table's neighbours are nearer, so its recall is not less. A test
    abandons a pair as near as the threshold with probability `miss`.
    """
    cut = F.pmod(F.xxhash64("vec_id"), F.lit(1 << 30)) < int(min(1.0, sample / max(1, n)) * (1 << 30))
    got = rows.where(cut).select("vec_id", "v").toArrow().combine_chunks().sort_by("vec_id") if n else None
    if got is None or not len(got):
        got = rows.select("vec_id", "v").limit(1).toArrow().combine_chunks()
    x = matrix(got.column("v").combine_chunks(), d)
    rng = np.random.default_rng(7)
    x = x[rng.permutation(len(x))]
    z = lengthened(x, norm)
    k = max(1, min(most_lists, isqrt(n) // 4, len(x)))
    c = centroids(z, k, rounds)
    ask = x[:256] / norm
    scores = ask @ (x / norm).T
    scores[np.arange(len(ask)), np.arange(len(ask))] = -np.inf
    best = np.argsort(-scores, 1, kind="stable")[:, : max(1, min(top, len(x) - 1))]
    near = np.argmax(z @ c.T - 0.5 * (c * c).sum(1), 1)
    place = np.argsort(np.argsort(-(ask @ c[:, :d].T - 0.5 * (c * c).sum(1)), 1, kind="stable"), 1, kind="stable")
    need = np.sort(np.take_along_axis(place, near[best], 1), None)
    probes = int(need[min(len(need) - 1, int(np.ceil(recall * len(need))) - 1)]) + 1
    q, r = np.linalg.qr(rng.standard_normal((d + 1, d + 1)))
    ends = range(WIDTH, d + 1, WIDTH)
    quantiles = [np.quantile(rng.beta(e / 2, (d + 1 - e) / 2, 200_000), 1 - miss) for e in ends if e <= d]
    return Lists(d, norm, q * np.sign(np.diag(r)), c, min(k, probes), np.array(quantiles))


def assign(rows: DataFrame, lists: Lists) -> DataFrame:
    """vec_id, list, vector (doubles as bytes) of every row."""
    c = lists.centroids
    half = 0.5 * (c * c).sum(1)

    def run(batches):
        for batch in batches:
            x = matrix(batch.column(1), lists.d)
            near = np.concatenate([np.argmax(lengthened(x[i : i + RUN], lists.norm) @ c.T - half, 1) for i in range(0, len(x), RUN)]).astype(np.int32) if len(x) else np.empty(0, np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(near), pa.array([r.tobytes() for r in x], pa.binary())], ["vec_id", "list", "vector"])

    return rows.select("vec_id", "v").mapInArrow(run, ASSIGNED)


def packed(rows: DataFrame, lists: Lists) -> DataFrame:
    """Rows (list, block, vec_id, vector) as one row a block, its rotated vectors in column blocks of single precision, dimension by dimension."""

    def pack(t: pa.Table) -> pa.Table:
        t = t.sort_by([("vec_id", "ascending"), ("vector", "ascending")])
        x = np.frombuffer(b"".join(t.column("vector").to_pylist())).reshape(-1, lists.d)
        z = (lengthened(x, lists.norm) @ lists.rotation).astype(np.float32)
        parts = [np.ascontiguousarray(z[:, i : i + WIDTH].T).tobytes() for i in range(0, lists.d + 1, WIDTH)]
        ids = np.ascontiguousarray(t.column("vec_id").to_numpy()).tobytes()
        row = {"list": t.column("list")[:1], "block": t.column("block")[:1], "ids": pa.array([ids], pa.binary()), "vectors": pa.array([x.tobytes()], pa.binary()), "columns": pa.array([parts], pa.list_(pa.binary()))}
        return pa.table(row)

    return rows.groupBy("list", "block").applyInArrow(pack, "list int, block int, ids binary, vectors binary, columns array<binary>")


def probing(queries: DataFrame, lists: Lists) -> DataFrame:
    """query_id, vector, lists (the nearest centroids' lists, nearest first) of each query."""
    c = lists.centroids
    half = 0.5 * (c * c).sum(1)

    def run(batches):
        for batch in batches:
            x = matrix(batch.column(1), lists.d)
            order = np.argsort(half - (x / lists.norm) @ c[:, : lists.d].T, 1, kind="stable")[:, : lists.probes].astype(np.int32)
            offs = pa.array(np.arange(len(x) + 1) * order.shape[1], pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([r.tobytes() for r in x], pa.binary()), pa.ListArray.from_arrays(offs, pa.array(order.ravel(), pa.int32()))], ["query_id", "vector", "lists"])

    return queries.select("vec_id", "v").mapInArrow(run, "query_id long, vector binary, lists array<int>")


def best(q: np.ndarray, s: np.ndarray, v: np.ndarray, top: int) -> np.ndarray:
    """Places of each query's `top` best (score, then smaller id), by query."""
    order = np.lexsort((v, -s, q))
    qs = q[order]
    first = np.r_[True, qs[1:] != qs[:-1]] if len(qs) else np.empty(0, bool)
    rank = np.arange(len(qs)) - np.maximum.accumulate(np.where(first, np.arange(len(qs)), 0))
    return order[rank < top]


def scan(block: dict, asked: pa.Table, lists: Lists, top: int) -> pa.Table:
    """The pairs of one block and one chunk of queries that can be among the queries' `top`: query_id, vec_id, score."""
    ids = np.frombuffer(block["ids"], np.int64)
    x = np.frombuffer(block["vectors"]).reshape(len(ids), lists.d)
    columns = [np.frombuffer(b, np.float32).reshape(-1, len(ids)) for b in block["columns"]]
    qids = asked.column("query_id").to_numpy()
    y = np.frombuffer(b"".join(asked.column("vector").to_pylist())).reshape(len(qids), lists.d)
    bound = asked.column("bound").to_numpy(zero_copy_only=False).astype(np.float64).copy()  # score of the top-th best so far; NaN: none
    bound[np.isnan(bound)] = -np.inf
    z = (np.hstack([y / lists.norm, np.zeros((len(y), 1))]) @ lists.rotation).astype(np.float32)
    own2 = (y / lists.norm * (y / lists.norm)).sum(1)
    turned = [np.ascontiguousarray(z[:, i : i + WIDTH]) for i in range(0, lists.d + 1, WIDTH)]
    slack = 1e-5 * (1 + own2)
    hits = (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))
    for at in range(0, len(ids), RUN):
        worst = 1 + own2 - 2 * bound / lists.norm**2  # squared distance of a vector as near as the bound
        part = [c[:, at : at + RUN] for c in columns]
        far = (part[0] ** 2).sum(0)[None, :] + (turned[0] ** 2).sum(1)[:, None] - 2 * (turned[0] @ part[0])
        for k in range(len(columns)):
            limit = worst * (lists.quantiles[k] if k < len(columns) - 1 else 1.0) + slack
            if k == 0:
                qi, xi = np.nonzero(far <= limit[:, None])
                far = far[qi, xi]
            else:
                far = far + np.concatenate([((turned[k][qi[i : i + 65536]] - part[k].T[xi[i : i + 65536]]) ** 2).sum(1) for i in range(0, len(qi), 65536)] or [np.empty(0, np.float32)])
                stay = far <= limit[qi]
                qi, xi, far = qi[stay], xi[stay], far[stay]
        other = ids[at + xi] != qids[qi]
        qi, xi = qi[other], xi[other] + at
        score = np.concatenate([(y[qi[i : i + 65536]] * x[xi[i : i + 65536]]).sum(1) for i in range(0, len(qi), 65536)] or [np.empty(0)])
        stay = score >= bound[qi]
        hits = tuple(np.concatenate([a, b[stay]]) for a, b in zip(hits, (qi, ids[xi], score)))
        stay = best(hits[0], hits[2], hits[1], top)
        hits = tuple(a[stay] for a in hits)
        n = np.bincount(hits[0], minlength=len(qids))
        full = np.flatnonzero(n >= top)
        bound[full] = np.maximum(bound[full], hits[2][np.cumsum(n)[full] - 1])
    stay = hits[2] >= bound[hits[0]]
    return pa.table({"query_id": pa.array(qids[hits[0][stay]], pa.int64()), "vec_id": pa.array(hits[1][stay], pa.int64()), "score": pa.array(hits[2][stay], pa.float64())})


def scanned(blocks: DataFrame, asked: DataFrame, lists: Lists, top: int) -> DataFrame:
    """scan() of each block with each chunk of the queries (query_id, vector, bound, list, block) that read it."""
    asked = keep(asked)
    load = keep(asked.groupBy("list", "block").agg(F.ceil(F.count(F.lit(1)) / CHUNK).cast("int").alias("chunks")))
    read = lambda t: t.join(load, ["list", "block"])
    left = read(blocks).withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    right = read(asked).withColumn("chunk", F.pmod(F.xxhash64("query_id"), "chunks").cast("int"))

    def pair(a: pa.Table, b: pa.Table) -> pa.Table:
        if not len(a) or not len(b):
            return pa.table({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        return scan(a.to_pylist()[0], b.sort_by("query_id"), lists, top)

    left = left.select("list", "block", "chunk", "ids", "vectors", "columns").groupBy("list", "block", "chunk")
    right = right.select("list", "block", "chunk", "query_id", "vector", "bound").groupBy("list", "block", "chunk")
    return left.cogroup(right).applyInArrow(pair, FOUND)


def nearest(df: DataFrame, is_query, top: int = 20, id_col: str = "vec_id", vector: str = "embedding", **fitting) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the `top` rows of largest inner product found for each row with is_query.

    Rows whose id is null or whose vector is null, zero, of another length than most or not finite take no part. A query's
    candidates are all rows of other ids; fewer than `top` of them are all returned if its lists hold them. Ties go to the
    smaller id. Query rows that share an id ask once, with the smallest vector; repeated candidate rows count repeatedly.
    An empty table gives an empty table. fitting: parameters of fit(). Other columns are not read.

    A query first scans the first block of its nearest list, which bounds its score; all other blocks of its lists then
    abandon against that bound.
    """
    rows = keep(usable(df, id_col, vector))
    d = common_length(rows, "v")
    rows = rows.where(F.size("v") == d)
    n, most = rows.agg(F.count(F.lit(1)), F.max("norm2")).first()
    if not n:
        return df.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    lists = fit(rows, n, d, float(np.sqrt(most)), top, **fitting)
    block_rows = max(64, min(BLOCK, 2 * n // len(lists.centroids)))
    placed = keep(assign(rows, lists))
    cuts = keep(placed.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / block_rows).cast("int").alias("cuts")), 1)
    cuts = F.broadcast(cuts)  # one row a list, at most most_lists
    blocks = keep(packed(placed.join(cuts, "list").withColumn("block", F.pmod(F.xxhash64("vec_id"), "cuts").cast("int")), lists))
    asking = rows.where(is_query(F.col("vec_id"))).groupBy("vec_id").agg(F.min("v").alias("v"))
    asking = keep(probing(asking, lists))
    start = asking.select("query_id", "vector", F.lit(None).cast("double").alias("bound"), F.element_at("lists", 1).alias("list"), F.lit(0).alias("block"))
    first = keep(scanned(blocks, start, lists, top))
    bounds = first.groupBy("query_id").agg(F.count(F.lit(1)).alias("c"), F.min("score").alias("low")).select("query_id", F.when(F.col("c") >= top, F.col("low")).alias("bound"))
    rest = asking.join(bounds, "query_id", "left").select("query_id", "vector", "bound", F.posexplode("lists").alias("place", "list")).join(cuts, "list")
    rest = rest.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("cuts") - 1))).where("place > 0 or block > 0")
    found = first.unionByName(scanned(blocks, rest, lists, top))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= top).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
