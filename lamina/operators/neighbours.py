"""Exact nearest neighbours of vectors and series within a label, pruned by the triangle inequality.

Points are dealt to the nearest of a bounded number of pivots; a cell is the points of a label at a pivot. Points ask in chunks of
bounded size, cut from cells next to each other. Its own points bound how far a chunk's neighbours can be, and it visits
only cells that can hold a nearer point: those whose distances to their pivot come within the bound of the point's own distance to it.
A cell's points travel once to each chunk that visits it and stream past the chunk, which holds its own points and the nearest found so far
and nothing else. So what is sent grows with the chunks, not with the pairs; pairs of a whole label are compared only where the
distances allow no less, and are never stored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import keep

CELL, MOST_PIVOTS = 4096, 1024  # points a cell is meant to have; pivots, whatever the table's size
BLOCK, CHUNK = 2048, 8192  # points that are compared with a chunk at a time; points that ask together
KEPT, NUMBERS = 1 << 22, 1 << 23  # neighbours and numbers that a chunk's points may hold; more of each per point make chunks smaller
FOUND = "id long, other long, d2 double, place2 double"
NOTHING = {"id": pa.array([], pa.int64()), "other": pa.array([], pa.int64()), "d2": pa.array([], pa.float64()), "place2": pa.array([], pa.float64())}


def rows_of(column: pa.ChunkedArray | pa.Array, n: int) -> np.ndarray:
    """A list column with lists of one length as a matrix of n rows."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(n, len(flat) // n if n else 0)


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of a and b, summed from differences (no cancellation, equal pairs stay equal)."""
    out = np.empty((len(a), len(b)))
    step = max(1, (1 << 21) // max(1, b.size))
    for i in range(0, len(a), step):
        out[i : i + step] = ((a[i : i + step, None, :] - b[None, :, :]) ** 2).sum(2)
    return out


class Nearest:
    """The `count` nearest points found so far of a chunk's points, by squared distance, then id; points are not their own neighbours.

    below: only what lies strictly below the last of them will be asked for, so that it does not matter which of equal ones are kept.
    """

    def __init__(self, ids: np.ndarray, x: np.ndarray, place: np.ndarray, count: int, digits: int | None, below: bool):
        self.ids, self.x, self.place, self.count, self.digits, self.below = ids, x, place, count, digits, below
        self.norm = (x**2).sum(1)
        self.d2, self.other, self.place2 = (np.full((len(ids), count), v) for v in (np.inf, -1, 0.0))
        self.slack = 0.0 if digits is None else 10.0**-digits

    def see(self, ids: np.ndarray, x: np.ndarray, place: np.ndarray, r: np.ndarray, pivot: np.ndarray) -> None:
        """Points of one cell, in order of r, their distance to its pivot."""
        away = np.sqrt(((self.x - pivot) ** 2).sum(1))
        norm = (x**2).sum(1)
        for at in range(0, len(ids), BLOCK):
            k = slice(at, at + BLOCK)
            reach = np.sqrt(self.d2[:, -1] + self.slack) * (1 + 1e-9) + 1e-9 * (1 + away)
            rows = np.flatnonzero(~((away - r[k][-1] > reach) | (r[k][0] - away > reach)))
            step = max(1, (1 << 19) // len(ids[k]))
            for i in range(0, len(rows), step):
                self.compare(rows[i : i + step], ids[k], x[k], place[k], norm[k])

    def compare(self, rows: np.ndarray, ids: np.ndarray, x: np.ndarray, place: np.ndarray, norm: np.ndarray) -> None:
        """A product of matrices tells which pairs can be near enough, up to its rounding; those are summed from differences."""
        y, size = self.x[rows], self.norm[rows][:, None] + norm
        with np.errstate(invalid="ignore", over="ignore"):
            could = ~(size - 2 * (y @ x.T) - 1e-15 * (16 + y.shape[1]) * size > self.d2[rows, -1][:, None] + self.slack)
        could &= self.ids[rows][:, None] != ids
        a, b = np.nonzero(could)
        if not len(a):
            return
        with np.errstate(invalid="ignore", over="ignore"):
            if 4 * len(a) > could.size:
                d2 = squared(y, x)[a, b]
            else:
                d2 = np.empty(len(a))
                for i in range(0, len(a), 1 << 14):
                    d2[i : i + (1 << 14)] = ((y[a[i : i + (1 << 14)]] - x[b[i : i + (1 << 14)]]) ** 2).sum(1)
        d2 = d2 if self.digits is None else np.round(d2, self.digits)
        near = (d2 <= self.d2[rows[a], -1]) & np.isfinite(d2)
        if near.any():
            (self.add_below if self.below else self.add)(rows, a[near], b[near], d2[near], ids, place)

    def add(self, rows, a, b, d2, ids, place) -> None:
        some, a = np.unique(a, return_inverse=True)
        rows, own = rows[some], np.repeat(np.arange(len(some)), self.count)
        near = ((self.place[rows[a]] - place[b]) ** 2).sum(1)
        r, d, o, p = (np.concatenate(v) for v in ((own, a), (self.d2[rows].ravel(), d2), (self.other[rows].ravel(), ids[b]), (self.place2[rows].ravel(), near)))
        order = np.lexsort((o, d, r))
        r = r[order]
        order = order[np.arange(len(r)) - np.searchsorted(r, r, "left") < self.count].reshape(len(rows), self.count)
        self.d2[rows], self.other[rows], self.place2[rows] = d[order], o[order], p[order]

    def add_below(self, rows, a, b, d2, ids, place) -> None:
        """As add, where which of equal ones are kept does not matter; the last one found is the farthest, the others are in no order."""
        some, a = np.unique(a, return_inverse=True)
        rows, many = rows[some], np.bincount(a)
        col = np.arange(len(a)) - np.repeat(np.cumsum(many) - many, many)  # a comes in order
        d = np.full((len(rows), self.count + many.max()), np.inf)
        o = np.full(d.shape, -1)
        p = np.zeros(d.shape)
        for all_, mine, new in ((d, self.d2, d2), (o, self.other, ids[b]), (p, self.place2, ((self.place[rows[a]] - place[b]) ** 2).sum(1))):
            all_[:, : self.count], all_[a, self.count + col] = mine[rows], new
        order = np.argpartition(d, self.count - 1, axis=1)[:, : self.count]
        self.d2[rows], self.other[rows], self.place2[rows] = (np.take_along_axis(v, order, 1) for v in (d, o, p))

    def found(self):
        """id, other, d2, place2 as Arrow batches: all that is kept, or with below what lies below the last of `count` neighbours."""
        for i in range(0, len(self.ids), step := max(1, (1 << 16) // self.count)):
            k = slice(i, i + step)
            r, c = np.nonzero((self.d2[k] < self.d2[k, -1:]) if self.below else np.isfinite(self.d2[k]))
            cols = self.ids[k][r], self.other[k][r, c], self.d2[k][r, c], self.place2[k][r, c]
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(cols, (pa.int64(), pa.int64(), pa.float64(), pa.float64()))], list(NOTHING))


def pivots_of(points: DataFrame, n: int) -> np.ndarray:
    """Pivots: of the table's points those of the least hash of the id, one for each CELL of them, MOST_PIVOTS at most; each next to one near it."""
    k = min(MOST_PIVOTS, 1 + n // CELL)
    found = np.array([r["f"] for r in points.orderBy(F.xxhash64("id"), "id").limit(k).select("f").collect()], dtype=np.float64)
    far, order = squared(found, found), [0]
    far[:, 0] = np.inf
    while len(order) < len(found):
        order.append(int(far[order[-1]].argmin()))
        far[:, order[-1]] = np.inf
    return found[order]


def nearest_in_label(points: DataFrame, count: int, digits: int | None = None, below: bool = False) -> DataFrame:
    """id, other, d2, place2: the `count` nearest points of the same label of each point, by squared distance, then id.

    points: id (unique), label, f ARRAY (the vector; all of one length), place ARRAY (all of one length, may be empty: its squared
    distance comes along). digits: d2 is rounded before it is compared. Points whose label has at most `count` others keep
    them all. below: of these, those strictly below the last of `count` neighbours. The result is exact.
    """
    points = keep(points.select(F.col("id").cast("long").alias("id"), "label", "f", "place").where("label is not null"))
    n = points.count()
    if not n:
        return points.sparkSession.createDataFrame([], FOUND)
    pivots = pivots_of(points, n)
    most = max(1, min(CHUNK, KEPT // count, NUMBERS // max(1, pivots.shape[1])))
    slack = 0.0 if digits is None else 10.0**-digits
    kind = dict(points.dtypes)
    names = [*kind, "pivot", "r"]

    def deal(batches):
        for batch in batches:
            x = rows_of(batch.column("f"), len(batch))
            far = np.sqrt(squared(x, pivots)) if len(batch) else np.empty((0, len(pivots)))
            cell = far.argmin(1) if len(batch) else np.empty(0, int)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell.astype(np.int32)), pa.array(far[np.arange(len(cell)), cell])], names)

    cells = points.mapInArrow(deal, ", ".join(f"{c} {t}" for c, t in kind.items()) + ", pivot int, r double")
    stats = keep(cells.groupBy("label", "pivot").agg(F.count(F.lit(1)).alias("n"), F.min("r").alias("near"), F.max("r").alias("far")))
    start = F.sum("n").over(Window.partitionBy("label").orderBy("pivot")) - F.col("n")  # a row for each cell
    held = cells.join(stats.select("label", "pivot", "n", start.alias("start")), ["label", "pivot"])
    chunk = F.floor((F.col("start") + F.pmod(F.xxhash64("id"), "n")) / most).cast("int")
    held = keep(held.select("label", "pivot", chunk.alias("chunk"), "id", "f", "place", "r"))
    chunks = keep(held.select("label", "chunk").distinct())
    tasks = min(8192, 2 * chunks.count())

    def visits(mine: pa.Table, others: pa.Table) -> pa.Table:
        """The cells that a chunk must see: for some point not farther than its bound, which those cells' counts can lower too."""
        x = rows_of(mine.column("f"), len(mine))
        pivot, near, far, many = (others.column(c).to_numpy() for c in ("pivot", "near", "far", "n"))
        see, by = np.zeros(len(pivot), bool), Nearest(mine.column("id").to_numpy(), x, np.empty((len(x), 0)), count, digits, below)
        if count < len(x):
            at = mine.column("pivot").to_numpy()
            for p in np.unique(at):
                own = np.flatnonzero(at == p)
                own = own[np.argsort(mine.column("r").to_numpy()[own])]
                by.see(by.ids[own], x[own], by.place[own], mine.column("r").to_numpy()[own], pivots[p])
        for i in range(0, len(x), 256):
            d = np.sqrt(squared(x[i : i + 256], pivots[pivot]))
            order = np.argsort(d + far, axis=1, kind="stable")
            enough = (np.cumsum(many[order], axis=1) < count + 1).sum(1)  # one of them may be the point itself
            last = np.take_along_axis(d + far, np.take_along_axis(order, np.minimum(enough, len(pivot) - 1)[:, None], 1), 1)[:, 0]
            top = np.where(enough < len(pivot), last**2 * (1 + 1e-9) + slack, np.inf)
            reach = (np.sqrt(np.minimum(top, by.d2[i : i + 256, -1] + slack)) * (1 + 1e-9) + slack)[:, None] + 1e-9 * (1 + d)
            see |= ~((d - far > reach) | (near - d > reach)).all(0)
        return pa.table({c: v for c, v in zip(others.column_names, others.columns)}).filter(pa.array(see)).select(["label", "chunk", "pivot"])

    around = chunks.join(stats, "label").select("label", "chunk", "pivot", "near", "far", "n")
    visit = held.groupBy("label", "chunk").cogroup(around.groupBy("label", "chunk")).applyInArrow(visits, f"label {kind['label']}, chunk int, pivot int")
    visit = keep(visit.select("label", F.col("chunk").alias("to"), "pivot"))
    asking = held.select("label", F.col("chunk").alias("to"), F.lit(0).alias("turn"), "pivot", "r", "id", "f", "place")
    told = held.join(visit, ["label", "pivot"]).select("label", "to", F.when(F.col("chunk") == F.col("to"), 1).otherwise(2).alias("turn"), "pivot", "r", "id", "f", "place")
    stream = asking.unionByName(told).repartition(tasks, "label", "to").sortWithinPartitions("label", "to", "turn", "pivot", "r", "id")

    def meet(batches):
        """Chunk after chunk: first its points, then its own cells' points, then those of the other cells that it visits."""
        key, wait, now = None, [], None

        def asked() -> Nearest:
            t = pa.concat_tables(wait)
            return Nearest(t.column("id").to_numpy(), rows_of(t.column("f"), len(t)), rows_of(t.column("place"), len(t)), count, digits, below)

        for batch in batches:
            t = pa.Table.from_batches([batch])
            label, to = t.column("label").to_pylist(), t.column("to").to_numpy()
            turn, pivot = t.column("turn").to_numpy(), t.column("pivot").to_numpy()
            new = np.ones(len(t), bool)
            new[1:] = (to[1:] != to[:-1]) | (turn[1:] != turn[:-1]) | (pivot[1:] != pivot[:-1]) | np.array([p != q for p, q in zip(label[1:], label)], bool)
            for i, j in zip(ends := np.flatnonzero(new).tolist(), [*ends[1:], len(t)]):
                if (label[i], to[i]) != key:
                    if now:
                        yield from now.found()
                    key, wait, now = (label[i], to[i]), [], None
                some = t.slice(i, j - i)
                if turn[i] == 0:
                    wait.append(some)
                    continue
                now = now or asked()
                now.see(some.column("id").to_numpy(), rows_of(some.column("f"), j - i), rows_of(some.column("place"), j - i), some.column("r").to_numpy(), pivots[pivot[i]])
        if now:
            yield from now.found()

    return stream.mapInArrow(meet, FOUND)


def sparse_series_matrix(points: DataFrame, best: int | None = None, sparsity: float | None = None) -> DataFrame:
    """i, j, feature, dist of points(id, label, f ARRAY, place ARRAY): pairs of a label whose squared difference of series lies
    strictly below the one at rank `best`, counted from 0 among the point's others, and a row of zeros for each point with itself.

    sparsity: `best` as a percentage of all points, rounded down; at least 2 and at most all points.
    """
    if best is None:
        n = points.count()
        best = max(2, min(n, int(n * sparsity * 0.01)))
    near = nearest_in_label(points, best + 1, below=True)
    pairs = near.select(F.col("id").alias("i"), F.col("other").alias("j"), F.col("d2").alias("feature"), F.col("place2").alias("dist"))
    zero = F.lit(0.0)
    return pairs.unionByName(points.select(F.col("id").alias("i"), F.col("id").alias("j"), zero.alias("feature"), zero.alias("dist")))


def knn_pairs(vectors: DataFrame, k: int, digits: int = 4) -> DataFrame:
    """The k nearest vectors of the same label: id, other, d2 (rounded), rank. vectors(id, label, x ARRAY). Equal distances rank by id."""
    v = vectors.select("id", "label", F.col("x").alias("f"), F.array().cast("array<double>").alias("place"))
    w = Window.partitionBy("id").orderBy("d2", "other")
    return nearest_in_label(v, k, digits).select("id", "other", "d2", F.row_number().over(w).alias("rank"))
