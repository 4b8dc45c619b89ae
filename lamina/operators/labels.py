"""Labels of voxels that depend on their neighbours: Markov random fields over blocks with a halo, growth in order of distance."""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import keep

SIDE = 48  # voxels of a block's side
#: Fixed values of the label energy: two energies nearer than this are equal, and then the later candidate wins.
EQUAL = 1e-6


def halo_blocks(img: DataFrame, side: int, reach: int) -> DataFrame:
    """img with the block (bi, bj, bk) of each voxel and of every other block within `reach` of it: a voxel of a corner goes to several blocks."""
    for a in "ijk":
        own = F.floor(F.col(a) / side)
        around = F.sequence(F.floor((F.col(a) - reach) / side), F.floor((F.col(a) + reach) / side))
        img = img.withColumn(f"o{a}", own).withColumn(f"b{a}", F.explode(around))
    core = F.lit(True)
    for a in "ijk":
        core = core & (F.col(f"b{a}") == F.col(f"o{a}"))
    return img.withColumn("core", core).drop("oi", "oj", "ok")


def neighbour_weights(spacing: tuple[float, float, float], flat: bool) -> list[tuple[int, int, int, float]]:
    """Steps to the neighbours in order of k, j, i with weights of 1 / distance that sum to 1: 26 of them, 8 in a flat image."""
    steps = [(i, j, k) for k in ((0,) if flat else (-1, 0, 1)) for j in (-1, 0, 1) for i in (-1, 0, 1) if (i, j, k) != (0, 0, 0)]
    w = np.array([1 / np.sqrt(sum((s * x) ** 2 for s, x in zip(step, spacing))) for step in steps])
    return [(*s, float(x)) for s, x in zip(steps, w / w.sum())]


def sweep(now: np.ndarray, first: np.ndarray, free: np.ndarray, steps: list, smoothness: float) -> np.ndarray:
    """Labels of least energy given the neighbours' labels `now`: one for a label other than the first one, `smoothness` for neighbours of other labels.

    Candidates are a voxel's own label, then the first labels of its neighbours in order; of equal energies the later candidate.
    """
    move = lambda a, s: np.roll(a, (-s[0], -s[1], -s[2]), (0, 1, 2))
    around = [move(now, s) for s in steps]
    best, energy, tried = now.copy(), None, []
    for label in [now, *(move(first, s) for s in steps)]:
        e = sum(s[3] * (x != label) for s, x in zip(steps, around)) * smoothness + (label != first)
        if energy is None:
            energy = e
        else:
            better = e - energy < EQUAL
            for other in tried:  # a label is tried at its first place only
                better &= label != other
            best, energy = np.where(better, label, best), np.where(better, e, energy)
        tried.append(label)
    return np.where(free, best, now)


def regularize_labels(img: DataFrame, dims: tuple[int, int, int], iterations: int = 4, smoothness: float = 4.0, converged: float = 0.2, spacing: tuple[float, float, float] = (1.0, 1.0, 1.0), colours: bool = False, side: int = SIDE) -> DataFrame:
    """voxel, label of img(voxel, i, j, k, label) under a Markov random field; voxels on the border keep their label.

    iterations + 1 sweeps at most; sweeping ends when less than `converged` percent of the inner voxels change. A sweep changes
    all voxels at once. colours: it goes over eight (flat: four) colours of which no two neighbours share one, which never raises
    the energy and so cannot swing between two states. A voxel depends on others only within the number of steps done, so
    blocks with a halo of that width do all sweeps after one shuffle; the sweep at which the image has converged is then read
    off the sum of all blocks' changes.
    """
    flat = dims[2] == 1
    steps = neighbour_weights(spacing, flat)
    parity = [(a, b, c) for c in ((0,) if flat else (0, 1)) for b in (0, 1) for a in (0, 1)] if colours else [None]
    total = iterations + 1
    reach = total * len(parity)
    inner = [(1, n - 2) for n in dims] if not flat else [(1, dims[0] - 2), (1, dims[1] - 2), (0, 0)]
    count = int(np.prod([max(0, b - a + 1) for a, b in inner]))

    def work(table: pa.Table) -> pa.Table:
        at = [table.column(c).to_numpy() for c in "ijk"]
        low = [int(x.min()) - 1 for x in at]
        place = tuple(x - o for x, o in zip(at, low))
        shape = [int(p.max()) + 2 for p in place]
        first = np.zeros(shape, np.int64)
        first[place] = table.column("label").to_numpy()
        grid = np.meshgrid(*[np.arange(n) + o for n, o in zip(shape, low)], indexing="ij")
        free = np.ones(shape, bool)
        for g, (a, b) in zip(grid, inner):
            free &= (g >= a) & (g <= b)
        there = np.zeros(shape, bool)
        there[place] = True
        free &= there
        now, seen = first.copy(), []
        for _ in range(total):
            for p in parity:
                mine = free if p is None else free & (grid[0] % 2 == p[0]) & (grid[1] % 2 == p[1]) & (grid[2] % 2 == p[2] if not flat else True)
                now = sweep(now, first, mine, steps, smoothness)
            seen.append(now[place])
        core = table.column("core").to_numpy(zero_copy_only=False)
        rows = np.stack(seen, 1)[core]
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1) * total, pa.int32()), pa.array(rows.ravel()))
        return pa.table({"voxel": table.column("voxel").filter(pa.array(core)), "first": table.column("label").filter(pa.array(core)), "seen": lists})

    blocks = halo_blocks(img.select(F.col("voxel").cast("long").alias("voxel"), *[F.col(a).cast("long").alias(a) for a in "ijk"], F.col("label").cast("long").alias("label")), side, reach)
    done = keep(blocks.groupBy("bi", "bj", "bk").applyInArrow(work, "voxel long, first long, seen array<long>"))
    was = lambda s: F.col("first") if s == 0 else F.col("seen")[s - 1]
    changed = done.agg(*[F.sum((F.col("seen")[s] != was(s)).cast("long")).alias(f"c{s}") for s in range(total)]).first()
    at = next((s for s in range(total) if count and 100.0 * (changed[s] or 0) / count < converged), total - 1)
    return done.select("voxel", F.col("seen")[at].alias("label"))


def grow_in_order(images: DataFrame, seeds: DataFrame) -> DataFrame:
    """img, voxel, label: regions grown from seeds(img, label, x ARRAY, voxel) over images(img, voxel, i, j, k, x ARRAY), nearest first.

    The voxel that is nearest (squared distance of x) to the seed of a region that it touches (six neighbours) joins that region, of
    all voxels and regions at a time; ties go to the smaller label, then voxel. Voxels that no region reaches get 0. The order
    is over a whole image, so an image is one group, as its file is; images are independent and run in parallel.
    """

    def work(voxels: pa.Table, seeds: pa.Table) -> pa.Table:
        if not len(voxels):
            return pa.table({"img": pa.array([], pa.string()), "voxel": pa.array([], pa.int64()), "label": pa.array([], pa.int64())})
        voxels, seeds = voxels.sort_by("voxel"), seeds.sort_by("label")
        n = len(voxels)
        x = voxels.column("x").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(n, -1)
        at = [voxels.column(c).to_numpy() for c in "ijk"]
        ids = voxels.column("voxel").to_numpy()
        where = {p: k for k, p in enumerate(zip(*(a.tolist() for a in at)))}
        near = [[where[q] for q in ((i - 1, j, k), (i + 1, j, k), (i, j - 1, k), (i, j + 1, k), (i, j, k - 1), (i, j, k + 1)) if q in where] for i, j, k in where]
        centre = np.array(seeds.column("x").to_pylist(), float).reshape(len(seeds), -1)
        label, heap = np.zeros(n, np.int64), []
        place = dict(zip(ids.tolist(), range(n)))
        own = [place[v] for v in seeds.column("voxel").to_pylist()]
        names = seeds.column("label").to_pylist()

        def reach(p: int, k: int) -> None:
            for u in near[k]:
                if not label[u]:
                    heapq.heappush(heap, (float(((x[u] - centre[p]) ** 2).sum()), p, u))

        for p, k in enumerate(own):
            label[k] = names[p]
        for p, k in enumerate(own):
            reach(p, k)
        while heap:
            _, p, u = heapq.heappop(heap)
            if not label[u]:
                label[u] = names[p]
                reach(p, u)
        return pa.table({"img": voxels.column("img"), "voxel": ids, "label": label})

    a = images.select(F.col("img").cast("string").alias("img"), F.col("voxel").cast("long").alias("voxel"), *[F.col(c).cast("int").alias(c) for c in "ijk"], "x")
    b = seeds.select(F.col("img").cast("string").alias("img"), F.col("label").cast("long").alias("label"), "x", F.col("voxel").cast("long").alias("voxel"))
    return a.groupBy("img").cogroup(b.groupBy("img")).applyInArrow(work, "img string, voxel long, label long")
