"""Neighbourhoods of voxels. Gaussian kernels are separable: one window pass per axis, no explosion to neighbours."""

from __future__ import annotations

from math import exp

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import keep


def gaussian_kernel(sigma: float, factor: float = 1.5) -> list[float]:
    r = max(1, int(sigma * factor))
    w = [exp(-0.5 * (x / sigma) ** 2) for x in range(-r, r + 1)]
    return [x / sum(w) for x in w]


def gradient_kernel(sigma: float, factor: float = 1.5) -> list[float]:
    r = max(1, int(sigma * factor))
    w = [-x * exp(-(x**2) / (2 * sigma**2)) for x in range(-r, r + 1)]
    return [x / sum(map(abs, w)) for x in w]


def convolve(img: DataFrame, axis: str, kernel: list[float], frame: tuple[str, ...] = ()) -> DataFrame:
    """One pass along an axis; beyond the border the nearest voxel counts. frame: columns that tell images apart, such as t."""
    w = Window.partitionBy(*frame, *[a for a in "ijk" if a != axis]).orderBy(axis)
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    r = len(kernel) // 2
    out = F.lit(0.0)
    for x, c in zip(range(-r, r + 1), kernel):
        end = F.first("v").over(whole) if x < 0 else F.last("v").over(whole)
        near = F.col("v") if x == 0 else F.coalesce(F.lag("v", -x).over(w) if x < 0 else F.lead("v", x).over(w), end)
        out = out + c * near
    return img.withColumn("v", out)


def smooth(img: DataFrame, sigma: float, frame: tuple[str, ...] = (), factor: float = 1.5) -> DataFrame:
    for axis in "ijk":
        img = convolve(img, axis, gaussian_kernel(sigma, factor), frame)
    return img


def gradient(img: DataFrame, sigma: float, factor: float = 1.5) -> DataFrame:
    """gi, gj, gk of each voxel."""
    out = None
    for axis in "ijk":
        g = convolve(img, axis, gradient_kernel(sigma, factor)).select("voxel", F.col("v").alias(f"g{axis}"))
        out = g if out is None else out.join(g, "voxel")
    return out


def neighbours(img: DataFrame, radius: int, flat: bool) -> DataFrame:
    """Each voxel's place with the values of the voxels in its box (those inside the image). Both sides grow with the image: neither is broadcast."""
    d = F.sequence(F.lit(-radius), F.lit(radius))
    k = F.array(F.lit(0)) if flat else d
    box = img.select("i", "j", "k", F.col("v").alias("n")).select("n", "i", "j", "k", F.explode(d).alias("di")).select("*", F.explode(d).alias("dj")).select("*", F.explode(k).alias("dk"))
    box = box.select((F.col("i") + F.col("di")).alias("i"), (F.col("j") + F.col("dj")).alias("j"), (F.col("k") + F.col("dk")).alias("k"), "n")
    return img.select("voxel", "i", "j", "k").join(box.hint("merge"), ["i", "j", "k"])


def median_filter(img: DataFrame, radius: int = 1, flat: bool = True) -> DataFrame:
    """Value at 0-based place n/2 of the box (upper middle of an even number)."""
    v = F.sort_array(F.collect_list("n"))
    return neighbours(img, radius, flat).groupBy("voxel").agg(F.element_at(v, (F.size(v) / 2).cast("int") + 1).alias("v"))


def morphology(img: DataFrame, how: str, radius: int = 1, flat: bool = True) -> DataFrame:
    """erode, dilate or median (majority) of a 0/1 image over a box; out-of-image voxels are ignored."""
    n = neighbours(img, radius, flat).groupBy("voxel")
    v = {"erode": F.min("n"), "dilate": F.max("n"), "median": F.when(2 * F.sum("n") > F.count("n"), 1.0).otherwise(0.0)}[how]
    return n.agg(v.alias("v"))


def resample(img: DataFrame, step: float, size: dict[str, int]) -> DataFrame:
    """Linear interpolation at multiples of `step` voxels along i: each output place joins its two neighbours."""
    n = int((size["i"] - 1) / step) + 1
    place = img.select("j", "k").distinct().select("j", "k", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("o"))
    place = place.withColumn("x", F.col("o") * step).withColumn("i0", F.floor("x").cast("int"))
    pair = place.select("*", F.explode(F.array(F.lit(0), F.lit(1))).alias("d")).withColumn("i", F.least(F.col("i0") + F.col("d"), F.lit(size["i"] - 1)))
    weight = F.when(F.col("d") == 0, 1 - (F.col("x") - F.col("i0"))).otherwise(F.col("x") - F.col("i0"))
    return pair.join(img.select("i", "j", "k", "v"), ["i", "j", "k"]).groupBy(F.col("o").alias("i"), "j", "k").agg(F.sum(F.col("v") * weight).alias("v"))


def steps_forward(corners: bool) -> list[tuple[int, int, int]]:
    """One of each pair of opposite steps to a neighbour: 3 by faces, 13 with edges and corners."""
    if not corners:
        return [(1, 0, 0), (0, 1, 0), (0, 0, 1)]
    return [(a, b, c) for a in (-1, 0, 1) for b in (-1, 0, 1) for c in (-1, 0, 1) if (c, b, a) > (0, 0, 0)]


def label_block(table: pa.Table, steps: list[tuple[int, int, int]]) -> pa.Table:
    """voxel, i, j, k, piece of one block of the grid: piece is the smallest voxel of those connected inside the block."""
    voxel, *at = (table.column(c).to_numpy() for c in ("voxel", "i", "j", "k"))
    low = [x.min() for x in at]
    shape = tuple(int(x.max() - m) + 3 for x, m in zip(at, low))
    place = tuple(x - m + 1 for x, m in zip(at, low))
    none = np.iinfo(np.int64).max
    label = np.full(shape, none)
    label[place] = voxel
    inside = label < none
    while True:
        before = label.copy()
        for step in steps:
            for sign in (1, -1):
                np.minimum(label, np.roll(label, [sign * x for x in step], (0, 1, 2)), out=label)
                label[~inside] = none
        if np.array_equal(before, label):
            break
    return pa.table({"voxel": voxel, "i": at[0], "j": at[1], "k": at[2], "piece": label[place]})


def components(img: DataFrame, inside: Column, side: int = 32, corners: bool = False) -> DataFrame:
    """Components of the voxels where `inside` holds, connected by faces (corners: by edges and corners too): voxel, component (its smallest voxel).

    Blocks of side^3 voxels are labelled each in one task of bounded size; only neighbours in different blocks are joined, and
    components of the pieces' graph are found by minima with pointer jumping.
    """
    steps = steps_forward(corners)
    v = img.where(inside).select(F.col("voxel").cast("long"), *[F.col(c).cast("long") for c in "ijk"])
    block = [F.floor(F.col(c) / side).alias(f"b{c}") for c in "ijk"]
    piece = keep(v.select("*", *block).groupBy("bi", "bj", "bk").applyInArrow(lambda t: label_block(t, steps), "voxel long, i long, j long, k long, piece long"))
    other = piece.select(F.col("piece").alias("b"), "i", "j", "k")
    first, last = (lambda c: F.pmod(F.col(c), F.lit(side)) == 0), (lambda c: F.pmod(F.col(c), F.lit(side)) == side - 1)
    leaves = lambda step: F.when(sum((F.when(last(c) if x > 0 else first(c), 1).otherwise(0) for c, x in zip("ijk", step) if x), F.lit(0)) > 0, F.struct(*[F.lit(x).alias(f"d{c}") for c, x in zip("ijk", step)]))
    edge = piece.select(F.col("piece").alias("a"), "i", "j", "k", F.explode(F.array_compact(F.array(*[leaves(s) for s in steps]))).alias("s"))
    edge = edge.select("a", *[(F.col(c) + F.col(f"s.d{c}")).alias(c) for c in "ijk"])
    label = connected(edge.join(other, ["i", "j", "k"]).select("a", "b").distinct())
    out = piece.join(label.withColumnRenamed("id", "piece"), "piece", "left")
    return out.select("voxel", F.coalesce("component", "piece").alias("component"))


def connected(links: DataFrame, rounds: int = 100) -> DataFrame:
    """id, component of the ends of links(a, b): each takes the smallest label around it, then that label's label, until none changes."""
    both = keep(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    label = both.select(F.col("a").alias("id")).distinct().withColumn("component", F.col("id"))
    if not both.limit(1).count():
        return label
    for _ in range(rounds):
        seen = both.join(label.withColumnRenamed("id", "b"), "b").groupBy(F.col("a").alias("id")).agg(F.min("component").alias("m"))
        low = label.join(seen, "id").select("id", F.col("component").alias("was"), F.least("component", "m").alias("to"))
        new = keep(low.join(low.select(F.col("id").alias("to"), F.col("to").alias("to2")), "to").select("id", "was", F.least("to", "to2").alias("component")))
        label = new.select("id", "component")
        if not new.where("was <> component").limit(1).count():
            return label
    raise RuntimeError("components did not settle")


def cluster_threshold(img: DataFrame, above: float, least: int, both_signs: bool = False, largest_only: bool = False) -> DataFrame:
    """voxel, v: values of clusters of at least `least` voxels above a threshold (both_signs: below minus it as well, as clusters of their own), 0 elsewhere; largest_only keeps the largest, of equal ones that of the smallest voxel."""
    parts = [components(img, F.col("v") > above)] + ([components(img, F.col("v") < -above)] if both_signs else [])
    c = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    c = keep(c)
    size = c.groupBy("component").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
    if largest_only:
        size = size.orderBy(F.desc("n"), "component").limit(1)
    kept = c.join(size, "component").select("voxel", F.lit(True).alias("on"))
    return img.join(kept, "voxel", "left").select("voxel", F.when(F.col("on"), F.col("v")).otherwise(0.0).alias("v"))


def cluster_filter(img: DataFrame, least: float, size: int, corners: bool = True) -> DataFrame:
    """voxel, v: values of clusters of at least `size` voxels whose |v| is not below `least`, 0 elsewhere; size below 0 keeps the largest clusters.

    Values of either sign are one cluster where they touch, by faces, edges or corners (corners=False: faces only).
    """
    c = keep(components(img, F.abs("v") >= least, corners=corners))
    sizes = c.groupBy("component").agg(F.count(F.lit(1)).alias("n"))
    if size < 0:
        size = sizes.agg(F.max("n")).first()[0] or 0
    kept = c.join(sizes.where(F.col("n") >= size), "component").select("voxel", F.lit(True).alias("on"))
    return img.join(kept, "voxel", "left").select("voxel", F.when(F.col("on"), F.col("v")).otherwise(0.0).alias("v"))


def connect(img: DataFrame, seed: tuple[int, int, int], corners: bool = True) -> DataFrame:
    """voxel, v: 1 for the voxels above 0 that are connected with a seed place (i, j, k), 0 elsewhere; all 0 if the seed is not above 0."""
    c = keep(components(img, F.col("v") > 0, corners=corners))
    at = img.where(" and ".join(f"{a} = {int(x)}" for a, x in zip("ijk", seed))).select("voxel").join(c, "voxel").select("component")
    on = c.join(F.broadcast(at), "component", "left_semi").select("voxel", F.lit(True).alias("on"))  # one row
    return img.join(on, "voxel", "left").select("voxel", F.when(F.col("on"), 1.0).otherwise(0.0).alias("v"))


def cluster_peaks(img: DataFrame, above: float) -> DataFrame:
    """component, n, peak (its voxel of the largest value, the smallest of ties), v."""
    c = components(img, F.col("v") > above).join(img.select("voxel", "v"), "voxel")
    m = F.max(F.struct("v", (-F.col("voxel")).alias("o")))
    return c.groupBy("component").agg(F.count(F.lit(1)).alias("n"), m.alias("m")).select("component", "n", (-F.col("m.o")).alias("peak"), F.col("m.v").alias("v"))


def open_close(img: DataFrame, opening: bool) -> DataFrame:
    """Opening (erode, then dilate) or closing of a 0/1 image."""
    steps = ("erode", "dilate") if opening else ("dilate", "erode")
    first = keep(morphology(img, steps[0]))
    return morphology(img.drop("v").join(first.hint("merge"), "voxel"), steps[1])


def bilateral(img: DataFrame, radius: int, space: float, value: float, flat: bool = True, iterations: int = 1) -> DataFrame:
    """Mean over the box weighted by distance and by difference of value; repeated on its own result."""
    for _ in range(iterations - 1):
        img = img.drop("v").join(keep(bilateral(img, radius, space, value, flat)), "voxel")
    d = F.sequence(F.lit(-radius), F.lit(radius))
    box = img.select("voxel", "i", "j", "k", F.col("v").alias("own"), F.explode(d).alias("di")).select("*", F.explode(d).alias("dj")).select("*", F.explode(F.array(F.lit(0)) if flat else d).alias("dk"))
    box = box.select("voxel", "own", "di", "dj", "dk", (F.col("i") + F.col("di")).alias("i"), (F.col("j") + F.col("dj")).alias("j"), (F.col("k") + F.col("dk")).alias("k"))
    j = box.join(img.select("i", "j", "k", "v"), ["i", "j", "k"])
    d2 = F.col("di") ** 2 + F.col("dj") ** 2 + F.col("dk") ** 2
    w = F.exp(-d2 / (2 * space**2) - (F.col("v") - F.col("own")) ** 2 / (2 * value**2))
    return j.groupBy("voxel").agg((F.sum(w * F.col("v")) / F.sum(w)).alias("v"))


def patches(img: DataFrame, size: int, step: int) -> DataFrame:
    """pi, pj, pk, vals: ordered patches of size x size in each k plane, one every `step` voxels; a patch is complete."""
    last = F.floor((F.col("i") - 0) / step)
    p = img.withColumn("pi", F.explode(F.sequence(F.greatest(F.lit(0), F.ceil((F.col("i") - size + 1) / step)), last)))
    p = p.withColumn("pj", F.explode(F.sequence(F.greatest(F.lit(0), F.ceil((F.col("j") - size + 1) / step)), F.floor(F.col("j") / step))))
    vals = F.transform(F.array_sort(F.collect_list(F.struct("j", "i", "v"))), lambda x: x["v"])
    return p.groupBy("pi", "pj", F.col("k").alias("pk")).agg(vals.alias("vals")).where(F.size("vals") == size * size)


def smooth_labels(img: DataFrame, weight: float, iterations: int) -> DataFrame:
    """voxel, label: each voxel takes the label most frequent among its six neighbours, its own counting `weight` more; the smallest of ties. Repeated."""
    steps = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.lit(c).alias("c")) for a, b, c in ((1, 0, 0), (-1, 0, 0), (0, 1, 0), (0, -1, 0), (0, 0, 1), (0, 0, -1))]))
    now = img.select("voxel", "i", "j", "k", "label")
    for _ in range(iterations):
        vote = now.select("label", F.lit(1.0).alias("n"), "i", "j", "k", steps.alias("s")).select("label", "n", (F.col("i") + F.col("s.a")).alias("i"), (F.col("j") + F.col("s.b")).alias("j"), (F.col("k") + F.col("s.c")).alias("k"))
        vote = vote.unionByName(now.select("label", F.lit(float(weight)).alias("n"), "i", "j", "k"))
        best = vote.groupBy("i", "j", "k", "label").agg(F.sum("n").alias("n")).groupBy("i", "j", "k").agg(F.max_by("label", F.struct("n", -F.col("label"))).alias("label"))
        now = keep(now.select("voxel", "i", "j", "k").join(best, ["i", "j", "k"]))
    return now.select("voxel", "label")


def patch_vectors(img: DataFrame, dims: tuple[int, int, int], radius: tuple[int, int, int], step: tuple[int, int, int] = (1, 1, 1)) -> DataFrame:
    """voxel, vals: the values of each voxel's box in order of k, j, i; beyond the border the nearest voxel's."""
    box = img.select("voxel", "i", "j", "k")
    for axis, size, r, s in zip("ijk", dims, radius, step):
        box = box.withColumn(f"o{axis}", F.explode(F.sequence(F.lit(-r), F.lit(r)))).withColumn(axis, F.least(F.greatest(F.col(axis) + F.col(f"o{axis}") * s, F.lit(0)), F.lit(size - 1)))
    j = box.join(img.select("i", "j", "k", "v"), ["i", "j", "k"])
    vals = F.transform(F.array_sort(F.collect_list(F.struct("ok", "oj", "oi", "v"))), lambda x: x["v"])
    return j.groupBy("voxel").agg(vals.alias("vals"))
