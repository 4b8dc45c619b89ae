"""Distance matrices of voxels as rows (i, j, feature, dist), affinities from them, and what is computed from affinities."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import keep
from .joins import radius_pairs


def radius_matrix(points: DataFrame, radius: float) -> DataFrame:
    """i, j, feature, dist of points(id, x, y, z, label, f): squared differences of f and of place for all pairs of a label with
    0.01 < dist <= radius squared, in both directions, and a row of zeros for each point with itself."""
    pairs = radius_pairs(points, radius, "label", "f").where("d2 > 0.01")
    both = F.explode(F.array(F.struct(F.col("a").alias("i"), F.col("b").alias("j")), F.struct(F.col("b").alias("i"), F.col("a").alias("j"))))
    rows = pairs.select(both.alias("p"), "f2", "d2").select("p.i", "p.j", F.col("f2").alias("feature"), F.col("d2").alias("dist"))
    zero = F.lit(0.0)
    return rows.unionByName(points.select(F.col("id").alias("i"), F.col("id").alias("j"), zero.alias("feature"), zero.alias("dist")))


def sparse_matrix(points: DataFrame, best: int) -> DataFrame:
    """i, j, feature, dist of points(id, x, y, z, label, f): pairs of a label whose squared difference of f lies below (strictly)
    the one at rank `best`, counted from 0 among the point's others, and a row of zeros for each point with itself.

    The nearest by one feature stand next to each other in its order, so each point looks at `best` + 1 rows on either side
    and no pairs of a whole label are formed. A point with at most `best` others keeps them all.
    """
    w = Window.partitionBy("label").orderBy("f", "id")
    other = F.struct(F.col("id").alias("j"), *[F.col(c).alias(f"{c}b") for c in ("f", "x", "y", "z")])
    near = points.withColumn("near", F.concat(F.collect_list(other).over(w.rowsBetween(-best - 1, -1)), F.collect_list(other).over(w.rowsBetween(1, best + 1))))
    p = near.select(F.col("id").alias("i"), "f", "x", "y", "z", F.explode("near").alias("o")).select("i", "f", "x", "y", "z", "o.*")
    dist = sum(((F.col(c) - F.col(f"{c}b")) ** 2 for c in "xyz"), F.lit(0.0))
    p = p.select("i", "j", ((F.col("f") - F.col("fb")) ** 2).alias("feature"), dist.alias("dist"))
    by = Window.partitionBy("i").orderBy("feature", "j")
    at = F.max(F.when(F.col("rank") == best + 1, F.col("feature"))).over(Window.partitionBy("i"))
    p = p.withColumn("rank", F.row_number().over(by)).withColumn("cut", at).where("cut is null or feature < cut").select("i", "j", "feature", "dist")
    zero = F.lit(0.0)
    return p.unionByName(points.select(F.col("id").alias("i"), F.col("id").alias("j"), zero.alias("feature"), zero.alias("dist")))


def affinity(matrix: DataFrame, weight: float, sigma: float) -> DataFrame:
    """src, dst, w: the normalised affinity of a distance matrix.

    e = exp(-(feature + weight * dist) / (median * sigma)) with the median over pairs of different voxels; a voxel's scale is
    1 / sqrt(1 + sum of its e); the diagonal is scale squared times (e + 0.5), and each other row adds half of the scaled e
    to its place and to the mirrored one. The median is one number, found by Spark.
    """
    x = matrix.withColumn("d", F.col("feature") + weight * F.col("dist"))
    median = x.where("i <> j").agg(F.percentile("d", F.lit(0.5)).alias("m")).first()["m"]
    factor = 1 / (max(median or 0.0, 1e-5) * max(sigma, 1e-4))
    e = x.select("i", "j", F.exp(-F.col("d") * factor).alias("e"))
    scale = e.groupBy("i").agg((1 / F.sqrt(F.sum("e") + 1)).alias("s"))
    e = e.join(scale, "i").join(scale.select(F.col("i").alias("j"), F.col("s").alias("sj")), "j")
    one = F.col("s") * F.col("sj")
    own = e.where("i = j").select(F.col("i").alias("src"), F.col("j").alias("dst"), (one * (F.col("e") + 0.5)).alias("w"))
    half = e.where("i <> j").select("i", "j", (0.5 * one * F.col("e")).alias("w"))
    rest = half.select(F.col("i").alias("src"), F.col("j").alias("dst"), "w").unionByName(half.select(F.col("j").alias("src"), F.col("i").alias("dst"), "w"))
    return own.unionByName(rest.groupBy("src", "dst").agg(F.sum("w").alias("w")))


def eigenvectors(matrix: DataFrame, count: int, rounds: int = 40) -> tuple[DataFrame, list[float]]:
    """(node, xs) with `count` values of each node, and the eigenvalues: the leading eigenvectors of the symmetric (src, dst, w).

    Orthogonal iteration: a round is one join and one aggregate over the matrix; the driver sees count x count numbers only.
    """
    m = keep(matrix.select("src", "dst", "w"))
    start = F.array(*[F.cos(F.xxhash64("src", F.lit(k)).cast("double")) for k in range(count)])
    x = m.select("src").distinct().select(F.col("src").alias("node"), start.alias("xs"))
    gram = lambda a, b: [F.sum(F.col(a)[p] * F.col(b)[q]).alias(f"g{p}_{q}") for p in range(count) for q in range(count)]
    times = lambda xs, t: F.array(*[sum((F.col(xs)[p] * float(t[p, q]) for p in range(count)), F.lit(0.0)) for q in range(count)])
    values = np.zeros(count)
    for _ in range(rounds):
        g = np.array(x.agg(*gram("xs", "xs")).first()).reshape(count, count)
        value, vector = np.linalg.eigh(g)
        x = x.select("node", times("xs", vector / np.sqrt(value.clip(1e-30))).alias("xs"))
        y = m.join(x.withColumnRenamed("node", "dst"), "dst").groupBy(F.col("src").alias("node")).agg(F.array(*[F.sum(F.col("w") * F.col("xs")[k]) for k in range(count)]).alias("ys"))
        x = keep(x.join(y, "node"))
        small = np.array(x.agg(*gram("xs", "ys")).first()).reshape(count, count)
        values, turn = np.linalg.eigh((small + small.T) / 2)
        values, turn = values[::-1], turn[:, ::-1]
        unit, x = x.select("node", times("xs", turn).alias("xs")), x.select("node", times("ys", turn).alias("xs"))
    return unit, values.tolist()


def spectral_clusters(matrix: DataFrame, clusters: int, rounds: int = 20) -> DataFrame:
    """node, cluster of the affinity (src, dst, w), by power iteration clustering; diagonal entries take no part."""
    from pyspark.ml.clustering import PowerIterationClustering

    pairs = matrix.where("src < dst").select("src", "dst", "w")
    found = PowerIterationClustering(k=clusters, maxIter=rounds, weightCol="w", initMode="degree").assignClusters(pairs)
    return found.select(F.col("id").alias("node"), "cluster")


# --- individual parcels -----------------------------------------------------------------------------------------------


def unit_series(ser: DataFrame) -> DataFrame:
    """voxel, x ARRAY: each series (voxel, t, v) less its mean, scaled to length 1; a constant series is left out."""
    x = ser.groupBy("voxel").agg(F.transform(F.array_sort(F.collect_list(F.struct("t", "v"))), lambda p: p["v"]).alias("x"))
    mean = F.aggregate("x", F.lit(0.0), lambda s, v: s + v) / F.size("x")
    x = x.withColumn("mean", mean).withColumn("x", F.expr("transform(x, v -> v - mean)"))
    norm = F.sqrt(F.aggregate("x", F.lit(0.0), lambda s, v: s + v * v))
    return x.withColumn("norm", norm).where("norm > 1e-9").select("voxel", F.expr("transform(x, v -> v / norm)").alias("x"))


def inner(a: str, b: str):
    return F.aggregate(F.zip_with(a, b, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)


def exemplars(units: DataFrame, parcels: DataFrame) -> DataFrame:
    """label, voxel, x: of each parcel(voxel, label > 0) the voxel with the least sum of squared distances to its parcel; the smallest of ties.

    Between unit vectors that sum is 2 n - 2 <x, sum of the parcel>, so a parcel is summed once and no pairs are formed.
    """
    u = units.join(parcels.where("label > 0").select("voxel", "label"), "voxel")
    total = u.select("label", F.posexplode("x").alias("t", "v")).groupBy("label", "t").agg(F.sum("v").alias("v"))
    total = total.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("t", "v"))), lambda p: p["v"]).alias("total"))
    scored = u.join(total, "label").select("label", "voxel", "x", F.round(inner("x", "total"), 9).alias("near"))
    best = scored.groupBy("label").agg(F.max_by(F.struct("voxel", "x"), F.struct("near", -F.col("voxel"))).alias("b"))
    return best.select("label", "b.voxel", "b.x")


def refine_parcels(units: DataFrame, parcels: DataFrame, rounds: int = 1) -> DataFrame:
    """voxel, i, j, k, label: parcels regrown towards their exemplars from parcels(voxel, i, j, k, label).

    In a round each voxel may take the label of its own parcel or of one that touches it (six neighbours), whichever
    exemplar is nearest; the smallest label of ties. Borders move by a voxel a round, so a parcel grows from where it is.
    """
    best = exemplars(units, parcels).select(F.col("label").alias("to"), F.col("x").alias("e"))
    steps = F.array(*[F.struct(*[F.lit(v).alias(n) for v, n in zip(s, ("di", "dj", "dk"))]) for s in ((0, 0, 0), (1, 0, 0), (-1, 0, 0), (0, 1, 0), (0, -1, 0), (0, 0, 1), (0, 0, -1))])
    now = parcels.where("label > 0").select("voxel", "i", "j", "k", "label")
    for r in range(rounds):
        around = now.select(F.col("label").alias("to"), "i", "j", "k", F.explode(steps).alias("s"))
        around = around.select("to", *[(F.col(a) + F.col(f"s.d{a}")).alias(a) for a in "ijk"]).distinct()
        choice = now.join(around, ["i", "j", "k"]).join(units, "voxel").join(best, "to").select("voxel", "to", F.round(inner("x", "e"), 9).alias("near"))
        choice = choice.groupBy("voxel").agg((-F.max(F.struct("near", (-F.col("to")).alias("to")))["to"]).alias("new"))
        now = now.join(choice, "voxel", "left").select("voxel", "i", "j", "k", F.coalesce("new", "label").alias("label"))
        now = keep(now) if r < rounds - 1 else now
    return now
