"""Perfusion images: normalisation, difference maps, clusters and their random-field probabilities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .spatial import cluster_peaks

#: One-tailed cuts of t with 13 degrees of freedom, by probability.
T_CUTS = {0.05: 1.76885, 0.01: 2.64951, 0.005: 3.00977, 0.001: 3.85352}
#: Voxels in one resel along each axis, and the smoothness (in voxels) that cluster sizes are divided by.
RESEL = (0.11627907, 0.120481928, 0.109289617)
SMOOTHNESS = 17.2 / 2 * 16.6 / 2 * 18.3 / 2


def normalize(img: DataFrame) -> DataFrame:
    """voxel, v: the mean of voxels above an eighth of the image's mean becomes 50; values of 40 or less become 0."""
    cut = img.agg((F.avg("v") / 8).alias("cut"))
    mean = img.crossJoin(F.broadcast(cut)).agg(F.avg(F.when(F.col("v") > F.col("cut"), F.col("v"))).alias("mean"))  # one row each
    scaled = F.col("v") * (50.0 / F.col("mean"))
    return img.crossJoin(F.broadcast(mean)).select("voxel", F.when(scaled > 40, scaled).otherwise(0.0).alias("v"))


def difference_map(first: DataFrame, second: DataFrame, sigma: DataFrame, mean: DataFrame | None = None) -> DataFrame:
    """voxel, v: (first - second [- mean]) / sigma where both images and sigma are above 0, else 0; all are (voxel, v)."""
    as_ = lambda df, name: df.select("voxel", F.col("v").alias(name))
    j = as_(sigma, "s").join(as_(first, "a"), "voxel").join(as_(second, "b"), "voxel")
    d = F.col("a") - F.col("b")
    if mean is not None:
        j, d = j.join(as_(mean, "m"), "voxel"), d - F.col("m")
    return j.select("voxel", F.when((F.col("s") > 0) & (F.col("a") > 0) & (F.col("b") > 0), d / F.col("s")).otherwise(0.0).alias("v"))


def resel_counts(img: DataFrame, dims: tuple[int, int, int]) -> DataFrame:
    """One row n, xe, ye, ze, xy, xz, yz, cubes (voxels, edges, faces and cubes of non-zero voxels before each axis's last plane) and r0..r3.

    A voxel learns of its seven successors by three window passes, one along each axis, that hand on a map of bits.
    """
    x = img.where(F.col("v") != 0).select("i", "j", "k", F.lit(1).alias("bits"))
    for n, axis in enumerate("ijk"):  # bits 0..2^n - 1 are known; the successor's become the next 2^n
        w = Window.partitionBy(*[a for a in "ijk" if a != axis]).orderBy(axis)
        after = F.when(F.lead(axis).over(w) == F.col(axis) + 1, F.lead("bits").over(w)).otherwise(0)
        x = x.withColumn("bits", F.col("bits") + F.shiftleft(after, 2**n))
    for axis, size in zip("ijk", dims):
        x = x.where(F.col(axis) < size - 1)

    def having(*places: int) -> Column:  # place: 1 for the next i, 2 for the next j, 4 for the next k, added up
        mask = sum(1 << p for p in places)
        return F.coalesce(F.sum(F.when(F.col("bits").bitwiseAND(mask) == mask, 1).otherwise(0)), F.lit(0))

    c = x.agg(
        F.count(F.lit(1)).alias("n"), having(1).alias("xe"), having(2).alias("ye"), having(4).alias("ze"),
        having(1, 2, 3).alias("xy"), having(1, 4, 5).alias("xz"), having(2, 4, 6).alias("yz"), having(*range(1, 8)).alias("cubes"),
    )
    n, xe, ye, ze, xy, xz, yz, q = (F.col(name) for name in ("n", "xe", "ye", "ze", "xy", "xz", "yz", "cubes"))
    a, b, d = RESEL
    return c.select(
        "*", (n - xe - ye - ze + xy + xz + yz - q).cast("double").alias("r0"),
        ((xe - xy - xz + q) * a + (ye - xy - yz + q) * b + (ze - yz - xz + q) * d).alias("r1"),
        ((xy - q) * (a * b) + (xz - q) * (a * d) + (yz - q) * (b * d)).alias("r2"), (q * (a * b * d)).alias("r3"),
    )


def euler_densities(p: float, t: float) -> list[float]:
    """Densities of dimension 0..3 of a t field with 13 degrees of freedom at a cut t of probability p."""
    f = (1 + t * t / 13) ** -6
    return [p, 0.2650 * f, 0.1727 * t * f, 0.1169 * f * (12 * t * t / 13 - 1)]


def cluster_probabilities(img: DataFrame, dims: tuple[int, int, int], p: float = 0.05, extent: int = 0, positive: bool = True) -> DataFrame:
    """component, n, peak, t, p_cluster, p_corrected of clusters of more than `extent` voxels beyond the cut of p.

    The probabilities follow from the cluster's size and from the clusters expected under the image's resel counts. The cut
    is that of the p named (one of T_CUTS); with positive=False clusters are those below minus the cut and t is negative.
    """
    cut = T_CUTS[p]
    e = euler_densities(p, cut)
    expected = resel_counts(img, dims).select(sum((F.col(f"r{k}") * e[k] for k in range(4)), F.lit(0.0)).alias("_m"))
    sign = 1.0 if positive else -1.0
    c = cluster_peaks(img.withColumn("v", F.col("v") * sign), cut).where(F.col("n") > extent)
    one = F.exp(-F.pow(1.3378 / (e[0] / e[3]) * F.col("n") / SMOOTHNESS, F.lit(2 / 3)))
    out = c.crossJoin(F.broadcast(expected)).withColumn("p_cluster", one)  # one row
    return out.select("component", "n", "peak", (F.col("v") * sign).alias("t"), "p_cluster", (1 - F.exp(-F.col("_m") * F.col("p_cluster"))).alias("p_corrected"))
