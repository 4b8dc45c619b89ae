"""Slice bias: neighbouring slices are fitted to one another where the image is smooth, and the scale is carried outwards from the middle.

Fits are sums over pairs of neighbouring slices (one aggregate), the scales a running product over slices (one window), both in Spark.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import keep
from .spatial import smooth

#: Fixed values of the method: weights count above 750 of 1000; scales stay within 2/3 and 3/2; directions agree above 0.5; a fit needs 1 in 20 pixels.
SURE, LEAST, MOST, AGREE, SHARE = 750.0, 0.666, 1.5, 0.5, 20


def smoothness(img: DataFrame, dims: tuple[int, int, int]) -> DataFrame:
    """voxel, i, j, k, v, w: w is 1000 where the smoothed image has no curvature and falls towards 0 where it has the most; 1000 on the border."""
    s = smooth(img.select("voxel", "i", "j", "k", "v"), 1.0)
    bend, inner = F.lit(0.0), F.lit(True)
    for a, n in zip("ijk", dims):
        around = Window.partitionBy(*[b for b in "ijk" if b != a]).orderBy(a)
        s = s.withColumn(f"_{a}", 2 * F.col("v") - F.lag("v").over(around) - F.lead("v").over(around))
        bend, inner = bend + F.col(f"_{a}") ** 2, inner & F.col(a).between(1, n - 2)
    s = s.select("voxel", F.when(inner, F.sqrt(bend)).otherwise(0.0).alias("bend"))
    top = s.agg(((F.max("bend") * 0.1) ** 2).alias("s2"))  # one row
    s = s.crossJoin(F.broadcast(top)).select("voxel", (1000 * (1 - F.col("bend") ** 2 / (F.col("bend") ** 2 + F.col("s2") + 0.001))).alias("w"))
    return img.select("voxel", "i", "j", "k", "v").join(s, "voxel")


def slice_scales(img: DataFrame, axis: str, dims: tuple[int, int, int], above: float) -> DataFrame:
    """axis, b: how much brighter each slice is than the middle one; one row a slice but the middle."""
    rest = [a for a in "ijk" if a != axis]
    n = dims["ijk".index(axis)]
    middle, pixels = n // 2, dims["ijk".index(rest[0])] * dims["ijk".index(rest[1])]
    w = keep(smoothness(img, dims))
    near = w.select(F.when(F.col(axis) >= middle, F.col(axis) + 1).alias("out"), F.when(F.col(axis) <= middle, F.col(axis) - 1).alias("in"), *rest, F.col("v").alias("x"), F.col("w").alias("wx"))
    near = near.select(F.explode(F.array_compact(F.array("out", "in"))).alias(axis), *rest, "x", "wx")
    both = w.join(near, [axis, *rest]).where((F.col("x") > above) & (F.col("v") > above))
    sure = (F.col("w") > SURE) & (F.col("wx") > SURE)
    part = lambda e: F.sum(F.when(sure, e))
    x, y = F.col("x"), F.col("v")
    sums = both.groupBy(axis).agg(part(F.lit(1.0)).alias("n"), part(x).alias("sx"), part(y).alias("sy"), part(x * y).alias("sxy"), part(x * x).alias("sxx"), part(y * y).alias("syy"))
    n_, sx, sy, sxy, sxx, syy = (F.col(c) for c in ("n", "sx", "sy", "sxy", "sxx", "syy"))
    enough = n_ > pixels // SHARE
    slope = lambda d, s: F.when(enough, F.try_divide(d, s)).when(~enough | n_.isNull(), F.lit(1.0))
    fit = sums.select(axis, slope(n_ * sxy - sx * sy, n_ * sxx - sx * sx).alias("b"), slope(n_ * sxy - sx * sy, n_ * syy - sy * sy).alias("back"))
    mean = 0.5 * (F.col("b") + 1 / F.col("back"))
    step = F.when(F.col("b") * F.col("back") > AGREE, F.least(F.greatest(mean, F.lit(LEAST)), F.lit(MOST))).otherwise(F.lit(1.0))
    slices = img.sparkSession.range(n).select(F.col("id").cast("int").alias(axis)).where(F.col(axis) != middle)
    steps = slices.join(fit.select(axis, step.alias("step")), axis, "left").withColumn("step", F.coalesce("step", F.lit(1.0)))
    outwards = Window.partitionBy(F.col(axis) > middle).orderBy(F.abs(F.col(axis) - middle)).rowsBetween(Window.unboundedPreceding, 0)
    return steps.select(axis, F.product("step").over(outwards).alias("b"))


def slice_bias(img: DataFrame, axis: str, dims: tuple[int, int, int], threshold: float = 0.05) -> DataFrame:
    """voxel, i, j, k, v (corrected), bias (100: none) of img(voxel, i, j, k, v), along one axis.

    v of a slice = b times v of the slice nearer to the middle, fitted both ways over voxels above the threshold (a share of
    the range) that are smooth in both; where the directions disagree or too few voxels are left, b is 1. The corrected image
    keeps the sum of the corrected voxels. An image of one slice is unchanged.
    """
    img = img.select("voxel", "i", "j", "k", F.col("v").cast("double").alias("v"))
    if dims["ijk".index(axis)] < 2:
        return img.withColumn("bias", F.lit(100.0))
    low, high = img.agg(F.min("v"), F.max("v")).first()
    if low is None:
        return img.withColumn("bias", F.lit(100.0))
    above = threshold * high + (1 - threshold) * low
    scale = F.broadcast(slice_scales(img, axis, dims, above))  # one row a slice
    x = img.join(scale, axis, "left").withColumn("x", F.when((F.col("v") > above) & F.col("b").isNotNull(), F.col("v") / F.col("b")).otherwise(F.col("v")))
    moved = F.col("b").isNotNull() & (F.col("v") > above)
    whole = x.agg(F.coalesce(F.try_divide(F.sum(F.when(moved, F.col("v"))), F.sum(F.when(moved, F.col("x")))), F.lit(1.0)).alias("s"))  # one row
    x = x.crossJoin(F.broadcast(whole)).withColumn("y", F.col("x") * F.col("s"))
    bias = F.when(F.col("y") > 0, 100 * F.col("v") / F.col("y")).otherwise(F.lit(100.0))
    fixed = F.when(F.col("bias") > 0, 100 * F.col("v") / F.col("bias")).otherwise(F.lit(0.0))
    return x.withColumn("bias", bias).withColumn("v", fixed).select("voxel", "i", "j", "k", "v", "bias")


def triple_slice_bias(img: DataFrame, dims: tuple[int, int, int], threshold: float = 0.05, rounds: int = 1, settled: float = 0.0) -> DataFrame:
    """slice_bias along i, then j, then k of the image corrected so far; bias is that of all. Rounds are repeated until no voxel changes by more than `settled`, a share of its value."""
    now = img.select("voxel", "i", "j", "k", F.col("v").cast("double").alias("v"))
    for r in range(rounds):
        before = now
        for axis in "ijk":
            now = keep(slice_bias(now, axis, dims, threshold).drop("bias"))
        if r < rounds - 1 and settled > 0:
            far = F.max(F.abs(F.col("v") - F.col("was")) / F.greatest(F.abs("was"), F.lit(1e-12)))
            if (now.join(before.select("voxel", F.col("v").alias("was")), "voxel").agg(far).first()[0] or 0.0) <= settled:
                break
    out = now.join(img.select("voxel", F.col("v").cast("double").alias("was")), "voxel")
    return out.select("voxel", "i", "j", "k", "v", F.when(F.col("v") > 0, 100 * F.col("was") / F.col("v")).otherwise(F.lit(100.0)).alias("bias"))


def masked_bias(img: DataFrame, mask: DataFrame, sigma: float, mean: float = 0.0) -> DataFrame:
    """voxel, v: the image over its smoothed version within a mask(voxel, m), scaled to a mean; 0 outside the mask.

    The smoothed image is divided by the smoothed mask, so that the border of the mask does not darken it.
    """
    on = img.join(mask.select("voxel", (F.col("m") > 0.5).cast("double").alias("m")), "voxel", "left").withColumn("m", F.coalesce("m", F.lit(0.0)))
    on = keep(on.select("voxel", "i", "j", "k", "v", "m"))
    own = on.where("m > 0").agg(F.avg("v")).first()[0]
    if own is None:
        return on.select("voxel", F.lit(0.0).alias("v"))
    a = smooth(on.select("voxel", "i", "j", "k", (F.col("v") * F.col("m")).alias("v")), sigma).select("voxel", F.col("v").alias("sv"))
    b = smooth(on.select("voxel", "i", "j", "k", F.col("m").alias("v")), sigma).select("voxel", F.col("v").alias("sm"))
    ratio = F.when(F.col("sm") > 0, F.col("sv") / F.col("sm") / own).otherwise(0.0) * F.col("m")
    out = on.join(a, "voxel").join(b, "voxel").withColumn("r", ratio)
    target = mean if mean > 0 else own
    change = target / own if abs(target / own - 1) > 0.1 else 1.0  # a fixed rule: small changes of the mean are not made
    return out.select("voxel", F.when(F.col("r") > 0, 100 * F.col("v") / F.col("r") * change).otherwise(F.lit(0.0)).alias("v"))


