"""Chains of operators on time series: voxel series cleaned for connectivity, region series with nuisance signals, two wavelengths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import keep
from . import temporal as T
from .spatial import smooth
from .statistics import roi_mean


def clean_voxels(ser: DataFrame, frames: int, motion: list[list[float]], low: float, high: float, rate: float, degree: int, inside: Column) -> DataFrame:
    """voxel, t, v of (voxel, t, v): motion regressed out, band-pass, drift removed, masked (0 outside), global signal regressed out.

    All but the last step keep a series in one row; smooth frames first with spatial.smooth where that is wanted.
    """
    w = T.drift_correct(T.butterworth(T.regress_out(T.wide(ser), motion), low=low, high=high, rate=rate), frames, degree)
    return T.global_regress(T.long(w).withColumn("v", F.when(inside, F.col("v")).otherwise(0.0)))


def clean_regions(ser: DataFrame, roi: Column, nuisance: DataFrame, low: float, high: float, rate: float, weights: list[float] | None = None) -> DataFrame:
    """roi, t, v: means of regions, low then high pass, less their weighted fit on the equally filtered nuisance(name, t, v) series.

    The filtered nuisance series are a small table (frames times names), taken to the driver as the design of the fit.
    """
    clean = lambda s, key: T.butterworth(T.wide(s, key), low=low, high=high, rate=rate)
    design = [list(r["ts"]) for r in clean(nuisance, "name").orderBy("name").collect()]
    signal = clean(roi_mean(ser, roi), "roi")
    out = T.regress_weighted(signal, design, weights or [1.0] * len(design[0])) if design else signal
    return T.long(out, "roi")


def two_wavelengths(ser: DataFrame) -> DataFrame:
    """voxel, t, v of (voxel, t, blue, uv, blue_f, uv_f): blue_f less beta times uv_f.

    beta is the fit of blue on uv through 0 after both filtered series have got back the mean that filtering took away.
    """
    w = Window.partitionBy("voxel")
    b = F.col("blue_f") + F.avg(F.col("blue") - F.col("blue_f")).over(w)
    u = F.col("uv_f") + F.avg(F.col("uv") - F.col("uv_f")).over(w)
    s = ser.withColumn("_b", b).withColumn("_u", u)
    uu = F.sum(F.col("_u") ** 2).over(w)
    beta = F.when(uu > 0, F.sum(F.col("_u") * F.col("_b")).over(w) / uu).otherwise(0.0)
    return s.select("voxel", "t", (F.col("blue_f") - beta * F.col("uv_f")).alias("v"))


def preprocess_optical(img: DataFrame, dims: tuple[int, int, int], flips: str = "", bias: bool = True, sigma: float = 1.0, factor: int = 1, high: float | None = 0.995, mask: DataFrame | None = None) -> DataFrame:
    """voxel, i, j, k, v (0..255) of an optical image(voxel, i, j, k, v): turned, bias-corrected along k, smoothed, thinned, normalised, masked, cut to a byte.

    flips: axes that run backwards in the wanted orientation. factor: every so many voxels are kept on each axis. high: the share of voxels
    below the largest value kept (None: no normalisation). mask(voxel, m), of the thinned image: what is not above 0 becomes 0; it comes from outside, as no
    segmentation is built here.
    """
    from .bias import slice_bias
    from .elementwise import reorient
    from .statistics import robust_range

    sizes = dict(zip("ijk", dims))
    place = lambda d: F.col("i") + d[0] * (F.col("j") + d[1] * F.col("k"))
    now = img.select("voxel", "i", "j", "k", F.col("v").cast("double").alias("v"))
    if flips:
        now = reorient(now, "ijk", flips, sizes).withColumn("voxel", place(dims))
    if bias:
        now = slice_bias(now, "k", dims).drop("bias")
    if sigma > 0.1:
        now = smooth(now, sigma)
    now = keep(now.select("voxel", "i", "j", "k", "v"))
    if factor > 1:
        dims = tuple(-(-n // factor) for n in dims)
        now = now.where(" and ".join(f"{a} % {factor} = 0" for a in "ijk")).select(*[(F.col(a) / factor).cast("int").alias(a) for a in "ijk"], "v").withColumn("voxel", place(dims))
    if high is not None:
        r = F.broadcast(robust_range(now, 0.0, high).select("lo", "hi"))  # one row
        cut = F.least(F.greatest(F.col("v"), F.col("lo")), F.col("hi"))
        now = now.crossJoin(r).withColumn("v", F.when(F.col("hi") > F.col("lo"), (cut - F.col("lo")) * 255 / (F.col("hi") - F.col("lo"))).otherwise(0.0)).drop("lo", "hi")
    if mask is not None:
        now = now.join(mask.select("voxel", (F.col("m") > 0).alias("_on")), "voxel", "left").withColumn("v", F.when(F.col("_on"), F.col("v")).otherwise(0.0)).drop("_on")
    return now.select("voxel", "i", "j", "k", F.floor(F.least(F.greatest(F.col("v"), F.lit(0.0)), F.lit(255.0)) + 0.5).cast("int").alias("v"))
