"""Projections onto planes: the surface that a ray meets, means over a window behind it, shading by the gradient; pairs of plane and image points."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import keep
from .geometry import Matrix, apply_matrix, reslice
from .spatial import gradient, smooth

DARKEST = 0.1  # a fixed value: shading is never below it


def other_axes(axis: str) -> list[str]:
    return [a for a in "ijk" if a != axis]


def surface(img: DataFrame, axis: str, above: float, backwards: bool = False) -> DataFrame:
    """The two other axes and hit: where a ray from the axis's end (never its first plane; backwards: from its start) first meets a v above a threshold."""
    seen = img.where(F.col("v") > above)
    seen = seen if backwards else seen.where(F.col(axis) > 0)
    return seen.groupBy(*other_axes(axis)).agg((F.min(axis) if backwards else F.max(axis)).alias("hit"))


def project_shaded(img: DataFrame, axis: str, dims: tuple[int, int, int], above: float = 0.5, window: int = 1, backwards: bool = False, sigma: float = 0.0, shade: float = 0.0, mask: DataFrame | None = None, upside_down: bool = False) -> DataFrame:
    """first, second[, t], v: the mean of `window` voxels behind the surface that each ray meets, 0 where it meets none.

    img(voxel, i, j, k[, t], v) is smoothed by sigma (0: not at all) and, if it has frames, averaged over them to find the surface;
    each frame is then projected through it. shade: width of the gradient (0.1 and less: no shading) whose share along the ray, at the
    window's lower end, darkens a ray. mask(voxel, m): the surface and its gradient are those of the mask (above 0.5), the image is not
    smoothed. upside_down: the second axis, if it is k, runs from its end.
    """
    frame = [c for c in ("t",) if c in img.columns]
    a, b = other_axes(axis)
    n = dims["ijk".index(axis)]
    img = img.select("voxel", "i", "j", "k", *frame, "v")
    if mask is None and sigma > 0:
        img = smooth(img, sigma, tuple(frame), 2.0)
    img = keep(img)
    if mask is None:
        still = img.groupBy("voxel", "i", "j", "k").agg(F.avg("v").alias("v")) if frame else img
    else:
        still, above = img.select("voxel", "i", "j", "k").distinct().join(mask.select("voxel", F.col("m").cast("double").alias("v")), "voxel"), 0.5
    still = keep(still)
    low = F.col("hit") if backwards else F.greatest(F.col("hit") - (max(1, window) - 1), F.lit(0))
    high = F.least(F.col("hit") + (max(1, window) - 1), F.lit(n - 1)) if backwards else F.col("hit")
    hits = surface(still, axis, above, backwards).select(a, b, low.cast("int").alias("low"), high.cast("int").alias("high"))
    if shade > 0.1:
        g = still.select("voxel", "i", "j", "k").join(gradient(still, shade, 2.0), "voxel")
        size = F.sqrt(F.col("gi") ** 2 + F.col("gj") ** 2 + F.col("gk") ** 2)
        along = F.when(size > 0, (-1 if backwards else 1) * F.col(f"g{axis}") / size).otherwise(F.lit(DARKEST))
        hits = hits.join(g.select(a, b, F.col(axis).alias("low"), F.greatest(along, F.lit(DARKEST)).alias("light")), [a, b, "low"])
    else:
        hits = hits.withColumn("light", F.lit(1.0))
    near = img.join(hits, [a, b]).where(F.col(axis).between(F.col("low"), F.col("high")))
    mean = near.groupBy(a, b, *frame).agg((F.first("light") * F.sum("v") / F.first(F.col("high") - F.col("low") + 1)).alias("v"))
    rays = img.select(a, b, *frame).distinct().join(mean, [a, b, *frame], "left")
    second = F.lit(dims["ijk".index(b)] - 1) - F.col(b) if upside_down and b == "k" else F.col(b)
    return rays.select(F.col(a).alias("first"), second.cast("int").alias("second"), *frame, F.coalesce("v", F.lit(0.0)).alias("v"))


def project_resliced(img: DataFrame, m: Matrix, axis: str, dims: tuple[int, int, int], **how) -> DataFrame:
    """project_shaded of the image turned by m: rays of a rotated view. m takes a place of the view to one of the image."""
    turned = keep(reslice(img, img.select("i", "j", "k"), m, dims))
    voxel = F.col("i") + dims[0] * (F.col("j") + dims[1] * F.col("k"))
    return project_shaded(turned.select(voxel.cast("long").alias("voxel"), "i", "j", "k", "v"), axis, dims, **how)


def point_pairs(img: DataFrame, axis: str, dims: tuple[int, int, int], above: float, there: Matrix, plane: Matrix, height: int, pixel: float, spacing: tuple[float, float, float] = (1.0, 1.0, 1.0), depth: int = 0, backwards: bool = False, second_down: bool = False) -> DataFrame:
    """first, second, x, y: each ray of a projection that meets the surface, and the point of a flat image that shows it.

    The surface point, `depth` voxels further on the axis, in millimetres is moved by `there`, laid on the plane of the two other axes (the
    second one counted from the top of `height` pixels of size `pixel`) and moved by `plane`. second_down: rays count the
    second axis from its end. Points that depth moves before the first plane are left out.
    """
    a, b = other_axes(axis)
    s = dict(zip("ijk", spacing))
    hits = surface(img, axis, above, backwards).withColumn("third", F.col("hit") + depth).where("third >= 0")
    place = {a: F.col(a) * s[a], b: F.col(b) * s[b], axis: F.col("third") * s[axis]}
    moved = dict(zip("ijk", apply_matrix(there, *(place[c].cast("double") for c in "ijk"))))
    final = apply_matrix(plane, moved[a], F.lit((height - 1) * pixel) - moved[b], F.lit(0.0))
    second = F.lit(dims["ijk".index(b)] - 1) - F.col(b) if second_down else F.col(b)
    return hits.select(F.col(a).cast("int").alias("first"), second.cast("int").alias("second"), final[0].alias("x"), final[1].alias("y"))


def project_map(pairs: DataFrame, flat: DataFrame, spacing: tuple[float, float]) -> DataFrame:
    """first, second[, t], v: values of a flat image(i, j[, t], v) scattered to the rays that point_pairs() joined with its pixels.

    Places are rounded to pixels; pairs outside the flat image are left out. Several pairs of one ray: the one of the largest
    pixel (j, then i) stays.
    """
    near = lambda c, s: (c / s + 0.5).cast("int")
    at = pairs.select(near(F.col("first"), 1).alias("first"), near(F.col("second"), 1).alias("second"), near(F.col("x"), spacing[0]).alias("i"), near(F.col("y"), spacing[1]).alias("j"))
    frame = [c for c in ("t",) if c in flat.columns]
    inside = at.join(flat.select("i", "j").distinct(), ["i", "j"])
    one = inside.groupBy("first", "second").agg(F.max(F.struct("j", "i")).alias("p")).select("first", "second", "p.i", "p.j")
    return one.join(flat.select("i", "j", *frame, "v"), ["i", "j"]).select("first", "second", *frame, "v")
