"""Projections of voxel relations: thresholds, scaling, masks, arithmetic of two images, cropping and moving of axes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def threshold(v: Column, low: float, high: float, replace_in: float | None = None, replace_out: float | None = 0.0, saturate: bool = False) -> Column:
    """low <= v <= high is inside. Inside becomes replace_in (None: v); outside replace_out (None: v), or `high` above it when saturating."""
    inside = v if replace_in is None else F.lit(float(replace_in))
    outside = v if replace_out is None else F.lit(float(replace_out))
    out = F.when(v.between(low, high), inside)
    return (out.when(v > high, F.lit(float(high))) if saturate else out).otherwise(outside)


def shift_scale(v: Column, shift: float, scale: float) -> Column:
    return (v + shift) * scale


def create_mask(img: DataFrame, fraction: float, value: int = 1) -> DataFrame:
    """1 where v reaches a fraction of the range; the range is one row, joined by a scalar."""
    r = img.agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    return img.crossJoin(F.broadcast(r)).select("voxel", F.when(F.col("v") >= F.col("lo") + fraction * (F.col("hi") - F.col("lo")), value).otherwise(0).alias("mask"))


def apply_mask(img: DataFrame, mask: DataFrame, least: float = 1, inverse: bool = False, outside: float = 0.0) -> DataFrame:
    """v where the mask reaches `least` (inverse: does not), else `outside`; a voxel without a mask row is outside."""
    keep = F.coalesce((F.col("mask") < least) if inverse else (F.col("mask") >= least), F.lit(False))
    return img.join(mask, "voxel", "left").withColumn("v", F.when(keep, F.col("v")).otherwise(outside)).drop("mask")


def combine(a: DataFrame, b: DataFrame, how: str, w1: float = 1.0, w2: float = 1.0, keys: tuple[str, ...] = ("voxel",)) -> DataFrame:
    """w1*a (add, subtract, multiply, divide) w2*b on equal keys; division by |w2*b| <= 0.001 gives 0."""
    x, y = w1 * F.col("a"), w2 * F.col("b")
    v = {"add": x + y, "subtract": x - y, "multiply": x * y, "divide": F.when(F.abs(y) > 0.001, x / y).otherwise(0.0)}[how]
    j = a.select(*keys, F.col("v").alias("a")).join(b.select(*keys, F.col("v").alias("b")), list(keys))
    return j.select(*keys, v.alias("v"))


def crop(img: DataFrame, box: dict[str, tuple[int, int, int]]) -> DataFrame:
    """Keep begin..end by stride on each axis and number the axis anew."""
    for axis, (a, b, step) in box.items():
        img = img.where(F.col(axis).between(a, b) & ((F.col(axis) - a) % step == 0)).withColumn(axis, ((F.col(axis) - a) / step).cast("int"))
    return img


def blank(img: DataFrame, box: dict[str, tuple[int, int]], outside: float = 0.0) -> DataFrame:
    inside = F.lit(True)
    for axis, (a, b) in box.items():
        inside = inside & F.col(axis).between(a, b)
    return img.withColumn("v", F.when(inside, F.col("v")).otherwise(outside))


def circle_blank(img: DataFrame, x: float, y: float, radius: float) -> DataFrame:
    return img.withColumn("v", F.when((F.col("i") - x) ** 2 + (F.col("j") - y) ** 2 <= radius**2, F.col("v")).otherwise(0.0))


def flip(img: DataFrame, axis: str, size: int) -> DataFrame:
    return img.withColumn(axis, size - 1 - F.col(axis))


def permute(img: DataFrame, order: str) -> DataFrame:
    """order 'kij': the new i, j, k are the old k, i, j."""
    return img.select("voxel", *[F.col(o).alias(n) for n, o in zip("ijk", order)], *[c for c in img.columns if c not in ("voxel", "i", "j", "k")])


def add_grid(img: DataFrame, gap: int, value: float) -> DataFrame:
    return img.withColumn("v", F.when((F.col("i") % gap == 0) | (F.col("j") % gap == 0), F.lit(float(value))).otherwise(F.col("v")))


def append(parts: list[tuple[DataFrame, int]], axis: str = "t") -> DataFrame:
    """Concatenate along an axis: each part with its length; offsets are running sums of the earlier lengths."""
    out, at = None, 0
    for df, n in parts:
        moved = df.withColumn(axis, (F.col(axis) + at).cast("int"))
        out, at = moved if out is None else out.unionByName(moved), at + n
    return out


def project(img: DataFrame, axis: str, how: str = "max") -> DataFrame:
    """Maximum or mean along an axis."""
    rest = [a for a in "ijk" if a != axis]
    return img.groupBy(*rest).agg((F.max("v") if how == "max" else F.avg("v")).alias("v"))


def first_hit(img: DataFrame, axis: str, above: float) -> DataFrame:
    """The first voxel along an axis whose value exceeds a threshold, and its value; rays without one are left out."""
    rest = [a for a in "ijk" if a != axis]
    return img.where(F.col("v") > above).groupBy(*rest).agg(F.min(axis).alias("depth"), F.min_by("v", axis).alias("v"))


def extract_slice(img: DataFrame, axis: str, at: int, size: int) -> DataFrame:
    """The plane at a place of an axis of `size` voxels: a negative place is the middle, one past the end the last."""
    place = size // 2 if at < 0 else min(at, size - 1)
    return img.where(F.col(axis) == place).select("voxel", *[a for a in "ijk" if a != axis], "v")


def reorient(img: DataFrame, axes: str, flips: str, sizes: dict[str, int]) -> DataFrame:
    """New axes i, j, k are the old axes in the order of `axes`; those named in flips run backwards."""
    out = [(F.lit(sizes[a] - 1) - F.col(a) if a in flips else F.col(a)).cast("int").alias(b) for a, b in zip(axes, "ijk")]
    return img.select("voxel", *out, "v")


def millimetres(img: DataFrame, spacing: tuple[float, float, float], origin: tuple[float, float, float]) -> DataFrame:
    """voxel, x, y, z: places in space under a spacing and an origin."""
    return img.select("voxel", *[(F.col(a) * s + o).alias(b) for a, b, s, o in zip("ijk", "xyz", spacing, origin)])


def back_project(img: DataFrame, flat: DataFrame, axis: str, above: float, window: int, backwards: bool = False) -> DataFrame:
    """voxel, v: values of a projection flat(two axes, v) laid on the surface that it shows, 0 elsewhere.

    A ray comes from the axis's end (never hitting its first plane; backwards: from its start) and stops at the first
    voxel above a threshold; that voxel and the window - 1 (1 at least) before it on the axis (backwards: after it) take
    the ray's value.
    """
    rest = [a for a in "ijk" if a != axis]
    seen = img.where(F.col("v") > above)
    seen = seen if backwards else seen.where(F.col(axis) > 0)
    hit = seen.groupBy(*rest).agg((F.min(axis) if backwards else F.max(axis)).alias("_hit")).join(flat.select(*rest, F.col("v").alias("_flat")), rest)
    r = max(1, window - 1)
    near = F.col(axis).between(F.col("_hit"), F.col("_hit") + r) if backwards else F.col(axis).between(F.col("_hit") - r, F.col("_hit"))
    return img.select("voxel", "i", "j", "k").join(hit, rest, "left").select("voxel", F.when(near, F.col("_flat")).otherwise(0.0).alias("v"))


def lowest(img: DataFrame) -> float:
    """The smallest v, which masks and boxes can write outside: one number."""
    return float(img.agg(F.min("v")).first()[0] or 0.0)


def crop_padded(img: DataFrame, box: dict[str, tuple[int, int]]) -> DataFrame:
    """i, j, k, v of a box that may reach outside the image, axes numbered anew; what the image lacks is 0."""
    grid = img.sparkSession.range(1)
    for axis, (a, b) in box.items():
        grid = grid.withColumn(axis, F.explode(F.sequence(F.lit(a), F.lit(b))))
    inside = img.where(" and ".join(f"{axis} between {a} and {b}" for axis, (a, b) in box.items())).select(*box, "v")
    full = grid.join(inside, list(box), "left")
    return full.select(*[(F.col(axis) - a).alias(axis) for axis, (a, _) in box.items()], F.coalesce("v", F.lit(0.0)).alias("v"))


def permute_mirrored(img: DataFrame, order: list[str], dims: dict[str, int]) -> DataFrame:
    """order ['K', 'Im', 'J']: the new i, j, k are the old k, the old i mirrored, and the old j."""
    axis = lambda o: dims[o[0].lower()] - 1 - F.col(o[0].lower()) if o.endswith("m") else F.col(o[0].lower())
    return img.select("voxel", *[axis(o).alias(n) for n, o in zip("ijk", order)], *[c for c in img.columns if c not in ("voxel", "i", "j", "k")])


def plane(img: DataFrame, axis: str, at: int, size: int) -> DataFrame:
    """One plane of an axis: below 0 is the middle, beyond the border the last."""
    return img.where(F.col(axis) == (size // 2 if at < 0 else min(at, size - 1)))


def label_counts_by_frame(frames: DataFrame, top: int) -> DataFrame:
    """t, label, n for every frame of (t, voxel, v) and every label 0..top, 0 where a frame has none of it."""
    have = frames.groupBy("t", F.round("v").cast("int").alias("label")).agg(F.count(F.lit(1)).alias("n"))
    every = frames.select("t").distinct().select("t", F.explode(F.sequence(F.lit(0), F.lit(top))).alias("label"))
    return every.join(have, ["t", "label"], "left").select("t", "label", F.coalesce("n", F.lit(0)).alias("n"))
