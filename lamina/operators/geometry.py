"""Transformations of points and images. A transformation is a 3 x 4 list of numbers, bound into expressions as literals."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

Matrix = list[list[float]]


def apply_matrix(m: Matrix, x: Column, y: Column, z: Column) -> list[Column]:
    return [F.lit(float(r[0])) * x + F.lit(float(r[1])) * y + F.lit(float(r[2])) * z + F.lit(float(r[3])) for r in m[:3]]


def transform_points(points: DataFrame, m: Matrix) -> DataFrame:
    """points(id, x, y, z) moved by m; a surface's vertices and electrodes are points too."""
    new = apply_matrix(m, F.col("x"), F.col("y"), F.col("z"))
    return points.select("id", *[c.alias(n) for c, n in zip(new, "xyz")], *[c for c in points.columns if c not in ("id", "x", "y", "z")])


def compose(outer: Matrix, inner: Matrix) -> Matrix:
    a, b = (np.vstack([np.array(m, float)[:3], [0, 0, 0, 1]]) for m in (outer, inner))
    return (a @ b)[:3].tolist()


def invert(m: Matrix) -> Matrix:
    return np.linalg.inv(np.vstack([np.array(m, float)[:3], [0, 0, 0, 1]]))[:3].tolist()


def sample(places: DataFrame, img: DataFrame, keys: list[str], dims: tuple[int, int, int], order: int = 1, background: float = 0.0, frame: list[str] | None = None) -> DataFrame:
    """keys, v: the image(i, j, k, v) at places(keys, sx, sy, sz) by nearest (order 0), linear (1) or cubic (3) interpolation.

    A place joins up to 1, 8 or 64 neighbours on their integer place and sums their weights; neighbours beyond the border
    are the border's. A place within half a voxel outside is clamped to the border, one farther away gets `background`.
    frame: columns of both sides that must be equal as well, such as t.
    """
    inside, frame = F.lit(True), frame or []
    for n, size in zip("xyz", dims):
        inside = inside & F.col(f"s{n}").between(-0.5, size - 0.5)
    g = places.select(*keys, *[f"s{n}" for n in "xyz"]).withColumn("inside", inside)
    for n, size in zip("xyz", dims):
        g = g.withColumn(f"s{n}", F.least(F.greatest(F.col(f"s{n}"), F.lit(0.0)), F.lit(float(size - 1))))
    at, weight = g.where("inside"), F.lit(1.0)
    for n, size in zip("xyz", dims):
        s = F.col(f"s{n}")
        at = at.withColumn(f"f{n}", F.floor(s + (0.5 if order == 0 else 0.0)).cast("int"))
        f = s - F.col(f"f{n}")
        shares = {
            0: [(0, F.lit(1.0))],
            1: [(0, 1 - f), (1, f)],
            3: [(-1, -0.5 * f * (f - 1) * (f - 1)), (0, 1 - 2.5 * f * f + 1.5 * f * f * f), (1, 0.5 * f + 2 * f * f - 1.5 * f * f * f), (2, 0.5 * f * f * (f - 1))],
        }[order]
        node = lambda k: F.least(F.greatest(F.col(f"f{n}") + k, F.lit(0)), F.lit(size - 1))  # noqa: E731, B023
        at = at.withColumn(f"o{n}", F.explode(F.array(*[F.struct(node(k).alias("p"), w.alias("w")) for k, w in shares])))
        weight = weight * F.col(f"o{n}.w")
    at = at.select(*keys, weight.alias("w"), *[F.col(f"o{n}.p").alias(f"p{n}") for n in "xyz"]).where("w <> 0")
    v = img.select(*frame, F.col("i").alias("px"), F.col("j").alias("py"), F.col("k").alias("pz"), "v")
    found = at.join(v, [*frame, "px", "py", "pz"]).groupBy(*keys).agg(F.sum(F.col("v") * F.col("w")).alias("v"))
    return g.select(*keys).join(found, keys, "left").select(*keys, F.coalesce("v", F.lit(background)).alias("v"))


def reslice(img: DataFrame, grid: DataFrame, m: Matrix, dims: tuple[int, int, int], linear: bool = True, background: float = 0.0, cubic: bool = False) -> DataFrame:
    """i, j, k, v of the output grid(i, j, k): the image at m applied to each place, sampled as in sample()."""
    src = apply_matrix(m, F.col("i").cast("double"), F.col("j").cast("double"), F.col("k").cast("double"))
    places = grid.select("i", "j", "k", *[c.alias(f"s{n}") for c, n in zip(src, "xyz")])
    return sample(places, img, ["i", "j", "k"], dims, 3 if cubic else int(linear), background)


def motion_reslice(frames: DataFrame, transforms: DataFrame, dims: tuple[int, int, int], order: int = 1, background: float = 0.0) -> DataFrame:
    """t, i, j, k, v of frames(t, i, j, k, v), each through its own transforms(t, m: 12 numbers by rows); frames without one are left out."""
    j = frames.select("t", "i", "j", "k").join(transforms, "t")
    at = [F.col(a).cast("double") for a in "ijk"]
    places = j.select("t", "i", "j", "k", *[(sum((F.col("m")[4 * r + c] * at[c] for c in range(3)), F.lit(0.0)) + F.col("m")[4 * r + 3]).alias(f"s{n}") for r, n in enumerate("xyz")])
    return sample(places, frames, ["t", "i", "j", "k"], dims, order, background, ["t"])


def round_trip_error(points: DataFrame, forward: Matrix, back: Matrix) -> DataFrame:
    """Root mean square distance of points(x, y, z) from themselves after both transformations: one row."""
    there = apply_matrix(forward, F.col("x"), F.col("y"), F.col("z"))
    again = apply_matrix(back, *there)
    return points.agg(F.sqrt(F.avg(sum(((c - F.col(n)) ** 2 for c, n in zip(again, "xyz")), F.lit(0.0)))).alias("rms"))


def quaternion(m: Matrix) -> tuple[list[float], float]:
    """(b, c, d) of the unit quaternion of a matrix's rotation with a >= 0, and the sign of its determinant; columns are scaled to length 1 first."""
    r = np.array(m, float)[:3, :3]
    r = r / np.linalg.norm(r, axis=0)
    side = 1.0 if np.linalg.det(r) > 0 else -1.0
    r[:, 2] *= side
    k = np.array([
        [r[0, 0] + r[1, 1] + r[2, 2], r[2, 1] - r[1, 2], r[0, 2] - r[2, 0], r[1, 0] - r[0, 1]],
        [r[2, 1] - r[1, 2], r[0, 0] - r[1, 1] - r[2, 2], r[0, 1] + r[1, 0], r[0, 2] + r[2, 0]],
        [r[0, 2] - r[2, 0], r[0, 1] + r[1, 0], r[1, 1] - r[0, 0] - r[2, 2], r[1, 2] + r[2, 1]],
        [r[1, 0] - r[0, 1], r[0, 2] + r[2, 0], r[1, 2] + r[2, 1], r[2, 2] - r[0, 0] - r[1, 1]],
    ])
    q = np.linalg.eigh(k)[1][:, -1]  # the leading eigenvector is the rotation nearest to r
    q = q if q[0] >= 0 else -q
    return q[1:].tolist(), side


def displacement(grid: DataFrame, m: Matrix) -> DataFrame:
    """dx, dy, dz = T(x) - x at each voxel."""
    new = apply_matrix(m, F.col("i").cast("double"), F.col("j").cast("double"), F.col("k").cast("double"))
    return grid.select("voxel", "i", "j", "k", *[(c - F.col(a)).alias(f"d{n}") for c, a, n in zip(new, "ijk", "xyz")])


def jacobian(field: DataFrame) -> DataFrame:
    """100 (det(I + grad d) - 1) by central differences of field(voxel, i, j, k, dx, dy, dz) inside the image, 0 on its border."""
    out, slopes = field, {}
    for axis in "ijk":
        w = Window.partitionBy(*[a for a in "ijk" if a != axis]).orderBy(axis)
        for n in "xyz":
            slopes[n, axis] = f"g{n}{axis}"
            out = out.withColumn(slopes[n, axis], (F.lead(f"d{n}").over(w) - F.lag(f"d{n}").over(w)) / 2)
    g = [[F.col(slopes[n, a]) + (1.0 if (n, a) in (("x", "i"), ("y", "j"), ("z", "k")) else 0.0) for a in "ijk"] for n in "xyz"]
    det = g[0][0] * (g[1][1] * g[2][2] - g[1][2] * g[2][1]) - g[0][1] * (g[1][0] * g[2][2] - g[1][2] * g[2][0]) + g[0][2] * (g[1][0] * g[2][1] - g[1][1] * g[2][0])
    return out.select("voxel", F.coalesce(100 * (det - 1), F.lit(0.0)).alias("v"))


def fit_landmarks(pairs: DataFrame, mode: str = "rigid") -> Matrix:
    """The least-squares rigid, similarity or affine matrix of pairs(x, y, z, u, v, w): centroids and moments are one aggregate row, solved here."""
    a, b = "xyz", "uvw"
    r = pairs.agg(F.count(F.lit(1)).alias("n"), *[F.avg(c).alias(f"m{c}") for c in a + b], *[F.avg(F.col(p) * F.col(q)).alias(f"{p}{q}") for p in a for q in a + b], *[F.avg(F.col(q) * F.col(q)).alias(f"{q}{q}") for q in b]).first()
    mean_a, mean_b = np.array([r[f"m{c}"] for c in a]), np.array([r[f"m{c}"] for c in b])
    cross = np.array([[r[f"{p}{q}"] for q in b] for p in a]) - np.outer(mean_a, mean_b)
    own = np.array([[r[f"{p}{q}"] for q in a] for p in a]) - np.outer(mean_a, mean_a)
    if mode == "affine":
        rot = np.linalg.solve(own, cross).T
    else:
        u, s, vt = np.linalg.svd(cross)
        flip = np.diag([1, 1, np.sign(np.linalg.det(vt.T @ u.T))])
        rot = vt.T @ flip @ u.T
        if mode == "similarity":
            rot = rot * (s * np.diag(flip)).sum() / np.trace(own)
    return np.column_stack([rot, mean_b - rot @ mean_a]).tolist()


def mapping_error(pairs: DataFrame, m: Matrix) -> DataFrame:
    """Mean and root mean square distance of m(x, y, z) from (u, v, w): one row."""
    new = apply_matrix(m, F.col("x"), F.col("y"), F.col("z"))
    d2 = sum(((c - F.col(n)) ** 2 for c, n in zip(new, "uvw")), F.lit(0.0))
    return pairs.agg(F.avg(F.sqrt(d2)).alias("mean"), F.sqrt(F.avg(d2)).alias("rms"))


def grid_points(points: DataFrame, grid: DataFrame, origin: tuple[float, float, float], spacing: tuple[float, float, float], dims: tuple[int, int, int], spline: bool = True) -> DataFrame:
    """points(id, x, y, z) moved by a grid of displacements(gi, gj, gk, dx, dy, dz).

    Each point meets the 64 nodes around it with cubic B-spline weights, or 8 with linear ones; beyond the border the
    nearest node counts. Every node of dims must be there.
    """
    p = points.select("id", "x", "y", "z")
    for a, o, s, n in zip("xyz", origin, spacing, dims):
        at = (F.col(a) - o) / s
        p = p.withColumn("_b", at.cast("int")).withColumn("_t", at - F.col("_b"))
        t = F.col("_t")
        cubic = [F.pow(1 - t, F.lit(3)) / 6, (3 * t * t * t - 6 * t * t + 4) / 6, (-3 * t * t * t + 3 * t * t + 3 * t + 1) / 6, t * t * t / 6]
        shares = list(zip((-1, 0, 1, 2), cubic)) if spline else [(0, 1 - t), (1, t)]
        node = lambda k: F.least(F.greatest(F.col("_b") + k, F.lit(0)), F.lit(n - 1))  # noqa: E731, B023
        p = p.withColumn(f"_{a}", F.explode(F.array(*[F.struct(node(k).alias("n"), w.alias("w")) for k, w in shares]))).drop("_b", "_t")
    p = p.select("id", "x", "y", "z", *[F.col(f"_{a}.n").alias(g) for a, g in zip("xyz", ("gi", "gj", "gk"))], (F.col("_x.w") * F.col("_y.w") * F.col("_z.w")).alias("w"))
    j = p.join(grid, ["gi", "gj", "gk"]).groupBy("id", "x", "y", "z")
    moved = j.agg(*[F.sum(F.col("w") * F.col(f"d{a}")).alias(f"m{a}") for a in "xyz"])
    return moved.select("id", *[(F.col(a) + F.col(f"m{a}")).alias(a) for a in "xyz"])


def rotation_scale(degrees: float, scale: tuple[float, float, float], centre: tuple[float, float, float]) -> Matrix:
    """The matrix that turns about k and scales, both about a centre; for reslice() it takes output places to input places."""
    a = np.deg2rad(degrees)
    m = np.array([[np.cos(a), -np.sin(a), 0], [np.sin(a), np.cos(a), 0], [0, 0, 1]]) @ np.diag(scale)
    return np.column_stack([m, np.array(centre) - m @ np.array(centre)]).tolist()


# --- chains of transformations ------------------------------------------------------------------------------------------


def grid_step(nodes: DataFrame, origin: tuple[float, float, float], spacing: tuple[float, float, float], dims: tuple[int, int, int], spline: bool = True) -> tuple:
    """A step of move_points(): a grid of displacements, as grid_points() takes it."""
    return nodes, origin, spacing, dims, spline


def combo(linear: Matrix, grids: list[tuple]) -> list:
    """The steps of a linear transformation with grids before it: the last grid moves a point first, the matrix last."""
    return [*reversed(grids), linear]


def move_points(points: DataFrame, steps: list) -> DataFrame:
    """points(id, x, y, z, ...) moved by steps one after the other, each a 3 x 4 matrix or a grid_step(); other columns stay.

    Matrices that follow one another become one projection; a grid is one join. Vertices of surfaces and electrodes are points too.
    """
    more = [c for c in points.columns if c not in ("id", "x", "y", "z")]
    now, k = points.select("id", "x", "y", "z"), 0
    while k < len(steps):
        if isinstance(steps[k], tuple):
            now, k = grid_points(now, *steps[k]), k + 1
            continue
        m = steps[k]
        while k + 1 < len(steps) and not isinstance(steps[k + 1], tuple):
            m, k = compose(steps[k + 1], m), k + 1
        now, k = transform_points(now, m), k + 1
    return now.join(points.select("id", *more), "id") if more else now


def chain_displacement(grid: DataFrame, steps: list, spacing: tuple[float, float, float] = (1.0, 1.0, 1.0)) -> DataFrame:
    """voxel, i, j, k, dx, dy, dz: how far steps move each place of an image(voxel, i, j, k) with a spacing, in millimetres."""
    at = grid.select(F.col("voxel").alias("id"), "i", "j", "k", *[(F.col(a) * float(s)).alias(n) for a, n, s in zip("ijk", "xyz", spacing)])
    moved = move_points(at.select("id", "x", "y", "z"), steps).select("id", *[F.col(n).alias(f"m{n}") for n in "xyz"])
    return at.join(moved, "id").select(F.col("id").alias("voxel"), "i", "j", "k", *[(F.col(f"m{n}") - F.col(n)).alias(f"d{n}") for n in "xyz"])


def chain_jacobian(grid: DataFrame, steps: list, spacing: tuple[float, float, float] = (1.0, 1.0, 1.0), nonlinear_only: bool = False) -> DataFrame:
    """voxel, v: 100 (det - 1) of a chain of steps inside an image, 0 on its border; spacing in millimetres.

    nonlinear_only: of a chain that ends with a matrix after grids (a combo) the matrix is left out; of others the mean determinant inside the image is
    taken off as well.
    """
    is_combo = len(steps) > 1 and not isinstance(steps[-1], tuple) and all(isinstance(s, tuple) for s in steps[:-1])
    field = chain_displacement(grid, steps[:-1] if nonlinear_only and is_combo else steps, spacing)
    scaled = field.select("voxel", "i", "j", "k", *[F.col(f"d{n}") for n in "xyz"])
    out, slopes, inner = scaled, {}, F.lit(True)
    for axis, s in zip("ijk", spacing):
        w = Window.partitionBy(*[a for a in "ijk" if a != axis]).orderBy(axis)
        for n in "xyz":
            out = out.withColumn(f"g{n}{axis}", (F.lead(f"d{n}").over(w) - F.lag(f"d{n}").over(w)) / (2 * float(s)))
            slopes[n, axis] = F.col(f"g{n}{axis}") + (1.0 if (n, axis) in (("x", "i"), ("y", "j"), ("z", "k")) else 0.0)
            inner = inner & F.col(f"g{n}{axis}").isNotNull()
    g = [[slopes[n, a] for a in "ijk"] for n in "xyz"]
    det = g[0][0] * (g[1][1] * g[2][2] - g[1][2] * g[2][1]) - g[0][1] * (g[1][0] * g[2][2] - g[1][2] * g[2][0]) + g[0][2] * (g[1][0] * g[2][1] - g[1][1] * g[2][0])
    out = out.select("voxel", F.when(inner, det).alias("det"))
    if nonlinear_only and not is_combo:
        out = out.crossJoin(F.broadcast(out.agg(F.avg("det").alias("mean"))))  # one row
    else:
        out = out.withColumn("mean", F.lit(0.0))
    return out.select("voxel", F.when(F.col("det").isNotNull(), 100 * (F.col("det") - 1 - F.col("mean"))).otherwise(0.0).alias("v"))
