"""Triangle meshes as vertices(id, x, y, z) and faces(id, v0, v1, v2): attributes, mirroring and smoothing by joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import keep


def face_table(vertices: DataFrame, faces: DataFrame) -> DataFrame:
    """id, v0, v1, v2, area, cx, cy, cz (centroid), nx, ny, nz (unit normal), obtuse of each face; a face without area has a normal of 0."""
    f = faces.select("id", "v0", "v1", "v2")
    for k in range(3):
        f = f.join(vertices.select(F.col("id").alias(f"v{k}"), *[F.col(c).alias(f"{c}{k}") for c in "xyz"]), f"v{k}")
    d = lambda a, b: [F.col(f"{c}{b}") - F.col(f"{c}{a}") for c in "xyz"]
    dot = lambda p, q: sum((x * y for x, y in zip(p, q)), F.lit(0.0))
    u, v = d(0, 1), d(0, 2)
    cross = [u[1] * v[2] - u[2] * v[1], u[2] * v[0] - u[0] * v[2], u[0] * v[1] - u[1] * v[0]]
    obtuse = (dot(u, v) < 0) | (dot(d(1, 0), d(1, 2)) < 0) | (dot(d(2, 0), d(2, 1)) < 0)
    f = f.select("id", "v0", "v1", "v2", *[((F.col(f"{c}0") + F.col(f"{c}1") + F.col(f"{c}2")) / 3).alias(f"c{c}") for c in "xyz"], *[x.alias(f"w{c}") for x, c in zip(cross, "xyz")], obtuse.alias("obtuse"))
    length = F.sqrt(dot(*[[F.col(f"w{c}") for c in "xyz"]] * 2))
    return f.withColumn("area", length / 2).select("id", "v0", "v1", "v2", "area", "cx", "cy", "cz", *[F.when(F.col("area") > 0, F.col(f"w{c}") / (2 * F.col("area"))).otherwise(0.0).alias(f"n{c}") for c in "xyz"], "obtuse")


def edge_table(faces: DataFrame) -> DataFrame:
    """a < b, n: each edge and how many faces share it; an edge of one face is on the border."""
    sides = F.array(*[F.struct(F.least(p, q).alias("a"), F.greatest(p, q).alias("b")) for p, q in (("v0", "v1"), ("v1", "v2"), ("v2", "v0"))])
    return faces.select(F.explode(sides).alias("e")).groupBy("e.a", "e.b").agg(F.count(F.lit(1)).alias("n"))


def vertex_normals(vertices: DataFrame, faces: DataFrame) -> DataFrame:
    """id, nx, ny, nz: the area-weighted mean of the normals around each vertex, of length 1 (0 where there are none)."""
    f = face_table(vertices, faces)
    each = f.select(F.explode(F.array("v0", "v1", "v2")).alias("id"), *[(F.col(f"n{c}") * F.col("area")).alias(c) for c in "xyz"])
    s = each.groupBy("id").agg(*[F.sum(c).alias(c) for c in "xyz"])
    length = F.sqrt(F.col("x") ** 2 + F.col("y") ** 2 + F.col("z") ** 2)
    return s.withColumn("n", length).select("id", *[F.when(F.col("n") > 0, F.col(c) / F.col("n")).otherwise(0.0).alias(f"n{c}") for c in "xyz"])


def flip_surface(vertices: DataFrame, faces: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The mesh mirrored in z, its faces wound the other way so that normals keep pointing outwards."""
    return vertices.withColumn("z", -F.col("z")), faces.select("id", "v0", F.col("v2").alias("v1"), F.col("v1").alias("v2"))


def relax(vertices: DataFrame, faces: DataFrame, rounds: int = 10, share: float = 0.5) -> DataFrame:
    """Each round moves a vertex by `share` towards the mean of its neighbours, which inflates folds; a vertex without edges stays."""
    e = edge_table(faces)
    both = keep(e.select("a", "b").unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b"))))
    now = vertices.select("id", "x", "y", "z")
    for r in range(rounds):
        near = both.join(now.withColumnRenamed("id", "b"), "b").groupBy(F.col("a").alias("id")).agg(*[F.avg(c).alias(f"m{c}") for c in "xyz"])
        now = now.join(near, "id", "left").select("id", *[(F.col(c) + share * (F.coalesce(f"m{c}", c) - F.col(c))).alias(c) for c in "xyz"])
        now = keep(now) if r < rounds - 1 else now
    return now


def vertex_curvature(vertices: DataFrame, faces: DataFrame) -> DataFrame:
    """id, area, curvature: the mixed area around each vertex off the border, and the length of its cotangent sum over twice that area.

    A triangle gives its Voronoi share, an obtuse one half of its area at the obtuse corner and a quarter at the others. Everything is
    a sum over triangles of terms for their three corners, so a vertex of many triangles is no group of rows.
    """
    f = face_table(vertices, faces).select("id", "v0", "v1", "v2", "area", "obtuse")
    for k in range(3):
        f = f.join(vertices.select(F.col("id").alias(f"v{k}"), *[F.col(c).alias(f"{c}{k}") for c in "xyz"]), f"v{k}")
    d = lambda a, b: [F.col(f"{c}{a}") - F.col(f"{c}{b}") for c in "xyz"]
    dot = lambda p, q: sum((x * y for x, y in zip(p, q)), F.lit(0.0))
    twice = F.when(F.col("area") > 0, 2 * F.col("area"))
    cot = [F.coalesce(dot(d((k + 1) % 3, k), d((k + 2) % 3, k)) / twice, F.lit(0.0)) for k in range(3)]  # at corner k
    corners = []
    for k in range(3):
        a, b = (k + 1) % 3, (k + 2) % 3
        share = (dot(d(k, a), d(k, a)) * cot[b] + dot(d(k, b), d(k, b)) * cot[a]) / 8
        blunt = F.when(dot(d(a, k), d(b, k)) < 0, F.col("area") / 2).otherwise(F.col("area") / 4)
        pull = [cot[b] * x + cot[a] * y for x, y in zip(d(k, a), d(k, b))]
        corners.append(F.struct(F.col(f"v{k}").alias("v"), F.when(F.col("obtuse"), blunt).otherwise(share).alias("s"), *[p.alias(c) for p, c in zip(pull, "xyz")]))
    s = f.select(F.explode(F.array(*corners)).alias("c")).groupBy("c.v").agg(F.sum("c.s").alias("area"), *[F.sum(f"c.{c}").alias(c) for c in "xyz"])
    border = edge_table(faces).where("n = 1").select(F.explode(F.array("a", "b")).alias("v")).distinct()
    length = F.sqrt(F.col("x") ** 2 + F.col("y") ** 2 + F.col("z") ** 2)
    return s.join(border, "v", "left_anti").where("area > 0").select(F.col("v").alias("id"), "area", (length / F.col("area") / 2).alias("curvature"))


def mean_curvature(vertices: DataFrame, faces: DataFrame) -> DataFrame:
    """k, one row: the root of the vertices' curvatures' sum over 4 pi."""
    return vertex_curvature(vertices, faces).agg(F.sqrt(F.coalesce(F.sum("curvature"), F.lit(0.0)) / (4 * F.pi())).alias("k"))
