"""Transformations by round trips and known answers."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lamina.operators import geometry as M
from lamina.operators import graph as G
from lamina.operators import statistics as A


def test_landmarks(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(20, 3))
    q, _ = np.linalg.qr(rng.normal(size=(3, 3)))
    q *= np.sign(np.linalg.det(q))
    for mode, m in (("rigid", q), ("similarity", 1.7 * q), ("affine", rng.normal(size=(3, 3)))):
        y = x @ m.T + [1, 2, 3]
        pairs = spark.createDataFrame([tuple(map(float, (*a, *b))) for a, b in zip(x, y)], "x double, y double, z double, u double, v double, w double")
        got = M.fit_landmarks(pairs, mode)
        assert np.allclose(got, np.column_stack([m, [1, 2, 3]]), atol=1e-6)
        assert M.mapping_error(pairs, got).first()["mean"] < 1e-6


def test_inverse_and_composition():
    m = [[2.0, 0.1, 0, 1], [0, 1, 0.2, -1], [0.3, 0, 1, 5]]
    assert np.allclose(M.compose(m, M.invert(m)), np.eye(4)[:3])


def test_nearest_reslice_by_whole_voxels(spark):
    img = spark.range(60).select(F.col("id").alias("voxel"), (F.col("id") % 5).cast("int").alias("i"), F.floor(F.col("id") / 5 % 4).cast("int").alias("j"), F.floor(F.col("id") / 20).cast("int").alias("k"), F.col("id").cast("double").alias("v"))
    out = M.reslice(img, img.select("i", "j", "k"), [[1, 0, 0, 2], [0, 1, 0, 0], [0, 0, 1, 0]], (5, 4, 3), linear=False, background=-1.0)
    for r in out.collect():
        assert r.v == (r.i + 2 + 5 * r.j + 20 * r.k if r.i + 2 < 5 else -1.0)


def test_eigenvector(spark):
    a = np.array([[2.0, 1, 0], [1, 3, 1], [0, 1, 4]])
    e = spark.createDataFrame([(i, j, float(a[i, j])) for i in range(3) for j in range(3)], "src int, dst int, w double")
    x = np.array([r.x for r in G.leading_eigenvector(e, 25).orderBy("node").collect()])
    assert np.allclose(np.abs(x), np.abs(np.linalg.eigh(a)[1][:, -1]), atol=1e-3)


def test_fisher_z_ends(spark):
    r = spark.createDataFrame([(1.0,), (-1.0,), (0.0,)], "r double").select(A.fisher_z(F.col("r")).alias("z")).collect()
    assert [x.z for x in r] == [6.103, -6.103, pytest.approx(0)]


def test_chains_of_transformations(spark):
    """A grid and matrices one after the other, columns kept, and the mean taken off a nonlinear jacobian."""
    nodes = spark.createDataFrame([(i, j, k, 0.5 * i, 0.0, -0.25 * k) for i in range(3) for j in range(3) for k in range(3)], "gi int, gj int, gk int, dx double, dy double, dz double")
    grid = M.grid_step(nodes, (0, 0, 0), (2.0, 2.0, 2.0), (3, 3, 3), spline=False)
    shift, turn = [[1, 0, 0, 1], [0, 1, 0, 0], [0, 0, 1, 0]], [[0, -1, 0, 0], [1, 0, 0, 0], [0, 0, 2, 0]]
    points = spark.createDataFrame([(1, 1.0, 2.0, 3.0, "a")], "id long, x double, y double, z double, name string")
    r = M.move_points(points, [shift, turn, grid]).first()
    assert (r.name, r.x, r.y, r.z) == ("a", -2.0, 2.0, 6.0 - 0.5)  # (2, 2, 3) turned to (-2, 2, 6); beyond the grid the nearest node counts
    assert M.combo(shift, [grid, "later"]) == ["later", grid, shift]
    img = spark.range(125).selectExpr("id voxel", "cast(id % 5 as int) i", "cast(id div 5 % 5 as int) j", "cast(id div 25 as int) k")
    whole = {r.voxel: r.v for r in M.chain_jacobian(img, [[[2, 0, 0, 0], [0, 1, 0, 0], [0, 0, 1, 0]]], (1.0, 2.0, 0.5)).collect()}
    assert whole[62] == pytest.approx(100) and whole[0] == 0 and sum(v != 0 for v in whole.values()) == 27
    off = {r.voxel: r.v for r in M.chain_jacobian(img, [[[2, 0, 0, 0], [0, 1, 0, 0], [0, 0, 1, 0]]], nonlinear_only=True).collect()}
    assert off[62] == pytest.approx(-100)


def test_curvature_of_an_octahedron_like_cap(spark):
    from lamina.operators import surfaces

    top, n = (0.0, 0.0, 0.5), 8
    ring = [(float(np.cos(2 * np.pi * k / n)), float(np.sin(2 * np.pi * k / n)), 0.0) for k in range(n)]
    v = spark.createDataFrame([(k, *p) for k, p in enumerate([top, *ring])], "id long, x double, y double, z double")
    f = spark.createDataFrame([(k, 0, 1 + k, 1 + (k + 1) % n) for k in range(n)], "id long, v0 long, v1 long, v2 long")
    out = surfaces.vertex_curvature(v, f).collect()
    a, b, c = (np.array(p) for p in (top, ring[0], ring[1]))
    cot = lambda p, q, r: np.dot(q - p, r - p) / np.linalg.norm(np.cross(q - p, r - p))
    pull = sum((cot(c, a, b) + cot(c, a, b)) * (a - np.array(p)) for p in ring)
    area = n * 2 * np.dot(a - b, a - b) * cot(c, a, b) / 8
    assert [r.id for r in out] == [0] and out[0].area == pytest.approx(area) and out[0].curvature == pytest.approx(np.linalg.norm(pull) / area / 2)
    assert surfaces.mean_curvature(v, f).first().k == pytest.approx(np.sqrt(out[0].curvature / 4 / np.pi))


def test_converter_date(spark):
    from lamina.functions import scalar

    df = spark.createDataFrame([("a_20240102030405_s3.nii.gz",), ("plain.nii",)], "n string")
    assert [r.d for r in df.select(scalar.converter_date(F.col("n")).alias("d")).collect()] == ["20240102030405", "no-date"]
