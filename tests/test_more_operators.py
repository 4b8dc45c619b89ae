"""Distributions, parcels and surfaces against known answers."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lamina.functions import distributions as D
from lamina.operators import parcels
from lamina.sources import files


def test_distributions(spark):
    assert D.t_tail(np.array([2.228, 0.0]), 10) == pytest.approx([0.05, 1.0], abs=1e-4)
    assert D.z_tail(np.array([1.959964])) == pytest.approx([0.05], abs=1e-6)
    r = spark.createDataFrame([(2.228,)], "t double").select(D.t_to_p(F.col("t"), 10).alias("p"), D.t_to_z(F.col("t"), 10).alias("z"), D.p_to_t(F.lit(0.05), 10).alias("t"), D.p_to_z(F.lit(0.05)).alias("zz"), D.z_to_p(F.lit(1.959964)).alias("zp")).first()
    assert (r.p, r.z, r.t, r.zz, r.zp) == (pytest.approx(0.05, abs=1e-4), pytest.approx(1.96, abs=1e-3), pytest.approx(2.228, abs=1e-3), pytest.approx(1.96, abs=1e-3), pytest.approx(0.05, abs=1e-6))


def test_runs(spark):
    rows = [(0, i, x) for i, x in enumerate([1, 1, 2, 2, 2, 1])]
    got = sorted(map(tuple, parcels.runs(spark.createDataFrame(rows, "part int, node int, lobe int")).select("first", "last", "lobe", "n").collect()))
    assert got == [(0, 1, 1, 2), (2, 4, 2, 3), (5, 5, 1, 1)]


def test_surfaces(spark, tmp_path):
    (tmp_path / "a.ply").write_text("ply\nformat ascii 1.0\nelement vertex 3\nproperty float x\nelement face 1\nend_header\n0 0 0\n1 0 0\n0 1 0.5\n3 0 1 2\n")
    (tmp_path / "b.vtk").write_text("# vtk DataFile Version 3.0\nsurface\nASCII\nDATASET POLYDATA\nPOINTS 3 float\n0 0 0 1 0 0\n0 1 0.5\nPOLYGONS 1 4\n3 0 1 2\n")
    for name in ("a.ply", "b.vtk"):
        v, f = files.read_surface(spark, str(tmp_path / name))
        assert [tuple(r)[1:] for r in v.orderBy("id").collect()] == [(0, 0, 0, 0), (1, 1, 0, 0), (2, 0, 1, 0.5)]
        assert [tuple(r)[1:] for r in f.collect()] == [(0, 0, 1, 2)]
