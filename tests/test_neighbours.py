"""Exact neighbours within a label against brute force: copies, ties, hot cells, small labels."""

import numpy as np
import pytest

from lamina.operators import neighbours


def points(spark, n=700, d=6, labels=3, seed=0):
    rng = np.random.default_rng(seed)
    x = (rng.integers(0, 4, (n, d)) + 10 * rng.integers(0, 5, (n, 1))).astype(float)
    x[: n // 3] = x[0]
    label, place = rng.integers(0, labels, n), rng.integers(0, 9, (n, 3)).astype(float)
    label[-3:] = 99  # a label of three points
    rows = [(i, int(label[i]), x[i].tolist(), place[i].tolist()) for i in range(n)]
    return spark.createDataFrame(rows, "id long, label int, f array<double>, place array<double>"), x, label, place


def brute(x, label, place, count):
    d, p = ((x[:, None] - x[None]) ** 2).sum(2), ((place[:, None] - place[None]) ** 2).sum(2)
    return {i: [(v, j, p[i, j]) for v, j in sorted((d[i, j], j) for j in np.flatnonzero(label == label[i]) if j != i)[:count]] for i in range(len(x))}


@pytest.mark.parametrize("cell,block,chunk", [(4096, 2048, 2048), (80, 40, 30), (30, 1000, 1000)])
def test_nearest_in_label(spark, monkeypatch, cell, block, chunk):
    for k, v in (("CELL", cell), ("BLOCK", block), ("CHUNK", chunk)):
        monkeypatch.setattr(neighbours, k, v)
    df, x, label, place = points(spark)
    want = {(i, j, v, p) for i, near in brute(x, label, place, 5).items() for v, j, p in near}
    assert {tuple(r) for r in neighbours.nearest_in_label(df, 5).collect()} == want


def test_separated_clusters(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "CELL", 50)
    rng = np.random.default_rng(1)
    x = np.repeat(np.arange(8) * 1000.0, 50)[:, None] + rng.random((400, 3))
    df = spark.createDataFrame([(i, 1, x[i].tolist(), []) for i in range(400)], "id long, label int, f array<double>, place array<double>")
    want = brute(x, np.ones(400), np.zeros((400, 0)), 4)
    assert {(r.id, r.other) for r in neighbours.nearest_in_label(df, 4).collect()} == {(i, j) for i, near in want.items() for _, j, _ in near}


def test_strict_cut_and_sparsity(spark):
    df, x, label, place = points(spark, 300)
    best = max(2, int(300 * 3.0 * 0.01))
    want = {(i, i, 0.0, 0.0) for i in range(300)}
    for i, near in brute(x, label, place, best + 1).items():
        cut = near[best][0] if len(near) > best else np.inf
        want |= {(i, j, v, p) for v, j, p in near if v < cut}
    assert {tuple(r) for r in neighbours.sparse_series_matrix(df, sparsity=3.0).collect()} == want


def test_rounded_ranks(spark):
    rows = [(0, 1, [0.0]), (1, 1, [1.0]), (2, 1, [-1.00000001]), (3, 1, [5.0]), (4, 2, [0.0])]
    got = neighbours.knn_pairs(spark.createDataFrame(rows, "id long, label int, x array<float>"), 2)
    assert sorted(tuple(r) for r in got.where("id = 0").collect()) == [(0, 1, 1.0, 1), (0, 2, 1.0, 2)]
    assert got.where("id = 4").count() == 0


def test_no_points(spark):
    assert neighbours.nearest_in_label(spark.createDataFrame([], "id long, label int, f array<double>, place array<double>"), 3).collect() == []
