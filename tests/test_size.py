"""What tables of a cluster's size need: joins that broadcast no table that grows, whole orders, exact neighbours in bounded groups."""

import numpy as np
import pytest

from lamina.operators import joins, neighbours, parcels, spatial
from lamina.plans.catalog import QUERIES
from lamina.sources import scratch

SF = "/root/testdata/sf0.001"


@pytest.fixture
def plans(monkeypatch):
    """The plans of the tables that a query keeps on its way."""
    seen = []

    def keep(df):
        seen.append(df._jdf.queryExecution().executedPlan().toString())
        return scratch.keep(df)

    for module in (joins, spatial):
        monkeypatch.setattr(module, "keep", keep)
    return seen


@pytest.mark.parametrize("name", ["median_filter", "median_filter_box", "morph_erode", "morph_dilate", "morph_median", "morph_opening", "morph_closing"])
def test_box_is_not_broadcast(spark, plans, name):
    plans.append(QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString())
    assert any("SortMergeJoin" in p for p in plans) and not any("Broadcast" in p for p in plans)


def test_radius_pairs_are_not_broadcast(spark):
    plan = QUERIES["radius_pairs"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_nearest_is_not_broadcast(spark, plans):
    assert QUERIES["nearest_point"](spark, SF).count() and len(plans) > 1
    assert any("SortMergeJoin" in p for p in plans) and not any("Broadcast" in p for p in plans)


def test_lobes_are_not_broadcast(spark, plans):
    plans.append(QUERIES["repair_lobes"](spark, SF)._jdf.queryExecution().executedPlan().toString())
    assert len(plans) > 2 and not any("Broadcast" in p for p in plans)


def test_order_of_parcels_holds_for_large_numbers(spark):
    """Indices from a million, attributes from a thousand, fewer and more than four attributes, ties."""
    rows = [(i, [a, b, c]) for i, a, b, c in ((2_500_000, 1, 0, 0), (3, 1, 0, 1), (1_000_001, 0, 6, 2), (7, 1, 0, 0), (4, 0, 7, 0), (8, 0, 1500, 2), (9, 1, 2, 0), (10, -3, 9, 9), (5, 2**53 // 1000, 1, 1))]
    want = sorted(rows, key=lambda r: (r[1], r[0]))
    got = parcels.sort_parcels(spark.createDataFrame(rows, "index long, attr array<long>")).collect()
    assert [(r["index"], r.attr) for r in sorted(got, key=lambda r: r.place)] == want and sorted(r.place for r in got) == list(range(1, len(rows) + 1))
    rows = [(1, [5]), (2, [1, 2]), (3, []), (4, [0, 0, 0, 1, 9]), (5, [0, 0, 0, 1, 2]), (6, [4]), (7, [1, 0, 0, 0])]
    got = parcels.sort_parcels(spark.createDataFrame(rows, "index long, attr array<long>")).orderBy("place").collect()
    assert [r["index"] for r in got] == [3, 4, 5, 6, 1, 2, 7]


@pytest.mark.parametrize("count", [3, 60])
def test_neighbours_store_no_pairs(spark, monkeypatch, count):
    """Vectors that the triangle inequality cannot tell apart: kept tables stay within twice the points' rows, and the result is brute force's."""
    rows, n = [], 400
    for k, v in (("CELL", 100), ("BLOCK", 50), ("CHUNK", 50)):
        monkeypatch.setattr(neighbours, k, v)
    monkeypatch.setattr(neighbours, "keep", lambda df: rows.append((out := scratch.keep(df)).count()) or out)
    x = np.random.default_rng(3).random((n, 20)).round(2)
    df = spark.createDataFrame([(i, i % 2, x[i].tolist(), []) for i in range(n)], "id long, label int, f array<double>, place array<double>")
    got = {(r.id, r.other) for r in neighbours.nearest_in_label(df, count).collect()}
    d = neighbours.squared(x, x)
    assert got == {(i, j) for i in range(n) for _, j in sorted((d[i, j], j) for j in range(i % 2, n, 2) if j != i)[:count]}
    assert max(rows) <= 2 * n
    got = {(r.i, r.j) for r in neighbours.sparse_series_matrix(df, best=count).collect()}
    cut = [sorted(d[i, j] for j in range(i % 2, n, 2) if j != i)[count] for i in range(n)]
    assert got == {(i, j) for i in range(n) for j in range(i % 2, n, 2) if j == i or d[i, j] < cut[i]} and max(rows) <= 2 * n
