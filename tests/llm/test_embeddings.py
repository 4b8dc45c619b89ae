"""Neighbours and whitening against brute force, in whole numbers and fractions where the results are exact."""

from fractions import Fraction
from math import floor, isfinite

import numpy as np
import pytest

from lamina.llm import adaptive_neighbours, embedding_whitening, queries, vectors

SCHEMA = "vec_id long, embedding array<float>, label int, x long, n long, list int, score double"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 0, 7, 7, 7, 0.5) for i, v in rows], SCHEMA)


def hard_rows(n=400, d=24, seed=3):
    """Clusters, exact copies, rows of another length, null, zero, NaN and infinite entries, null and repeated ids, a large norm."""
    rng = np.random.default_rng(seed)
    centre = rng.standard_normal((6, d))
    x = (centre[rng.integers(0, 6, n)] + 0.5 * rng.standard_normal((n, d))).astype(np.float32)
    x[: n // 3] = x[0]
    x[7] *= 9
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(x)]
    bad = [None, [0.0] * d, [None] + [1.0] * (d - 1), [float("nan")] * d, [float("inf")] + [0.0] * (d - 1), [1.0, 2.0], []]
    rows += [(1000 + 20 * k, v) for k, v in enumerate(bad)] + [(None, rows[5][1]), rows[20], rows[21], (40, rows[3][1])]
    return rows


def brute_neighbours(rows, every, top, d):
    ok = [(i, np.array(v, np.float32).astype(float)) for i, v in rows if i is not None and v and len(v) == d and all(c is not None and isfinite(c) for c in v) and any(v)]
    asks = {}
    for i, v in ok:
        if i % every == 0 and (i not in asks or tuple(v) < tuple(asks[i])):
            asks[i] = v
    out = {}
    for q, y in asks.items():
        near = sorted((-float((v * y).sum()), i) for i, v in ok if i != q)[:top]
        out[q] = [(i, -s) for s, i in near]
    return out


def by_query(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r["rank"])):
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r["rank"] == len(out[r.query_id])
    return out


def recall(got, want):
    """Share of the wanted scores that are reached, so that ties of equal scores count alike."""
    have = total = 0
    for q, near in want.items():
        worst = near[-1][1]
        have += sum(s >= worst - 1e-9 for _, s in got.get(q, []))
        total += len(near)
    return have / total


def test_neighbours_of_hard_rows(spark):
    rows = hard_rows()
    want = brute_neighbours(rows, 20, 20, 24)
    got = by_query(adaptive_neighbours.nearest(frame(spark, rows), lambda i: i % 20 == 0, 20))
    assert set(got) == set(want) and recall(got, want) >= 0.95
    scores = {(q, i) for q, near in want.items() for i, _ in near}
    exact = [abs(s - dict(want[q])[i]) for q, near in got.items() for i, s in near if (q, i) in scores and (i, s) is not None]
    assert max(exact) < 1e-9
    for near in got.values():
        assert near == sorted(near, key=lambda x: (-x[1], x[0]))


def test_neighbours_with_all_lists_and_sure_tests_are_exact(spark, monkeypatch):
    monkeypatch.setattr(adaptive_neighbours, "RUN", 17)
    monkeypatch.setattr(adaptive_neighbours, "CHUNK", 5)
    rows = hard_rows(300)
    want = brute_neighbours(rows, 10, 7, 24)
    got = by_query(adaptive_neighbours.nearest(frame(spark, rows), lambda i: i % 10 == 0, 7, recall=1.0, miss=0.0))
    assert got.keys() == want.keys()
    assert all([i for i, _ in got[q]] == [i for i, _ in want[q]] for q in want)


def test_neighbours_on_the_table(spark):
    sf = "/root/testdata/sf0.1"
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    want = brute_neighbours(rows, 20, 20, 64)
    got = by_query(queries.op12_nearest_neighbours(spark, sf))
    assert set(got) == set(want) and all(len(x) == 20 for x in got.values())
    assert recall(got, want) >= 0.93


def test_few_and_no_rows(spark):
    assert by_query(adaptive_neighbours.nearest(frame(spark, []), lambda i: i % 20 == 0)) == {}
    assert by_query(adaptive_neighbours.nearest(frame(spark, [(0, [1.0, 2.0])]), lambda i: i % 20 == 0)) == {}
    got = by_query(adaptive_neighbours.nearest(frame(spark, [(0, [1.0, 2.0]), (3, [2.0, 0.0]), (2, [2.0, 0.0]), (20, [0.0, -1.0])]), lambda i: i % 20 == 0))
    assert got == {0: [(2, 2.0), (3, 2.0), (20, -2.0)], 20: [(2, 0.0), (3, 0.0), (0, -2.0)]}


def test_a_test_abandons_no_more_than_it_says():
    """Pairs as near as the threshold pass each test with probability 1 - miss."""
    rng = np.random.default_rng(1)
    d, miss = 65, 0.01
    v = rng.standard_normal((20_000, d))
    share = (v[:, :16] ** 2).sum(1) / (v**2).sum(1)
    assert abs((share > np.quantile(rng.beta(8, (d - 16) / 2, 200_000), 1 - miss)).mean() - miss) < 0.004


def exact_whitening(rows, d):
    x = [(i, [floor(64 * Fraction(float(np.float32(c)))) + 1_000_000 for c in v]) for i, v in rows if v is not None and len(v) == d and all(c is not None and isfinite(c) for c in v)]
    n = len(x)
    s = [sum(v[k] for _, v in x) for k in range(d)]
    cov = [[Fraction(sum((n * v[a] - s[a]) * (n * v[b] - s[b]) for _, v in x), n**3) for b in range(d)] for a in range(d)]
    return x, n, s, cov


def test_error_free_steps():
    rng = np.random.default_rng(2)
    a, b = rng.standard_normal(200) * 1e8, rng.standard_normal(200)
    for op, f in ((vectors.two_sum, lambda p, q: p + q), (vectors.two_product, lambda p, q: p * q)):
        assert all(f(Fraction(p), Fraction(q)) == Fraction(h) + Fraction(l) for p, q, h, l in zip(a, b, *op(a, b)))
    h, l = vectors.total((a.copy(), b * 1e-12))
    want = sum(map(Fraction, a)) + sum(map(Fraction, b * 1e-12))
    assert abs(Fraction(float(h)) + Fraction(float(l)) - want) < abs(want) * Fraction(1, 2**95)


def test_covariance_keeps_its_low_part(spark):
    rows = [(i, v) for i, v in hard_rows(90, 5) if v]
    x, n, s, cov = exact_whitening(rows, 5)
    df = embedding_whitening.whole_entries(frame(spark, rows).repartition(7), "vec_id", "embedding").where("size(x) = 5")
    high = np.array([float(Fraction(v, n)) for v in s])
    low = np.array([float(Fraction(v, n) - Fraction(h)) for v, h in zip(s, high)])
    h, l = embedding_whitening.covariance(df, "x", (high, low), n)
    assert all(abs(Fraction(h[a, b]) + Fraction(l[a, b]) - cov[a][b]) <= abs(cov[a][a]) * Fraction(1, 2**85) for a in range(5) for b in range(5))


def test_refined_eigenvectors():
    """A matrix built from rational rotations, with close eigenvalues: vectors to double precision."""
    rng = np.random.default_rng(4)
    d, values = 12, [Fraction(10) + Fraction(k, 10**5) for k in range(11)] + [Fraction(1)]
    w = [[Fraction(int(c)) for c in r] for r in rng.integers(-3, 4, (d, d))]
    q = [[Fraction(int(a == b)) for b in range(d)] for a in range(d)]
    for u in w[:3]:  # Householder reflections with fractions are exact
        uu = sum(c * c for c in u)
        q = [[r[b] - 2 * sum(x * y for x, y in zip(r, u)) * u[b] / uu for b in range(d)] for r in q]
    v = [[sum(q[a][k] * values[k] * q[b][k] for k in range(d)) for b in range(d)] for a in range(d)]
    high = np.array([[float(c) for c in r] for r in v])
    low = np.array([[float(c - Fraction(h)) for c, h in zip(r, hr)] for r, hr in zip(v, high)])
    e, x = embedding_whitening.eigen((high, low))
    want = np.array([[float(c) for c in r] for r in q])[:, np.argsort([-float(c) for c in values])]
    assert np.allclose(e, sorted(map(float, values), reverse=True), rtol=1e-15, atol=0)
    assert np.abs(np.abs((x * want).sum(0)) - 1).max() < 1e-15
    assert np.minimum(np.abs(x - want), np.abs(x + want)).max() < 4e-16
    assert np.abs(np.linalg.eigh(high)[1][:, ::-1] ** 2 - want**2).max() > 1e-13  # the high part alone is not enough


def test_whitening_of_hard_rows(spark):
    d = 24
    rows = hard_rows(300, d)
    x, n, s, cov = exact_whitening(rows, d)
    got = embedding_whitening.whitened(frame(spark, rows), most=10).collect()
    assert len(got) == 10 * n and {r.n for r in got} == {n}
    e, v = np.linalg.eigh(np.array([[float(c) for c in r] for r in cov]))
    e, v = e[::-1], v[:, ::-1]
    trace = float(sum(cov[k][k] for k in range(d)))
    centred = np.array([[float(Fraction(n * c - t, n)) for c, t in zip(r, s)] for _, r in x])
    want = (centred @ v)[:, :10] / np.sqrt(e[:10])
    mine = {}
    for r in got:
        assert abs(r.explained - e[r.component - 1] / trace) < 1e-12
        assert r.identity_error < 1e-9
        mine.setdefault(r.component, []).append((r.vec_id is None, r.vec_id or 0, r.deviation, abs(r.whitened)))
    for k in range(10):
        exact = sorted((i is None, i or 0, sum((n * c - t) ** 2 for c, t in zip(r, s)), abs(w)) for (i, r), w in zip(x, want[:, k]))
        for a, b in zip(sorted(mine[k + 1]), exact):
            assert a[:3] == b[:3] and abs(a[3] - b[3]) < 1e-8


@pytest.mark.parametrize("rows", [[], [(1, [1.0, 2.0])], [(1, [1.0, 2.0]), (2, [1.0, 2.0])], [(1, None), (2, [float("nan")])]])
def test_no_variance(spark, rows):
    assert embedding_whitening.whitened(frame(spark, rows)).collect() == []


def test_rank_and_large_entries(spark):
    got = embedding_whitening.whitened(frame(spark, [(1, [1.0, 2.0, 3e38]), (2, [2.0, 2.0, 1.0]), (3, [4.0, 2.0, 1.0])])).collect()
    assert sorted((r.vec_id, r.component, abs(r.whitened), r.explained) for r in got) == [(2, 1, pytest.approx(1), 1.0), (3, 1, pytest.approx(1), 1.0)]
