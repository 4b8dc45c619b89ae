"""Projections and joint histograms against loops."""

import numpy as np
import pytest

from lamina.operators import histograms, projection
from test_fields import frame


def gaussian(sigma):
    r = max(1, int(2 * sigma))
    x = np.arange(-r, r + 1)
    w = np.exp(-0.5 * (x / sigma) ** 2)
    return w / w.sum()


def slope(sigma):
    r = max(1, int(2 * sigma))
    x = np.arange(-r, r + 1)
    w = -x * np.exp(-(x**2) / (2 * sigma**2))
    return w / np.abs(w).sum()


def convolved(v, w, axis):
    r = len(w) // 2
    pad = np.pad(v, [(r, r) if a == axis else (0, 0) for a in range(v.ndim)], "edge")
    return sum(c * np.take(pad, range(o, o + v.shape[axis]), axis) for o, c in enumerate(w))


def brute(v, axis, above, window, backwards, sigma, shade, mask, down):
    """v has axes i, j, k, t."""
    if mask is None and sigma > 0:
        for a in range(3):
            v = convolved(v, gaussian(sigma), a)
    still = v.mean(3) if mask is None else mask
    above = above if mask is None else 0.5
    grad = [convolved(still, slope(shade), a) for a in range(3)] if shade > 0.1 else None
    rest = [a for a in range(3) if a != axis]
    out = {}
    for x in range(v.shape[rest[0]]):
        for y in range(v.shape[rest[1]]):
            at = lambda z: tuple({rest[0]: x, rest[1]: y, axis: z}[a] for a in range(3))  # noqa: E731, B023
            n = v.shape[axis]
            ray = range(n) if backwards else range(n - 1, 0, -1)
            hit = next((z for z in ray if still[at(z)] > above), None)
            second = v.shape[2] - 1 - y if down and rest[1] == 2 else y
            for t in range(v.shape[3]):
                value = 0.0
                if hit is not None:
                    lo, hi = (hit, min(hit + window - 1, n - 1)) if backwards else (max(hit - window + 1, 0), hit)
                    light = 1.0
                    if grad:
                        g = np.array([d[at(lo)] for d in grad])
                        size = np.sqrt((g**2).sum())
                        light = max(0.1, (-1 if backwards else 1) * g[axis] / size) if size > 0 else 0.1
                    value = light * np.mean([v[at(z)][t] for z in range(lo, hi + 1)])
                out[x, second, t] = value
    return out


@pytest.mark.parametrize("axis,window,backwards,sigma,shade,masked,down", [("k", 3, False, 0.0, 1.0, False, False), ("j", 2, True, 1.0, 1.5, False, True), ("i", 1, False, 1.0, 0.0, False, False), ("i", 3, True, 0.0, 1.0, True, True)])
def test_shaded_projection(spark, axis, window, backwards, sigma, shade, masked, down):
    rng = np.random.default_rng(8)
    v = rng.random((6, 5, 7, 2)) * 10
    mask = (rng.random((6, 5, 7)) > 0.6).astype(float) if masked else None
    rows = [(i + 6 * (j + 5 * k), i, j, k, t, float(v[i, j, k, t])) for i, j, k, t in np.ndindex(v.shape)]
    img = spark.createDataFrame([tuple(map(int, r[:5])) + (r[5],) for r in rows], "voxel long, i int, j int, k int, t int, v double")
    m = frame(spark, mask).selectExpr("voxel", "v m") if masked else None
    got = projection.project_shaded(img, axis, (6, 5, 7), 6.0, window, backwards, sigma, shade, m, down)
    want = brute(v, "ijk".index(axis), 6.0, window, backwards, sigma, shade, mask, down)
    assert {(r.first, r.second, r.t): pytest.approx(r.v, abs=1e-9) for r in got.collect()} == want


def test_rotated_projection(spark):
    """A quarter turn about k: rays along i of the view are rays along j of the image."""
    v = np.random.default_rng(9).random((5, 5, 4)) * 10
    turn = [[0, 1, 0, 0], [-1, 0, 0, 4], [0, 0, 1, 0]]
    got = {(r.first, r.second): r.v for r in projection.project_resliced(frame(spark, v), turn, "i", (5, 5, 4), above=7.0).collect()}
    view = np.array([[[v[j, 4 - i, k] for k in range(4)] for j in range(5)] for i in range(5)])
    want = brute(view[..., None], 0, 7.0, 1, False, 0, 0, None, False)
    assert got == {(a, b): pytest.approx(x) for (a, b, _), x in want.items()}


def test_pairs_and_map_round_trip(spark):
    """A flat image that is the projection itself comes back on the rays that meet the surface."""
    v = np.random.default_rng(10).random((6, 5, 4)) * 10
    one = [[1, 0, 0, 0], [0, 1, 0, 0], [0, 0, 1, 0]]
    flip = [[1, 0, 0, 0], [0, -1, 0, 4], [0, 0, 1, 0]]  # the flat image counts its second axis from the top
    img = frame(spark, v)
    flat = projection.project_shaded(img, "k", v.shape, 8.5)
    pairs = projection.point_pairs(img, "k", v.shape, 8.5, one, flip, 5, 1.0)
    back = projection.project_map(pairs, flat.selectExpr("first i", "second j", "v"), (1.0, 1.0))
    hit = {(r.first, r.second) for r in pairs.collect()}
    want = {(r.first, r.second): r.v for r in flat.collect()}
    got = {(r.first, r.second): r.v for r in back.collect()}
    assert 0 < len(hit) < 30 and got == {p: want[p] for p in hit}


def test_pairs_meet_in_one_ray(spark):
    pairs = spark.createDataFrame([(0, 0, 1.0, 1.0), (0, 0, 2.0, 0.0), (1, 0, 9.0, 0.0)], "first int, second int, x double, y double")
    flat = spark.createDataFrame([(1, 1, 5.0), (2, 0, 7.0)], "i int, j int, v double")
    assert [tuple(r) for r in projection.project_map(pairs, flat, (1.0, 1.0)).collect()] == [(0, 0, 5.0)]


def brute_histogram(pairs, scale, bins, weights):
    h = np.zeros(bins, np.int64)
    for (x, y), w in zip(pairs, weights):
        if x < 0 or y < 0 or x / scale > bins[0] - 1.001 or y / scale > bins[1] - 1.001:
            continue
        a, b = x // scale, y // scale
        p, q = a + 1 - x / scale, b + 1 - y / scale
        for i, s in ((0, p), (1, 1 - p)):
            for j, r in ((0, q), (1, 1 - q)):
                h[a + i, b + j] += int(0.5 + w * 100 * s * r)
    return h


@pytest.mark.parametrize("scale", [2, 4, 10])
def test_partial_volume_histogram(spark, scale):
    rng = np.random.default_rng(scale)
    pairs, w = rng.integers(-2, 9 * scale, (400, 2)).tolist(), rng.integers(1, 4, 400).tolist()
    df = spark.createDataFrame([(x, y, c) for (x, y), c in zip(pairs, w)], "x int, y int, w int")
    h = brute_histogram(pairs, scale, (8, 7), w)
    got = histograms.joint_histogram_pv(df, scale, (8, 7), df["w"])
    assert {(r.a, r.b): r["count"] for r in got.collect()} == {(a, b): h[a, b] for a, b in np.argwhere(h)}
    m = histograms.measures(got).first()
    p = h / h.sum()
    a, b = np.indices(h.shape)
    ent = lambda q: -(q[q > 0] * np.log(q[q > 0])).sum()
    hx, hy, hxy = ent(p.sum(1)), ent(p.sum(0)), ent(p)
    ma, mb = (p * a).sum(), (p * b).sum()
    cc = ((p * a * b).sum() - ma * mb) ** 2 / (((p * a * a).sum() - ma**2) * ((p * b * b).sum() - mb**2))
    assert np.allclose([m.n, m.ssd, m.cc, m.hx, m.hy, m.hxy, m.mi, m.nmi], [h.sum(), (p * (a - b) ** 2).sum(), cc, hx, hy, hxy, hx + hy - hxy, (hx + hy) / hxy - 1])


def test_plain_and_empty_histograms(spark):
    df = spark.createDataFrame([(0, 0), (1, 2), (1, 2), (9, 0), (-1, 0)], "x int, y int")
    assert {tuple(r) for r in histograms.joint_histogram(df, (3, 3)).collect()} == {(0, 0, 1), (1, 2, 2)}
    m = histograms.measures(histograms.joint_histogram(df.limit(0), (3, 3))).first()
    assert (m.n, m.ssd, m.mi) == (0, 0.0, None)
