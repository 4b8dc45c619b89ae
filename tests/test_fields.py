"""Slice bias, label fields and ordered growth against loops."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lamina.operators import bias, labels


def frame(spark, a, name="v"):
    rows = [(int(i + a.shape[0] * (j + a.shape[1] * k)), int(i), int(j), int(k), float(a[i, j, k]) if name == "v" else int(a[i, j, k])) for i, j, k in np.ndindex(a.shape)]
    return spark.createDataFrame(rows, f"voxel long, i int, j int, k int, {name} {'double' if name == 'v' else 'long'}")


def volume_of(df, shape, name="v"):
    out = np.full(shape, np.nan)
    for r in df.collect():
        out[r.voxel % shape[0], r.voxel // shape[0] % shape[1], r.voxel // (shape[0] * shape[1])] = r[name]
    return out


def brute_bias(v, axis, share=0.05):
    """The corrected image by loops over slices."""
    s = v.copy()
    w3 = np.exp(-0.5 * np.array([1, 0, 1.0])) / np.exp(-0.5 * np.array([1, 0, 1.0])).sum()
    for ax in range(3):
        pad = np.pad(s, [(1, 1) if x == ax else (0, 0) for x in range(3)], "edge")
        n = s.shape[ax]
        s = sum(w * np.take(pad, range(o, o + n), ax) for o, w in enumerate(w3))
    bend = np.zeros(v.shape)
    for i, j, k in np.ndindex(*(n - 2 for n in v.shape)):
        p = (i + 1, j + 1, k + 1)
        step = lambda ax, d: s[tuple(x + d * (a == ax) for a, x in enumerate(p))]  # noqa: E731, B023
        bend[p] = np.sqrt(sum((2 * s[p] - step(ax, 1) - step(ax, -1)) ** 2 for ax in range(3)))
    w = 1000 * (1 - bend**2 / (bend**2 + (0.1 * bend.max()) ** 2 + 0.001))
    above = share * v.max() + (1 - share) * v.min()
    n, mid = v.shape[axis], v.shape[axis] // 2
    scale = np.ones(n)
    for order in (range(mid + 1, n), range(mid - 1, -1, -1)):
        now = 1.0
        for t in order:
            u = t - 1 if t > mid else t + 1
            x, y, wx, wy = np.take(v, u, axis), np.take(v, t, axis), np.take(w, u, axis), np.take(w, t, axis)
            good = (x > above) & (y > above)
            sure = good & (wx > 750) & (wy > 750)
            if good.any():
                b, h = (np.polyfit(x[sure], y[sure], 1)[0], np.polyfit(y[sure], x[sure], 1)[0]) if sure.sum() > x.size // 20 else (1.0, 1.0)
                if b * h > 0.5:
                    now *= min(max((b + 1 / h) / 2, 0.666), 1.5)
            scale[t] = now
    moved = (v > above) & np.expand_dims(np.arange(n) != mid, [a for a in range(3) if a != axis])
    x = np.where(moved, v / np.expand_dims(scale, [a for a in range(3) if a != axis]), v)
    return x * (v[moved].sum() / x[moved].sum())


def biased(shape=(8, 9, 7), axis=2, seed=0):
    rng = np.random.default_rng(seed)
    g = np.indices(shape)
    v = 200 + 40 * np.sin(g[0] / 3) + 15 * g[1] + rng.random(shape)
    v[2:5, 2:5, 2] *= 3  # an edge that must not count
    return v * np.expand_dims(1 + 0.25 * np.sin(np.arange(shape[axis])), [a for a in range(3) if a != axis])


@pytest.mark.parametrize("axis", [0, 1, 2])
def test_slice_bias(spark, axis):
    v = biased(axis=axis)
    got = volume_of(bias.slice_bias(frame(spark, v), "ijk"[axis], v.shape), v.shape)
    assert np.allclose(got, brute_bias(v, axis), rtol=1e-9)


def test_triple_slice_bias(spark):
    v = biased()
    out = bias.triple_slice_bias(frame(spark, v), v.shape)
    want = brute_bias(brute_bias(brute_bias(v, 0), 1), 2)
    assert np.allclose(volume_of(out, v.shape), want, rtol=1e-9)
    assert np.allclose(volume_of(out, v.shape, "bias"), 100 * v / want, rtol=1e-9)


def test_constant_and_flat_images_stay(spark):
    v = np.full((4, 4, 3), 7.0)
    assert np.allclose(volume_of(bias.slice_bias(frame(spark, v), "k", v.shape), v.shape), v)
    flat = np.arange(9.0).reshape(3, 3, 1)
    assert np.allclose(volume_of(bias.slice_bias(frame(spark, flat), "k", flat.shape), flat.shape), flat)


def test_masked_bias(spark):
    v = np.full((6, 6, 5), 50.0)
    mask = np.zeros(v.shape)
    mask[1:5, 1:5, 1:4] = 1
    got = volume_of(bias.masked_bias(frame(spark, v), frame(spark, mask).select("voxel", F.col("v").alias("m")), 1.0), v.shape)
    assert np.allclose(got[mask > 0], 5000.0) and (got[mask == 0] == 0).all()  # 100 v over a ratio of 1


def brute_field(first, sweeps, smoothness, spacing=(1, 1, 1), colours=False):
    """All sweeps' labels and their shares of changes, voxel by voxel."""
    flat = first.shape[2] == 1
    steps = [(i, j, k) for k in ((0,) if flat else (-1, 0, 1)) for j in (-1, 0, 1) for i in (-1, 0, 1) if (i, j, k) != (0, 0, 0)]
    w = np.array([1 / np.sqrt(sum((s * x) ** 2 for s, x in zip(q, spacing))) for q in steps])
    w = w / w.sum()
    now, out = first.copy(), []
    inner = [p for p in np.ndindex(first.shape) if all(0 < x < n - 1 for x, n in list(zip(p, first.shape))[: 2 if flat else 3])]
    parity = [(a, b, c) for c in ((0,) if flat else (0, 1)) for b in (0, 1) for a in (0, 1)] if colours else [None]
    for _ in range(sweeps):
        begin = now.copy()
        for par in parity:
            seen = now.copy()
            for p in inner:
                if par is not None and any(x % 2 != y for x, y in list(zip(p, par))[: 2 if flat else 3]):
                    continue
                near = [tuple(x + s for x, s in zip(p, q)) for q in steps]
                ids = [seen[p]]
                for q in near:
                    if first[q] not in ids:
                        ids.append(first[q])
                best, low = seen[p], None
                for t in ids:
                    e = smoothness * sum(x for x, q in zip(w, near) if seen[q] != t) + (t != first[p])
                    if low is None or e - low < 1e-6:
                        best, low = t, e
                now[p] = best
        out.append((now.copy(), 100 * (now != begin).sum() / max(1, len(inner))))
    return out


@pytest.mark.parametrize("shape,side,colours", [((7, 6, 5), 48, False), ((11, 9, 8), 4, False), ((9, 8, 1), 3, False), ((7, 7, 6), 5, True)])
def test_label_field(spark, shape, side, colours):
    first = np.random.default_rng(3).integers(0, 4, shape)
    seen = brute_field(first, 3, 4.0, (1, 1.5, 2), colours)
    got = volume_of(labels.regularize_labels(frame(spark, first, "label"), shape, 2, 4.0, 1e-9, (1, 1.5, 2), colours, side), shape, "label")
    assert (got == seen[-1][0]).all()


def test_label_field_converges(spark):
    first = (np.indices((8, 8, 6))[0] > 3).astype(int)
    first[2, 2, 2] = first[5, 5, 3] = 2
    seen = brute_field(first, 5, 4.0)
    limit = seen[0][1] / 2
    stop = next(s for s, (_, c) in enumerate(seen) if c < limit)
    assert 0 < stop < 4
    got = volume_of(labels.regularize_labels(frame(spark, first, "label"), first.shape, 4, 4.0, limit), first.shape, "label")
    assert (got == seen[stop][0]).all() and not (got == 2).any()


def test_growth_in_order(spark):
    """Against a search of the least entry over all regions and borders at every step; two images at once."""
    rng = np.random.default_rng(5)
    rows, seeds, want = [], [], {}
    for img in ("a", "b"):
        at = [(i, j, k) for i in range(5) for j in range(5) for k in range(3) if rng.random() < 0.85 or (i, j, k) in ((0, 0, 0), (4, 4, 2), (2, 2, 1))]
        x = {p: rng.integers(0, 5, 4).astype(float) for p in at}
        ids = {p: n for n, p in enumerate(at)}
        label = {p: 0 for p in at}
        centre = {1: (0, 0, 0), 2: (4, 4, 2), 3: (2, 2, 1)}
        for n, p in centre.items():
            label[p] = n
        while True:
            border = [(float(((x[q] - x[centre[n]]) ** 2).sum()), n, ids[q], q) for p, n in label.items() if n for q in at if not label[q] and sum(abs(a - b) for a, b in zip(p, q)) == 1]
            if not border:
                break
            _, n, _, q = min(border)
            label[q] = n
        rows += [(img, ids[p], *p, x[p].tolist()) for p in at]
        seeds += [(img, n, x[p].tolist(), ids[p]) for n, p in centre.items()]
        want |= {(img, ids[p]): n for p, n in label.items()}
    images = spark.createDataFrame(rows, "img string, voxel long, i int, j int, k int, x array<double>")
    out = labels.grow_in_order(images, spark.createDataFrame(seeds, "img string, label long, x array<double>, voxel long"))
    assert {(r.img, r.voxel): r.label for r in out.collect()} == want
