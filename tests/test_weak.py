"""Clusters with corners over blocks, weighted correlation, designs, top-hat, provenance, the optical chain."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from lamina.operators import chains, spatial, statistics, temporal
from lamina.sources import objects, sinks
from test_fields import frame, volume_of


@pytest.mark.parametrize("corners", [False, True])
@pytest.mark.parametrize("side", [2, 3, 32])
def test_components_over_blocks(spark, corners, side):
    v = (np.random.default_rng(2).random((7, 6, 5)) < (0.2 if corners else 0.45)).astype(float)
    label = {p: int(p[0] + 7 * (p[1] + 6 * p[2])) for p in zip(*np.nonzero(v))}
    steps = [s for s in np.ndindex(3, 3, 3) if s != (1, 1, 1) and (corners or sum(abs(x - 1) for x in s) == 1)]
    changed = True
    while changed:
        changed = False
        for p in label:
            low = min(label.get(tuple(x + y - 1 for x, y in zip(p, s)), label[p]) for s in steps)
            if low < label[p]:
                label[p], changed = low, True
    got = {r.voxel: r.component for r in spatial.components(frame(spark, v), F.col("v") > 0, side, corners).collect()}
    assert got == {int(p[0] + 7 * (p[1] + 6 * p[2])): c for p, c in label.items()}


def test_cluster_filter_and_connect(spark):
    v = np.zeros((6, 6, 3))
    v[0, 0, 0], v[1, 1, 1], v[4, 4, 0], v[4, 5, 0], v[5, 5, 0], v[2, 4, 2] = 5, -5, 7, 7, -6, 4.9
    got = lambda **k: volume_of(spatial.cluster_filter(frame(spark, v), 5, **k), v.shape)
    assert (got(size=2) == np.where(np.abs(v) >= 5, v, 0)).all()
    assert set(got(size=2, corners=False)[np.nonzero(got(size=2, corners=False))]) == {7, -6}
    assert np.count_nonzero(got(size=-1)) == 3
    assert np.count_nonzero(volume_of(spatial.connect(frame(spark, np.abs(v)), (0, 0, 0)), v.shape)) == 2
    assert np.count_nonzero(volume_of(spatial.connect(frame(spark, np.abs(v)), (3, 3, 0)), v.shape)) == 0


def test_weighted_correlation(spark):
    rng = np.random.default_rng(3)
    x, w = rng.random((30, 3)), rng.integers(0, 3, 30).astype(float)
    x[:, 2] = 4.0
    cells = spark.createDataFrame([(r, c, float(x[r, c])) for r, c in np.ndindex(x.shape)], "row int, col int, v double")
    weights = spark.createDataFrame([(r, float(w[r])) for r in range(30)], "row int, w double")
    for binary, use in ((True, (w > 0) * 1.0), (False, w)):
        cov = np.cov(x[:, :2].T, aweights=use, ddof=0)
        got = {(r.a, r.b): r.r for r in statistics.weighted_correlation_matrix(cells, weights, binary).collect()}
        assert got[0, 1] == pytest.approx(cov[0, 1] / np.sqrt(cov[0, 0] * cov[1, 1])) and got[0, 0] == pytest.approx(1)
        assert got[2, 2] == got[0, 2] == 0.0


def test_response_and_design(spark):
    h = temporal.response(1.0)
    assert len(h) == 15 and h[:3] == [0, 0, 0] and h[6] == pytest.approx(1.0, abs=1e-3) and min(h) == pytest.approx(-0.2, abs=1e-3) and h[12] == pytest.approx(-0.2, abs=1e-3) and abs(h[14]) < 1e-3
    tasks = np.zeros((2, 20, 2))
    tasks[0, 2:6, 0] = tasks[1, 15:, 0] = tasks[1, 3, 1] = 1
    rows = [(r, f, c, float(tasks[r, f, c])) for r, f, c in np.ndindex(tasks.shape)]
    out = temporal.stacked_waveform(spark.createDataFrame(rows, "run int, frame int, col int, v double"), 20, 1.0, 1)
    got = np.full((2, 20, 6), np.nan)
    for r in out.collect():
        got[r.run, r.frame, r.col] = r.v
    t = np.linspace(-1, 1, 20)
    for r in range(2):
        want = np.stack([np.convolve(tasks[r, :, c], h)[:20] for c in range(2)], 1)
        assert np.allclose(got[r, :, :2], want)
        assert np.allclose(got[r, :, 2 + 2 * r], 1) and np.allclose(got[r, :, 3 + 2 * r], t) and np.allclose(np.delete(got[r, :, 2:], [2 * r, 2 * r + 1], 1), 0)


@pytest.mark.parametrize("width", [3, 4])
def test_top_hat(spark, width):
    x = np.random.default_rng(6).random(25).cumsum()
    p = np.concatenate([2 * x[0] - x[width:0:-1], x])
    low = np.array([p[s : s + width].min() for s in range(len(p))])
    want = [p[t] - low[max(0, t - width + 1) : t + 1].max() for t in range(width, len(p))]
    df = spark.createDataFrame([(1, t, float(v)) for t, v in enumerate(x)], "voxel long, t int, v double")
    assert [r.v for r in temporal.top_hat_padded(df, width).orderBy("t").collect()] == pytest.approx(want)


def test_provenance(spark, tmp_path):
    c = sinks.provenance("smooth", "output", {"sigma": 2.0})
    m = spark.createDataFrame([("a", 0, [1.0, 2.0])], "name string, row long, vals array<double>")
    twice = sinks.with_comment(sinks.with_comment(objects.matrix_objects(m), c), "by hand")
    (tmp_path / "a.json").write_text(twice.first().value)
    r = objects.read_objects(spark, str(tmp_path / "a.json")).first()
    assert [json.loads(r.comments[0]), r.comments[1]] == [{"command": "smooth", "output": "output", "parameters": {"sigma": 2.0}}, "by hand"]
    assert [x.vals for x in objects.load(spark, str(tmp_path / "a.json")).collect()] == [[1.0, 2.0]]
    sinks.write_with_provenance(m, str(tmp_path / "t"), c)
    assert spark.read.text(str(tmp_path / "t.provenance")).first().value == c


def test_optical_chain(spark):
    rng = np.random.default_rng(7)
    v = rng.random((6, 6, 4)) * 100
    out = chains.preprocess_optical(frame(spark, v), v.shape, flips="i", bias=False, sigma=0.0, factor=2, high=None)
    want = np.floor(v[::-1][::2, ::2, ::2] + 0.5)
    assert (volume_of(out, want.shape) == want).all()
    whole = volume_of(chains.preprocess_optical(frame(spark, v), v.shape, mask=frame(spark, (v > 50) * 1.0).selectExpr("voxel", "v m")), v.shape)
    assert whole.min() == 0 and whole.max() == 255 and (whole[v <= 50] == 0).all()


def test_frame_matrix(spark):
    x = np.random.default_rng(1).integers(0, 3, (20, 9)).astype(float)
    d = ((x[:, :, None] - x[:, None, :]) ** 2).sum(0)
    want = {(a, b, d[a, b]) for a in range(9) for b in range(9) if d[a, b] < np.sort(d[a])[3]}
    df = spark.createDataFrame([(v, t, float(x[v, t])) for v, t in np.ndindex(x.shape) if x[v, t]], "voxel long, t int, v double")
    assert {tuple(r) for r in temporal.frame_matrix(df, best=3).collect()} == want


def test_folds_and_prediction(spark):
    rng = np.random.default_rng(4)
    y = rng.random(30)
    e = np.stack([y + 0.1 * rng.random(30), -y + 0.1 * rng.random(30), rng.random(30)], 1)
    folds = statistics.assign_folds(spark.range(30).withColumnRenamed("id", "subject"), 4)
    size = [r["count"] for r in folds.groupBy("fold").count().collect()]
    assert sorted(size) == [7, 7, 8, 8]
    edges = spark.createDataFrame([(s, k, float(e[s, k])) for s, k in np.ndindex(e.shape)], "subject long, edge int, v double")
    traits = spark.createDataFrame(list(enumerate(y.tolist())), "subject long, y double")
    fold = {r.subject: r.fold for r in folds.collect()}
    got = {r.subject: r.predicted for r in statistics.predict_from_edges(edges, traits, folds, 0.6).collect()}
    for f in range(4):
        train = np.array([s for s in range(30) if fold[s] != f])
        r = np.array([np.corrcoef(e[train, k], y[train])[0, 1] for k in range(3)])
        sums = np.stack([e[:, (r >= 0.6)].sum(1), e[:, (r <= -0.6)].sum(1), np.ones(30)], 1)
        b = np.linalg.lstsq(sums[train], y[train], rcond=None)[0]
        assert all(got[s] == pytest.approx(sums[s] @ b, abs=1e-8) for s in range(30) if fold[s] == f)
    none = statistics.predict_from_edges(edges, traits, folds, 1.1).where("fold = 0").collect()
    assert {round(r.predicted, 12) for r in none} == {round(float(np.mean([y[s] for s in range(30) if fold[s] != 0])), 12)}


def tiff(page, coding, packed, predictor=1):
    h, w = page.shape
    entries = [(256, 4, w), (257, 4, h), (258, 3, page.itemsize * 8), (259, 3, coding), (273, 4, 8), (277, 3, 1), (279, 4, len(packed)), (317, 3, predictor), (339, 3, 1)]
    ifd = np.array([len(entries)], "<u2").tobytes() + b"".join(np.array([t, k], "<u2").tobytes() + np.array([1, v], "<u4").tobytes() for t, k, v in entries) + b"\0" * 4
    return b"II*\0" + np.array([8 + len(packed)], "<u4").tobytes() + packed + ifd


def lzw(data):
    """Codes of the widths that a reader expects, most significant bit first."""
    table, bits, n, width = {bytes([k]): k for k in range(256)}, 256, 9, 9
    size, w = 258, b""
    for k in range(len(data)):
        c = data[k : k + 1]
        if w + c in table:
            w += c
            continue
        bits, n = bits << width | table[w], n + width
        table[w + c] = size
        size += 1
        width = 9 if size < 512 else 10 if size < 1024 else 11 if size < 2048 else 12
        w = c
    bits, n = bits << width | table[w], n + width
    size += 1
    width = 9 if size < 512 else 10 if size < 1024 else 11 if size < 2048 else 12
    bits, n = bits << width | 257, n + width
    return (bits << (-n % 8)).to_bytes(-(-n // 8), "big")


def test_packed_tiff():
    import zlib

    from lamina.sources import images

    page = np.random.default_rng(0).integers(0, 5, (40, 30)).astype("<u2")
    raw = page.tobytes()
    runs = b"".join(bytes([len(raw[i : i + 100]) - 1]) + raw[i : i + 100] for i in range(0, len(raw), 100))
    for coding, packed in ((1, raw), (8, zlib.compress(raw)), (32773, runs), (5, lzw(raw))):
        assert (images.tiff_array(tiff(page, coding, packed))[:, :, 0, 0] == page.T).all()
    assert images.unpack_bits(bytes([254, 7, 1, 5, 6, 128])) == b"\x07\x07\x07\x05\x06"
    steps = np.diff(page, axis=1, prepend=np.zeros((40, 1), "<u2")).astype("<u2")
    assert (images.tiff_array(tiff(page, 8, zlib.compress(steps.tobytes()), 2))[:, :, 0, 0] == page.T).all()


def test_frames_as_files_and_connectivity(spark, tmp_path):
    from lamina.sources import files, images, ranges

    rows = [("x", i, j, 0, t, float(i + 10 * j + 100 * t)) for i in range(3) for j in range(2) for t in range(3)]
    img = spark.createDataFrame(rows, "name string, i int, j int, k int, t int, v double")
    images.write_nifti(images.frame_names(img, "part"), str(tmp_path / "f"))
    assert sorted(p.name for p in (tmp_path / "f").iterdir()) == ["part_1.nii.gz", "part_2.nii.gz", "part_3.nii.gz"]
    got = {r.voxel: r.v for r in ranges.read_planes(spark, str(tmp_path / "f" / "part_3.nii.gz")).collect()}
    assert got == {i + 3 * j: i + 10 * j + 200.0 for i in range(3) for j in range(2)}
    for n in ("sub2_conn1.csv", "sub2_behaviors.csv", "sub10_conn1.csv"):
        (tmp_path / n).write_text(f"1,2\n{n}")
    text = files.connectivity_json(files.group_subject_files(spark, str(tmp_path))).first().value
    assert json.loads(text) == {"sub10": {"sub10_conn1.csv": "1,2\nsub10_conn1.csv"}, "sub2": {"sub2_behaviors.csv": "1,2\nsub2_behaviors.csv", "sub2_conn1.csv": "1,2\nsub2_conn1.csv"}}


def test_zero_fill(spark):
    from lamina.functions import scalar

    df = spark.createDataFrame([([1.5, None],), ([],)], "x array<double>")
    assert [r.z for r in df.select(scalar.zero_filled(F.col("x"), 3).alias("z")).collect()] == [[1.5, 0, 0], [0, 0, 0]]
