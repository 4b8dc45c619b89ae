"""Image files, whole-file sinks, streams by frame, and operators on distances and meshes against plain computations."""

import gzip

import numpy as np
import pytest
from pyspark.sql import functions as F

from lamina.operators import distances, geometry, spatial, surfaces
from lamina.sources import files, images
from lamina.streaming import frames

SF = "/root/testdata/sf0.001"


def tiff_bytes(pages, order="<"):
    """Pages of (height, width) uint16, two strips each."""
    out = {"<": b"II", ">": b"MM"}[order] + np.array([42], order + "u2").tobytes() + np.array([8], order + "u4").tobytes()
    for n, page in enumerate(pages):
        at, half = len(out), (page.shape[0] + 1) // 2 * page.shape[1] * 2
        size = 2 + 12 * 6 + 4
        data, extra = at + size + 16, at + size
        tag = lambda t, kind, count, v: np.array([t, kind], order + "u2").tobytes() + np.array([count], order + "u4").tobytes() + (np.array([v, 0], order + "u2").tobytes() if kind == 3 else np.array([v], order + "u4").tobytes())
        ifd = np.array([6], order + "u2").tobytes() + tag(256, 3, 1, page.shape[1]) + tag(257, 3, 1, page.shape[0]) + tag(258, 3, 1, 16) + tag(259, 3, 1, 1) + tag(273, 4, 2, extra) + tag(279, 4, 2, extra + 8)
        end = data + page.nbytes
        ifd += np.array([end if n < len(pages) - 1 else 0], order + "u4").tobytes()
        out += ifd + np.array([data, data + half, half, page.nbytes - half], order + "u4").tobytes() + page.astype(order + "u2").tobytes()
    return out


@pytest.mark.parametrize("order", "<>")
def test_tiff(spark, tmp_path, order):
    pages = [np.arange(12).reshape(3, 4) + 1000 * k for k in range(3)]
    (tmp_path / "a.tif").write_bytes(tiff_bytes([p.astype(np.uint16) for p in pages], order))
    got = {(r.i, r.j, r.k): r.v for r in images.read_tiff(spark, str(tmp_path)).collect()}
    assert got == {(x, y, k): float(pages[k][y, x]) for k in range(3) for y in range(3) for x in range(4)}


@pytest.mark.parametrize("coding", ("raw", "gzip"))
def test_nrrd(spark, tmp_path, coding):
    a = np.arange(24, dtype=np.int16).reshape((2, 3, 4), order="F")
    body = a.tobytes(order="F")
    (tmp_path / "a.nrrd").write_bytes(f"NRRD0004\n# made here\ntype: short\ndimension: 3\nsizes: 2 3 4\nendian: little\nencoding: {coding}\n\n".encode() + (gzip.compress(body) if coding == "gzip" else body))
    got = images.read_nrrd(spark, str(tmp_path)).collect()
    assert len(got) == 24 and all(r.v == a[r.i, r.j, r.k] and r.voxel == r.v for r in got)


def test_nifti_sink(spark, tmp_path):
    x = spark.range(2 * 3 * 4 * 2 * 2).select(F.concat(F.lit("im"), F.col("id") % 2, F.lit(".nii.gz")).alias("name"), F.floor(F.col("id") / 2).alias("n"))
    x = x.select("name", *[(F.floor(F.col("n") / a) % b).cast("int").alias(c) for c, a, b in (("i", 1, 2), ("j", 2, 3), ("k", 6, 4), ("t", 24, 2))], F.col("n").cast("double").alias("v"))
    for _ in range(2):  # the second run replaces the files of the first
        images.write_nifti(x, str(tmp_path / "out"))
    back = files.read_nifti(spark, str(tmp_path / "out")).select(F.substring_index("file", "/", -1).alias("name"), "i", "j", "k", F.posexplode("ts").alias("t", "v"))
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, x.select("name", "i", "j", "k", "t", "v").collect()))


def test_grid_transform(spark, tmp_path):
    rows = "\n".join(f"{n} {n}.0 0.5 {-n}.25" for n in range(24))
    linear = "#Linear Component\n1 0 0 2.5\n0 1 0 0\n0 0 1 0\n0 0 0 1\n"
    (tmp_path / "g.grd").write_text(f"#Combined File\n#NonLinearFirst\n1\n{linear}#Grid File\n#Origin\n0 1 2\n#Spacing\n4 5 6\n#Dimensions\n2 3 4\n#Interpolation Mode\n4\n#Displacements\n{rows}\n")
    p, nodes = images.read_grid_transform(spark, str(tmp_path / "g.grd"))
    assert p == {"linear": [[1, 0, 0, 2.5], [0, 1, 0, 0], [0, 0, 1, 0]], "origin": [0, 1, 2], "spacing": [4, 5, 6], "dims": [2, 3, 4]}
    assert sorted(map(tuple, nodes.collect())) == sorted((n % 2, n // 2 % 3, n // 6, float(n), 0.5, float(f"{-n}.25")) for n in range(24))
    (tmp_path / "m.matr").write_text("1 0 0 3\n0 1 0 4 \n0 0 1 5\n0 0 0 1\n")
    assert images.read_matrix_transform(spark, str(tmp_path / "m.matr")) == [[1, 0, 0, 3], [0, 1, 0, 4], [0, 0, 1, 5]]


def test_frames_smoothed_in_a_stream(spark, tmp_path):
    src = str(tmp_path / "frames")
    v = spark.range(3 * 4 * 4 * 4).select(F.floor(F.col("id") / 64).cast("int").alias("t"), *[(F.floor(F.col("id") / a) % 4).cast("int").alias(c) for c, a in (("i", 1), ("j", 4), ("k", 16))], (F.col("id") * 7 % 13).cast("double").alias("v"))
    v.repartition(3, "t").write.parquet(src)
    stream = spark.readStream.schema(v.schema).option("maxFilesPerTrigger", 1).parquet(src)
    frames.process_frames(stream, lambda b: spatial.smooth(b, 1.0, ("t",)), str(tmp_path / "out"), str(tmp_path / "c"))
    got = spark.read.parquet(str(tmp_path / "out")).select("t", "i", "j", "k", F.round("v", 9).alias("v"))
    one = [spatial.smooth(v.where(f"t = {t}"), 1.0).select("t", "i", "j", "k", F.round("v", 9).alias("v")) for t in range(3)]
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, one[0].unionByName(one[1]).unionByName(one[2]).collect()))


def test_stream_joins_and_concatenation(spark, tmp_path):
    src = str(tmp_path / "f")
    spark.range(6).select((F.col("id") % 3).cast("int").alias("t"), F.col("id").alias("voxel"), F.lit(1.0).alias("v")).write.parquet(src)
    both = frames.concatenate([(frames.frame_stream(spark, src), 3), (frames.frame_stream(spark, src), 3)])
    assert sorted(r.t for r in frames.drain(both, "both", str(tmp_path / "c1"), "append").collect()) == sorted([0, 1, 2, 3, 4, 5] * 2)
    e = spark.read.parquet(f"{SF}/events.parquet")
    e.write.parquet(str(tmp_path / "e"))
    side = lambda kind: spark.readStream.schema(e.schema).parquet(str(tmp_path / "e")).where(F.col("event_type") == kind).select("user_id", "ts", "event_id")
    a, b = [r[0] for r in e.select("event_type").distinct().orderBy("event_type").limit(2).collect()]
    got = frames.drain(frames.joined(side(a), side(b), "user_id", "6 hours", "60 days"), "met", str(tmp_path / "c2"), "append").select("event_id", "follow_event_id")
    x, y = e.where(F.col("event_type") == a), e.where(F.col("event_type") == b).select("user_id", F.col("ts").alias("u"), F.col("event_id").alias("f"))
    want = x.join(y, "user_id").where("u >= ts and u <= ts + interval 6 hours").select("event_id", "f")
    assert want.count() and sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_eigenvectors_and_clusters(spark):
    rng = np.random.default_rng(1)
    m = rng.random((12, 12)) * 0.05
    m[:6, :6] += 1
    m[6:, 6:] += 0.8
    m = (m + m.T) / 2
    e = spark.createDataFrame([(i, j, float(m[i, j])) for i in range(12) for j in range(12)], "src long, dst long, w double")
    x, values = distances.eigenvectors(e, 2, 15)
    value, vector = np.linalg.eigh(m)
    assert values == pytest.approx(value[::-1][:2].tolist(), rel=1e-6)
    got = np.array([r.xs for r in x.orderBy("node").collect()])
    assert abs(got.T @ vector[:, ::-1][:, :2]) == pytest.approx(np.eye(2), abs=1e-3)
    two = {r.node: r.cluster for r in distances.spectral_clusters(e, 2).collect()}
    assert len({two[n] for n in range(6)}) == len({two[n] for n in range(6, 12)}) == 1 and two[0] != two[6]


def test_sparse_matrix_with_ties_and_few_points(spark):
    rows = [(n, 0.0, 0.0, float(n), n % 2, float([1, 1, 1, 4, 9, 9, 2][n])) for n in range(7)] + [(9, 0.0, 0.0, 0.0, 7, 1.0)]
    p = spark.createDataFrame(rows, "id long, x double, y double, z double, label int, f double")
    want = [(r[0], r[0], 0.0, 0.0) for r in rows]
    for a in rows:
        d = sorted(((a[5] - b[5]) ** 2, b[0], (a[3] - b[3]) ** 2) for b in rows if b[4] == a[4] and b[0] != a[0])
        want += [(a[0], j, f, z) for f, j, z in d if len(d) <= 2 or f < d[2][0]]
    assert sorted(map(tuple, distances.sparse_matrix(p, 2).collect())) == sorted(want)


def test_quaternion_and_flip(spark):
    b, side = geometry.quaternion(geometry.rotation_scale(90.0, (2.0, 2.0, 2.0), (0.0, 0.0, 0.0)))
    assert b == pytest.approx([0, 0, np.sqrt(0.5)]) and side == 1
    assert geometry.quaternion([[1, 0, 0, 0], [0, 1, 0, 0], [0, 0, -1, 0]])[1] == -1
    v = spark.createDataFrame([(0, 0.0, 0.0, 0.0), (1, 1.0, 0.0, 0.0), (2, 0.0, 1.0, 0.0), (3, 5.0, 5.0, 5.0)], "id long, x double, y double, z double")
    f = spark.createDataFrame([(0, 0, 1, 2), (1, 0, 0, 1)], "id long, v0 long, v1 long, v2 long")
    assert [(r.area, r.nz) for r in surfaces.face_table(v, f).orderBy("id").collect()] == [(0.5, 1.0), (0.0, 0.0)]
    assert surfaces.face_table(*surfaces.flip_surface(v, f)).where("id = 0").first()["nz"] == -1.0
    still = {r.id: (r.x, r.y, r.z) for r in surfaces.relax(v, f, 2).collect()}
    assert still[3] == (5.0, 5.0, 5.0) and len(still) == 4
