"""Range reads: many tasks a file, only the bytes asked for, packed files, streams that go on after a restart."""

import gzip

import numpy as np
import pytest
from pyspark.sql import functions as F

from lamina.sources import files, ranges
from lamina.streaming import frames


def image(i=5, j=4, k=3, t=6, kind="i2"):
    return np.arange(i * j * k * t).reshape(i, j, k, t, order="F").astype(kind)


def as_rows(df):
    return {(r.t, r.k, r.voxel): r.v for r in df.collect()}


def wanted(v, ts, ks):
    a, b = v.shape[:2]
    return {(t, k, i + a * (j + b * k)): float(v[i, j, k, t]) for t in ts for k in ks for i in range(a) for j in range(b)}


@pytest.mark.parametrize("packed", [False, True])
def test_planes(spark, tmp_path, packed):
    v = image(kind="f4")
    data = files.nifti_bytes(v)
    (tmp_path / ("x.nii.gz" if packed else "x.nii")).write_bytes(gzip.compress(data) if packed else data)
    df = ranges.read_planes(spark, str(tmp_path), range_bytes=200)
    assert as_rows(df) == wanted(v, range(6), range(3))
    assert df.rdd.getNumPartitions() == (1 if packed else 9)  # 18 planes of 80 bytes, two a range
    some = df.where("t >= 2 and t < 5 and k in (0, 2)")
    assert as_rows(some) == wanted(v, (2, 3, 4), (0, 2))
    if not packed:
        assert some.rdd.getNumPartitions() == 4  # runs of planes: 6, 8 and 9, 11 and 12, 14
    assert as_rows(df.where("t = 5 and voxel % 2 = 0 and v > 0")) == {k: x for k, x in wanted(v, (5,), range(3)).items() if k[2] % 2 == 0 and x > 0}


def test_only_the_ranges_are_read(spark, tmp_path, monkeypatch):
    v = image(20, 20, 2, 10)
    (tmp_path / "x.nii").write_bytes(files.nifti_bytes(v))
    reader = ranges._Batch({"path": str(tmp_path / "x.nii")})
    assert list(reader.pushFilters([ranges.EqualTo(("t",), 7), ranges.EqualTo(("v",), 1.0)])) == [ranges.EqualTo(("v",), 1.0)]
    parts = reader.partitions()
    assert [(p.first, p.records, p.bytes) for p in parts] == [(14, 2, 800)]
    # The rest of the file may be missing: what is not asked for is not touched.
    whole = (tmp_path / "x.nii").read_bytes()
    (tmp_path / "x.nii").write_bytes(whole[: 352 + 16 * 800])
    assert [r for r, _ in ranges.values(parts[0])] == [14, 15]
    head, packed = ranges.head_of(str(tmp_path / "x.nii"))
    assert len(head) <= ranges.HEAD and not packed


def test_big_endian_scaled_and_headers(spark, tmp_path):
    v = image()
    data = bytearray(files.nifti_bytes(v))
    data[112:120] = np.array([0.5, 3], "<f4").tobytes()
    (tmp_path / "a.nii").write_bytes(bytes(data))
    (tmp_path / "b.nii.gz").write_bytes(gzip.compress(files.nifti_bytes(v)))
    got = as_rows(ranges.read_planes(spark, str(tmp_path / "a.nii")).where("t = 1"))
    assert got == {k: 0.5 * x + 3 for k, x in wanted(v, (1,), range(3)).items()}
    heads = {r.file.rsplit("/", 1)[1]: r for r in ranges.read_headers(spark, str(tmp_path / "*.nii*")).collect()}
    assert all(h.dims == [5, 4, 3, 6, 1] and h.frame_bytes == 120 for h in heads.values()) and set(heads) == {"a.nii", "b.nii.gz"}


def test_nrrd_and_binary_matrix(spark, tmp_path):
    v = image(4, 3, 2, 1, ">i2")[..., 0]
    (tmp_path / "n").mkdir()
    (tmp_path / "n" / "x.nrrd").write_bytes(b"NRRD0004\ntype: short\ndimension: 3\nsizes: 4 3 2\nendian: big\nencoding: raw\n\n" + v.tobytes(order="F"))
    assert as_rows(ranges.read_planes(spark, str(tmp_path / "n"), 24)) == wanted(v[..., None], (0,), range(2))
    m = np.arange(70.0).reshape(10, 7)
    (tmp_path / "m.binmatr").write_bytes(files.binary_matrix_bytes(m))
    df = ranges.read_matrix_rows(spark, str(tmp_path / "m.binmatr"), 3 * 56)
    assert df.rdd.getNumPartitions() == 4
    assert {r.row: r.vals for r in df.collect()} == dict(enumerate(m.tolist()))


def test_stream_goes_on_after_a_restart(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    v = image(3, 2, 2, 4)
    data = files.nifti_bytes(v)
    frame = 3 * 2 * 2 * 2
    (src / "a.nii").write_bytes(data[: 352 + 2 * frame + 5])  # two frames and a part of the third
    got = lambda: frames.drain_files(ranges.plane_stream(spark, str(src)), str(tmp_path / "out"), str(tmp_path / "check"))
    assert as_rows(got()) == wanted(v, (0, 1), range(2))
    (src / "a.nii").write_bytes(data)
    (src / "b.nii.gz").write_bytes(gzip.compress(data))
    df = got()
    assert df.groupBy("file").agg(F.countDistinct("t").alias("n"), F.count(F.lit(1)).alias("c")).orderBy("file").collect() == [("a.nii", 4, 48), ("b.nii.gz", 4, 48)]
    assert as_rows(df.where("file = 'a.nii'")) == wanted(v, range(4), range(2))
