"""Readers on files written here, and streams against their batch form."""

import gzip
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from lamina.operators import temporal
from lamina.sources import files
from lamina.streaming import frames

SF = "/root/testdata/sf0.001"


def test_text_matrices(spark, tmp_path):
    (tmp_path / "a.csv").write_text("# note\nname, of, it\n1, 2.5\t3\n-4e1 5 nan\nend\n7,8,9\n")
    rows = files.read_matrix(spark, str(tmp_path / "a.csv")).orderBy("row").collect()
    assert [r.row for r in rows] == [0, 1] and rows[0].vals == [1.0, 2.5, 3.0] and rows[1].vals[:2] == [-40.0, 5.0] and np.isnan(rows[1].vals[2])
    (tmp_path / "b.matr").write_text("#matrix\n#x\n#rows cols\n2 3\n#m\n1 2 3\n4 5 6\n")
    assert [r.vals for r in files.read_matr(spark, str(tmp_path / "b.matr")).orderBy("row").collect()] == [[1, 2, 3], [4, 5, 6]]
    m = spark.createDataFrame([(0, [1.0, 2.5])], "row int, vals array<double>")
    assert files.to_csv_lines(m).first().value == "1.0, 2.5"


def test_binary_matrix(spark, tmp_path):
    for kind in ("<i8", "<f4", "<f8"):
        m = np.arange(6).reshape(2, 3).astype(kind)
        (tmp_path / "m.binmatr").write_bytes(files.binary_matrix_bytes(m))
        got = files.read_binary_matrix(spark, str(tmp_path / "m.binmatr")).orderBy("row").collect()
        assert [r.vals for r in got] == m.astype(float).tolist()
    with pytest.raises(ValueError):
        files.binary_matrix(b"\0" * 16)


def test_nifti(spark, tmp_path):
    v = np.arange(3 * 2 * 2 * 4).reshape(3, 2, 2, 4).astype("i2")
    (tmp_path / "x.nii").write_bytes(files.nifti_bytes(v, (2.0, 2.0, 3.0, 1.5)))
    (tmp_path / "x.nii.gz").write_bytes(gzip.compress(files.nifti_bytes(v)))
    got = files.read_nifti(spark, str(tmp_path / "x.nii*")).collect()
    assert len(got) == 2 * 12
    for r in got:
        assert r.ts == v[r.i, r.j, r.k].astype(float).tolist() and r.voxel == r.i + 3 * (r.j + 2 * r.k)
    h = files.read_nifti_headers(spark, str(tmp_path / "x.nii")).first()
    assert h.dims == [3, 2, 2, 4, 1] and h.code == 4 and h.spacing[:3] == [2.0, 2.0, 3.0]


def test_tasks_and_events(spark, tmp_path):
    (tmp_path / "t.json").write_text(json.dumps({"offset": 1, "runs": {"run1": {"go": ["1-5", "11-15"], "stop": "6-10"}}}))
    got = sorted(map(tuple, files.read_tasks(spark, str(tmp_path / "t.json")).collect()))
    assert got == [("run1", "go", 0, 4), ("run1", "go", 10, 14), ("run1", "stop", 5, 9)]
    (tmp_path / "e_run-02_events.tsv").write_text("onset\tduration\ttrial_type\n0\t5\tgo\n5\t3\tstop")
    assert sorted(map(tuple, files.read_events(spark, str(tmp_path / "e_run-02_events.tsv")).collect())) == [("02", "go", 0, 5), ("02", "stop", 5, 8)]
    for n in ("sub12_conn1.csv", "sub12_behaviors.csv", "sub3_conn1.csv", "other.csv"):
        (tmp_path / n).write_text(n)
    got = {r.subject: r.files for r in files.group_subject_files(spark, str(tmp_path)).collect()}
    assert set(got) == {"sub12", "sub3"} and got["sub12"]["sub12_conn1.csv"] == "sub12_conn1.csv" and len(got["sub12"]) == 2


def test_butterworth_first_value():
    b0 = temporal.coefficients(0.15, 1.0, False)[0]
    assert b0 * 0.61368 == pytest.approx(0.0805, abs=1e-3)


def test_frame_stream(spark, tmp_path):
    src = str(tmp_path / "frames")
    one = spark.range(40).select((F.col("id") % 4).cast("int").alias("t"), (F.col("id") / 4).cast("long").alias("voxel"), F.col("id").cast("double").alias("v"))
    one.repartition(4, "t").write.parquet(src)
    labels = spark.range(10).select(F.col("id").alias("voxel"), (F.col("id") % 3).cast("int").alias("label"))
    got = frames.drain(frames.roi_means(frames.frame_stream(spark, src), labels), "roi_out", str(tmp_path / "c1"))
    want = frames.roi_means(spark.read.parquet(src), labels)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    picked = frames.drain(frames.extract_frames(frames.masked(frames.frame_stream(spark, src), labels.where("label = 1")), 1, 3, 2), "pick_out", str(tmp_path / "c2"), "append")
    assert picked.count() == 20 and picked.where("v <> 0 and voxel % 3 <> 1").count() == 0


def test_event_streams(spark, tmp_path):
    src = str(tmp_path / "events")
    e = spark.read.parquet(f"{SF}/events.parquet")
    e.unionByName(e.limit(20)).repartition(3).write.parquet(src)
    stream = spark.readStream.schema(e.schema).parquet(src)
    for k, (length, slide) in enumerate((("1 day", None), ("2 hours", "1 hour"))):
        got = frames.drain(frames.windows(stream, length, slide), f"win{k}", str(tmp_path / f"w{k}"))
        assert got.agg(F.sum("n")).first()[0] == (e.count() + 20) * (2 if slide else 1)
    once = frames.drain(frames.distinct_events(stream, "60 days"), "once", str(tmp_path / "d"), "append")
    assert once.count() == e.count()
    s = frames.sessions(spark.read.parquet(src))
    assert s.agg(F.sum("n")).first()[0] == e.count() + 20 and s.where("end <= start").count() == 0
