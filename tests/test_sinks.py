"""Writers read back, listings, and small functions with known answers."""

from pyspark.sql import functions as F

from lamina.functions import scalar as S
from lamina.sources import files, sinks


def whole(folder):
    return "".join(p.read_text() for p in sorted(folder.glob("part-*")))


def test_matrix_and_lines(spark, tmp_path):
    m = spark.createDataFrame([(k, [float(k), k / 4]) for k in range(50)], "row int, vals array<double>").repartition(6)
    sinks.write_matrix(m, str(tmp_path / "m"))
    (tmp_path / "m.csv").write_text(whole(tmp_path / "m"))
    got = files.read_matrix(spark, str(tmp_path / "m.csv")).orderBy("row").collect()
    assert [(r.row, r.vals) for r in got] == [(k, [float(k), k / 4]) for k in range(50)]
    sinks.write_matrix(m, str(tmp_path / "z"), "gzip")
    assert all(r.path.endswith(".gz") for r in sinks.list_files(spark, str(tmp_path / "z"), "part*").collect())
    for _ in range(2):
        sinks.append_rows(m.select("row"), str(tmp_path / "a"))
    assert spark.read.csv(str(tmp_path / "a")).count() == 100


def test_frames(spark, tmp_path):
    sinks.write_frames(spark.range(60).select((F.col("id") % 3).cast("int").alias("t"), "id"), str(tmp_path / "f"))
    assert sorted(p.name for p in (tmp_path / "f").glob("t=*")) == ["t=0", "t=1", "t=2"]
    assert spark.read.parquet(str(tmp_path / "f" / "t=1")).count() == 20


def test_surfaces(spark, tmp_path):
    v = spark.createDataFrame([(k, float(k), k / 2, -1.0) for k in range(9)], "id int, x double, y double, z double").repartition(4)
    f = spark.createDataFrame([(k, k, k + 1, k + 2) for k in range(7)], "id int, v0 int, v1 int, v2 int").repartition(3)
    for kind in ("ply", "vtk"):
        sinks.write_surface(v, f, str(tmp_path / kind), kind)
        (tmp_path / f"s.{kind}").write_text(whole(tmp_path / kind))
        gv, gf = files.read_surface(spark, str(tmp_path / f"s.{kind}"))
        assert sorted(tuple(r)[1:] for r in gv.collect()) == sorted(map(tuple, v.collect()))
        assert sorted(tuple(r)[1:] for r in gf.collect()) == sorted(map(tuple, f.collect()))


def test_demographics_and_names(spark, tmp_path):
    (tmp_path / "d.csv").write_text("id --- age\n\ns1 --- 31\n")
    assert [r.fields for r in sinks.read_demographics(spark, str(tmp_path / "d.csv")).orderBy("n").collect()] == [["id", "age"], ["s1", "31"]]
    names = spark.createDataFrame([("run_10",), ("run_2",), ("rest",), ("run_1",)], "name string")
    assert [r.name for r in names.orderBy(S.run_order(F.col("name"))).collect()] == ["run_1", "run_2", "run_10", "rest"]
    r = spark.range(1).select(S.mni_to_slice(F.lit(-12.5), 1).alias("a"), S.slice_to_mni(F.lit(114.0), 1).alias("b")).first()
    assert (r.a, r.b) == (114, -12)
