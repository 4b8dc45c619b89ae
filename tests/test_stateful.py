"""Streams with state: results equal the batch form, also when a query is stopped and started again."""

from pyspark.sql import functions as F

from lamina.operators.geometry import motion_reslice
from lamina.streaming import frames, stateful

INPUT = "series string, input int, frames int, t int, voxel long, v double"
LENGTHS = {0: 3, 1: 2, 2: 4}


def rows_of(k, series="a"):
    return [(series, k, LENGTHS[k], t, v, 100.0 * k + 10 * t + v) for t in range(LENGTHS[k]) for v in range(5)]


def test_concatenation_in_any_order_over_restarts(spark, tmp_path):
    src, out, check = (str(tmp_path / n) for n in ("in", "out", "check"))
    land = lambda rows: spark.createDataFrame(rows, INPUT).coalesce(1).write.mode("append").parquet(src)
    run = lambda: frames.drain_files(stateful.concatenated(spark.readStream.schema(INPUT).parquet(src), 3), out, check)
    land(rows_of(0) + rows_of(2, "b"))
    assert {r.t for r in run().where("series = 'a'").collect()} == {0, 1, 2}
    land(rows_of(2))  # its place is not known before input 1 comes
    assert run().count() == 15
    land(rows_of(1)[:5])
    run()
    land(rows_of(1)[5:] + rows_of(0, "b") + rows_of(1, "b"))
    got = {(r.series, r.t, r.voxel): r.v for r in run().collect()}
    start = {0: 0, 1: 3, 2: 5}
    assert got == {(s, start[k] + t, v): x for s in "ab" for k in LENGTHS for _, _, _, t, v, x in rows_of(k)}


def test_motion_by_frame_in_a_stream(spark, tmp_path):
    src = str(tmp_path / "in")
    grid = spark.range(60).selectExpr("cast(id % 3 as int) i", "cast(id div 3 % 4 as int) j", "cast(id div 12 as int) k", "id * 1.5D v")
    both = grid.crossJoin(spark.range(3).selectExpr("cast(id as int) t")).selectExpr("t", "i", "j", "k", "v + t v")
    both.repartition(3, "t").write.parquet(src)
    moves = spark.createDataFrame([(t, [*map(float, m)]) for t, m in ((0, (1, 0, 0, 0.5, 0, 1, 0, 0, 0, 0, 1, 0)), (2, (1, 0, 0, 0, 0, 1, 0, 1, 0, 0, 1, 0)))], "t int, m array<double>")
    stream = spark.readStream.schema(both.schema).option("maxFilesPerTrigger", 1).parquet(src)
    stateful.motion_resliced(stream, moves, (3, 4, 5), str(tmp_path / "out"), str(tmp_path / "check"))
    stay = spark.createDataFrame([(1, [*map(float, (1, 0, 0, 0, 0, 1, 0, 0, 0, 0, 1, 0))])], moves.schema)
    want = motion_reslice(both, moves.unionByName(stay), (3, 4, 5))
    got = spark.read.option("recursiveFileLookup", "true").parquet(str(tmp_path / "out"))
    key = lambda df: sorted((r.t, r.i, r.j, r.k, round(r.v, 9)) for r in df.collect())
    assert key(got) == key(want)


def test_query_ends_itself(spark, tmp_path):
    src = str(tmp_path / "in")
    for t in range(12):
        spark.createDataFrame([(t, v, float(t * v)) for v in range(4)], frames.FRAME).coalesce(1).write.mode("append").parquet(src)
    args = (2, 6, 2, str(tmp_path / "out"), str(tmp_path / "check"))
    assert stateful.extract_until(frames.frame_stream(spark, src), *args) == 3
    out = spark.read.option("recursiveFileLookup", "true").parquet(str(tmp_path / "out"))
    assert {r.t for r in out.collect()} == {2, 4, 6} and out.count() == 12
    batches = len(list((tmp_path / "out").iterdir()))
    assert stateful.extract_until(frames.frame_stream(spark, src), *args) == 3  # nothing starts
    assert len(list((tmp_path / "out").iterdir())) == batches
