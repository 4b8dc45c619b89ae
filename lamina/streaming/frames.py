"""Streams: frames of images that arrive as files, and event-time windows over event tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FRAME = "t int, voxel long, v double"


def frame_stream(spark: SparkSession, path: str, files_each: int = 1) -> DataFrame:
    """Frames (t, voxel, v) as Parquet files land under a path."""
    return spark.readStream.schema(FRAME).option("maxFilesPerTrigger", files_each).parquet(path)


def roi_means(frames: DataFrame, labels: DataFrame) -> DataFrame:
    """Sums and counts of each region and frame; a stream-static join, then a running aggregate."""
    return frames.join(labels, "voxel").where("label > 0").groupBy("t", "label").agg(F.avg("v").alias("v"), F.count(F.lit(1)).alias("n"))


def masked(frames: DataFrame, mask: DataFrame) -> DataFrame:
    """Frames with 0 outside a static mask(voxel); stateless."""
    return frames.join(mask.select("voxel", F.lit(True).alias("_in")), "voxel", "left").select("t", "voxel", F.when(F.col("_in"), F.col("v")).otherwise(0.0).alias("v"))


def extract_frames(frames: DataFrame, begin: int, end: int, step: int) -> DataFrame:
    return frames.where(F.col("t").between(begin, end) & ((F.col("t") - begin) % step == 0))


def windows(events: DataFrame, length: str, slide: str | None = None, late: str = "1 hour") -> DataFrame:
    """Counts and sums by event type in tumbling or sliding windows of event time, late rows within a watermark."""
    e = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    w = F.window("ts", length, slide) if slide else F.window("ts", length)
    return e.groupBy("event_type", w.alias("w")).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("v")).select("event_type", F.col("w.start").alias("start"), "n", "v")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    e = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return e.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count(F.lit(1)).alias("n")).select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def distinct_events(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """Each event id once, its state dropped after the watermark."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])


def concatenate(parts: list[tuple[DataFrame, int]]) -> DataFrame:
    """Frames of several streams one after the other: each is a stream and its number of frames, which sets where the next begins."""
    out, at = None, 0
    for frames, n in parts:
        moved = frames.withColumn("t", F.col("t") + at)
        out, at = moved if out is None else out.unionByName(moved), at + n
    return out


def joined(left: DataFrame, right: DataFrame, by: str, within: str, late: str = "1 hour") -> DataFrame:
    """Stream-stream join: rows of both (by, ts, ...) whose right one follows the left one within an interval; state is dropped by both watermarks."""
    a = left.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).alias("a")
    b = right.select(F.col(by).alias("_by"), F.col("ts").cast("timestamp").alias("follow_ts"), *[F.col(c).alias(f"follow_{c}") for c in right.columns if c not in (by, "ts")]).withWatermark("follow_ts", late).alias("b")
    near = F.expr(f"follow_ts >= ts and follow_ts <= ts + interval {within}")
    return a.join(b, (F.col(by) == F.col("_by")) & near).drop("_by")


def process_frames(stream: DataFrame, work: Callable[[DataFrame], DataFrame], path: str, checkpoint: str) -> None:
    """Run a batch operator on each micro-batch of frames that are there and write its rows under path/batch=n.

    A batch that is run again after a failure overwrites its own folder, so no frame is written twice. Frames must arrive
    whole (a file holds whole frames); smoothing, resampling and reslicing by frame then need no state between batches.
    """

    def write(batch: DataFrame, n: int) -> None:
        work(batch).write.mode("overwrite").parquet(f"{path}/batch={n}")

    q = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()


def drain(stream: DataFrame, name: str, checkpoint: str, mode: str = "complete") -> DataFrame:
    """Run a stream over all that is there and return its result table: the batch form of a stream, for tests."""
    q = stream.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.table(name)


def drain_files(stream: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """Run a stream over all that is there into Parquet files and return them; run again with the same checkpoint, it goes on where it ended."""
    q = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(path)
