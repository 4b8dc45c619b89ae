"""Streams with state: frames of several inputs numbered one after the other, reslicing by each frame's own transformation, queries that end themselves."""

from __future__ import annotations

import threading
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..operators.geometry import motion_reslice
from .frames import process_frames

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Concatenation(StatefulProcessor):
    """Frame numbers of a series: those of its inputs 0, 1, ... one after the other, whichever order the inputs arrive in.

    State of a key: each input's number of frames, and the rows of inputs whose predecessors are not all known yet.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.sizes = handle.getMapState("sizes", "input int", "frames int")
        self.waiting = handle.getListState("waiting", "input int, t int, voxel long, v double")

    def starts(self) -> dict[int, int]:
        """Where each input begins whose predecessors are all known."""
        sizes = {k[0]: v[0] for k, v in self.sizes.iterator()}
        out, at, k = {0: 0}, 0, 0
        while k in sizes:
            at, k = at + sizes[k], k + 1
            out[k] = at
        return out

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        before = self.starts()
        for batch in rows:
            for k, n in batch[["input", "frames"]].drop_duplicates().itertuples(index=False):
                if not self.sizes.containsKey((int(k),)):
                    self.sizes.updateValue((int(k),), (int(n),))
            starts = self.starts()
            known = batch["input"].isin(starts)
            late = batch[~known]
            if len(late):
                self.waiting.appendList([(int(a), int(b), int(c), float(d)) for a, b, c, d in late[["input", "t", "voxel", "v"]].itertuples(index=False)])
            if known.any():
                yield self.numbered(key, batch[known], starts)
        starts = self.starts()
        if len(starts) > len(before) and self.waiting.exists():
            held = pd.DataFrame(list(self.waiting.get()), columns=["input", "t", "voxel", "v"])
            known = held["input"].isin(starts)
            if known.any():
                rest = held[~known]
                self.waiting.clear()
                if len(rest):
                    self.waiting.put([(int(a), int(b), int(c), float(d)) for a, b, c, d in rest.itertuples(index=False)])
                yield self.numbered(key, held[known], starts)

    @staticmethod
    def numbered(key, rows: pd.DataFrame, starts: dict[int, int]) -> pd.DataFrame:
        t = (rows["t"] + rows["input"].map(starts)).astype("int32")
        return pd.DataFrame({"series": key[0], "t": t, "voxel": rows["voxel"].astype("int64"), "v": rows["v"].astype(float)})

    def close(self) -> None:
        pass


def concatenated(inputs: DataFrame, parts: int = 64) -> DataFrame:
    """series, t, voxel, v from a stream of inputs(series, input, frames, t, voxel, v): frame t of input n follows all frames of inputs 0 to n - 1.

    input counts from 0 and frames is its length, on each of its rows. A series' voxels are dealt to `parts` keys, each with
    its own small count of frames, so one long series is the work of many tasks. Offsets are state: after a restart from the
    checkpoint later inputs go on behind the earlier ones.
    """
    inputs.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    keyed = inputs.withColumn("part", F.pmod(F.xxhash64("voxel"), F.lit(parts)).cast("int"))
    keyed = keyed.select(F.col("series").cast("string").alias("series"), "part", F.col("input").cast("int").alias("input"), F.col("frames").cast("int").alias("frames"), F.col("t").cast("int").alias("t"), F.col("voxel").cast("long").alias("voxel"), F.col("v").cast("double").alias("v"))
    return keyed.groupBy("series", "part").transformWithStateInPandas(Concatenation(), "series string, t int, voxel long, v double", "Append", "None")


def motion_resliced(stream: DataFrame, moves: DataFrame, dims: tuple[int, int, int], path: str, checkpoint: str) -> None:
    """Frames (t, i, j, k, v) of a stream resliced by their own 3 x 4 transformation, moves(t, m ARRAY), into path/batch=n.

    Only the moves of a batch's frames are joined; frames without one stay where they are.
    """
    stay = F.array(*[F.lit(float(r == c)) for r in range(3) for c in range(4)])

    def work(batch: DataFrame) -> DataFrame:
        own = batch.select("t").distinct().join(moves.select("t", "m"), "t", "left").select("t", F.coalesce("m", stay).alias("m"))
        return motion_reslice(batch.select("t", "i", "j", "k", "v"), own, dims)

    process_frames(stream, work, path, checkpoint)


def extract_until(stream: DataFrame, begin: int, end: int, step: int, path: str, checkpoint: str, wait: float = 0.2) -> int:
    """Frames begin, begin + step, ... up to end of (t, ...) into path/batch=n; the query stops itself as soon as all are there, and the rest of the stream is not read.

    Frames must arrive whole. What earlier runs wrote counts, so a run after the end starts nothing. Returns the number of frames written.
    """
    spark, want, done = stream.sparkSession, len(range(begin, end + 1, step)), threading.Event()
    picked = stream.where(F.col("t").between(begin, end) & ((F.col("t") - begin) % step == 0))

    def written() -> int:
        try:
            return spark.read.schema(stream.schema).option("recursiveFileLookup", "true").parquet(path).select("t").distinct().count()
        except Exception as e:
            if "PATH_NOT_FOUND" in str(e):
                return 0
            raise

    def write(batch: DataFrame, n: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={n}")
        if written() >= want:
            done.set()

    if written() < want:
        q = picked.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).start()
        while not done.wait(wait) and q.isActive:
            pass
        if q.isActive:
            q.stop()
        if q.exception():
            raise q.exception()
    return written()
