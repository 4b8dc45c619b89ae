"""Readers and writers of array files as Spark tables: matrices, tasks, events, images.

Text formats are read as lines with their file and line number and parsed by expressions. Binary formats are read with
binaryFile; a small parser per file turns one file into rows inside the tasks, so many files are read in parallel.
"""

from __future__ import annotations

import gzip
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Fixed values of the NIfTI-1 header: data type code -> numpy type.
NIFTI_TYPES = {2: "u1", 4: "i2", 8: "i4", 16: "f4", 64: "f8", 256: "i1", 512: "u2", 768: "u4", 1024: "i8", 1280: "u8"}
#: Fixed values of the binary matrix format: magic, and type code -> numpy type.
BINARY_MAGIC, BINARY_TYPES = 1700, {1: "<i8", 2: "<f4", 3: "<f8"}


def lines(spark: SparkSession, path: str) -> DataFrame:
    """file, n (from 0), line of text files, each file read whole and split in the task that reads it."""
    t = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.regexp_replace("value", "\r", "").alias("value"))
    return t.select("file", F.posexplode(F.split("value", "\n")).alias("n", "line"))


def read_matrix(spark: SparkSession, path: str) -> DataFrame:
    """file, row, vals of text matrices: commas, tabs and blanks separate; lines that start with # are left out.

    The matrix is the first run of consecutive lines of equal width that are all numbers; headers before it and text
    after it are left out.
    """
    number = r"^[+-]?(\d+\.?\d*([eE][+-]?\d+)?|\.\d+([eE][+-]?\d+)?|[nN]a[nN])$"
    x = lines(spark, path).where("trim(line) <> '' and not startswith(trim(line), '#')")
    parts = F.filter(F.split(F.trim("line"), r"[\s,]+"), lambda p: p != "")
    x = x.select("file", "n", parts.alias("p")).withColumn("w", F.when(F.forall("p", lambda p: p.rlike(number)), F.size("p")).otherwise(0))
    by = Window.partitionBy("file").orderBy("n")
    x = x.withColumn("new", F.when(F.col("w") == F.lag("w").over(by), 0).otherwise(1)).withColumn("run", F.sum("new").over(by)).where("w > 0")
    x = x.withColumn("first", F.min("run").over(Window.partitionBy("file"))).where("run = first")
    row = F.row_number().over(by) - 1
    return x.select("file", row.alias("row"), F.transform("p", lambda p: F.when(F.lower(p) == "nan", F.lit(float("nan"))).otherwise(p.try_cast("double"))).alias("vals"))


def read_matr(spark: SparkSession, path: str) -> DataFrame:
    """file, row, vals of .matr files: header lines that start with #, of which "# rows: n" and "# columns: n" give the size, then a line for each row.

    Files whose header has the two numbers alone in its fourth line, and a name line after it, are read as well. Rows beyond the size are left out.
    """
    x = lines(spark, path).withColumn("line", F.trim("line"))
    after = lambda name: F.max(F.regexp_extract("line", rf"^#\s*{name}:\s*(\d+)", 1).try_cast("int"))
    old = F.max(F.when(F.col("n") == 3, F.regexp_extract("line", r"^(\d+)\s+\d+$", 1).try_cast("int")))
    size = x.groupBy("file").agg(after("rows").alias("new"), old.alias("old")).select("file", F.coalesce("new", "old").alias("rows"))
    body = x.join(size, "file").where("line <> '' and not startswith(line, '#') and n >= 4")
    vals = F.transform(F.split("line", r"\s+"), lambda p: F.when(F.lower(p) == "nan", F.lit(float("nan"))).otherwise(p.try_cast("double")))
    return body.select("file", (F.row_number().over(Window.partitionBy("file").orderBy("n")) - 1).alias("row"), vals.alias("vals"), "rows").where("row < rows").drop("rows")


def to_csv_lines(matrix: DataFrame) -> DataFrame:
    """row, value: ', '-separated text lines of (row, vals)."""
    return matrix.select("row", F.array_join(F.transform("vals", lambda v: v.cast("string")), ", ").alias("value"))


def binary_matrix(data: bytes) -> np.ndarray:
    magic, kind, rows, cols = np.frombuffer(data, "<i4", 4)
    if magic != BINARY_MAGIC or kind not in BINARY_TYPES:
        raise ValueError(f"not a binary matrix: magic {magic}, type {kind}")
    return np.frombuffer(data, BINARY_TYPES[int(kind)], int(rows) * int(cols), 16).reshape(rows, cols)


def binary_matrix_bytes(m: np.ndarray) -> bytes:
    kind = next(k for k, t in BINARY_TYPES.items() if np.dtype(t) == m.dtype)
    return np.array([BINARY_MAGIC, kind, *m.shape], "<i4").tobytes() + np.ascontiguousarray(m).tobytes()


def read_binary_matrix(spark: SparkSession, path: str) -> DataFrame:
    """file, row, vals of .binmatr files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                m = binary_matrix(data).astype(float)
                yield pa.RecordBatch.from_pydict({"file": [name] * len(m), "row": np.arange(len(m), dtype=np.int32), "vals": list(m)})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, "file string, row int, vals array<double>")


def nifti_header(data: bytes) -> dict:
    """Sizes, type, offset, spacing and scaling of a NIfTI-1 file, either byte order."""
    order = "<" if np.frombuffer(data[:4], "<i4")[0] == 348 else ">"
    if np.frombuffer(data[:4], f"{order}i4")[0] != 348:
        raise ValueError("not a NIfTI-1 header")
    take = lambda at, t, n=1: np.frombuffer(data, f"{order}{t}", n, at)
    dim = take(40, "i2", 8)
    slope, shift = float(take(112, "f4")[0]), float(take(116, "f4")[0])
    return {
        "dims": [int(dim[k + 1]) if k < dim[0] else 1 for k in range(5)], "type": order + NIFTI_TYPES[int(take(70, "i2")[0])], "code": int(take(70, "i2")[0]),
        "offset": int(take(108, "f4")[0]), "spacing": [float(x) for x in take(80, "f4", 5)], "slope": slope or 1.0, "shift": shift if slope else 0.0,
    }


def nifti_bytes(values: np.ndarray, spacing: tuple[float, ...] = (1.0, 1.0, 1.0, 1.0)) -> bytes:
    """A NIfTI-1 single file of an array with axes i, j, k, t."""
    code = next(c for c, t in NIFTI_TYPES.items() if np.dtype(t) == values.dtype)
    h = bytearray(352)
    h[0:4] = np.array([348], "<i4").tobytes()
    h[40:56] = np.array([values.ndim, *values.shape, *[1] * (7 - values.ndim)], "<i2").tobytes()
    h[70:74] = np.array([code, values.dtype.itemsize * 8], "<i2").tobytes()
    h[76:108] = np.array([1, *spacing, *[1] * (7 - len(spacing))], "<f4").tobytes()
    h[108:120] = np.array([352, 1, 0], "<f4").tobytes()
    h[344:348] = b"n+1\0"
    return bytes(h) + values.tobytes(order="F")


def _unpacked(data: bytes) -> bytes:
    return gzip.decompress(data) if data[:2] == b"\x1f\x8b" else data


def read_nifti_headers(spark: SparkSession, path: str) -> DataFrame:
    """file, dims, code, spacing, frame_bytes of each image; tasks read the few bytes of a header."""
    from .ranges import read_headers

    return read_headers(spark, path)


def read_nifti(spark: SparkSession, path: str) -> DataFrame:
    """file, voxel, i, j, k, ts of each voxel of .nii and .nii.gz images; one batch of rows for each k plane."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                data = _unpacked(data)
                h = nifti_header(data)
                a, b, c, t, _ = h["dims"]
                v = np.frombuffer(data, h["type"], a * b * c * t, h["offset"]).reshape(a, b, c, t, order="F")
                i, j = (x.ravel(order="F") for x in np.meshgrid(np.arange(a), np.arange(b), indexing="ij"))
                for k in range(c):
                    ts = v[:, :, k].reshape(a * b, t, order="F").astype(float) * h["slope"] + h["shift"]
                    cols = [pa.array([name] * (a * b)), pa.array((i + a * (j + b * k)).astype(np.int64)), *(pa.array(x.astype(np.int32)) for x in (i, j, np.full(a * b, k))), pa.array(list(ts), pa.list_(pa.float64()))]
                    yield pa.RecordBatch.from_arrays(cols, ["file", "voxel", "i", "j", "k", "ts"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, "file string, voxel long, i int, j int, k int, ts array<double>")


def read_tasks(spark: SparkSession, path: str) -> DataFrame:
    """run, task, lo, hi of task designs in JSON: {"runs": {run: {task: "lo-hi" or [..]}}, "offset": n}; hi is one after the last frame given."""
    t = spark.read.text(path, wholetext=True)
    runs = F.from_json(F.get_json_object("value", "$.runs"), "map<string, map<string, string>>")
    offset = F.coalesce(F.get_json_object("value", "$.offset").cast("int"), F.lit(0))
    t = t.select(offset.alias("o"), F.explode(runs).alias("run", "tasks")).select("o", "run", F.explode("tasks").alias("task", "text"))
    each = F.explode(F.expr(r"regexp_extract_all(text, '(\\d+-\\d+)', 1)"))
    return t.select("o", "run", "task", each.alias("r")).select("run", "task", (F.split("r", "-")[0].cast("int") - F.col("o")).alias("lo"), (F.split("r", "-")[1].cast("int") - F.col("o")).alias("hi"))


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """run, task, lo, hi from event TSV files with columns onset, duration, trial_type; the run is in the file's name."""
    t = spark.read.csv(path, sep="\t", header=True)
    run = F.regexp_extract(F.input_file_name(), r"run-(\d+)", 1)
    lo = F.col("onset").cast("int")
    return t.where("onset is not null").select(run.alias("run"), F.col("trial_type").alias("task"), lo.alias("lo"), (lo + F.col("duration").cast("int")).alias("hi"))


def group_subject_files(spark: SparkSession, path: str) -> DataFrame:
    """subject, files (name -> text) of CSV files named sub<number>_...; other files are left out."""
    t = spark.read.text(path, wholetext=True, pathGlobFilter="sub*_*.csv").select(F.substring_index(F.input_file_name(), "/", -1).alias("name"), "value")
    t = t.withColumn("subject", F.regexp_extract("name", r"^(sub\d+)_", 1)).where("subject <> ''")
    return t.groupBy("subject").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("name", "value")))).alias("files"))


def read_surface(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """vertices(file, id, x, y, z) and faces(file, id, v0, v1, v2) of ASCII PLY and legacy VTK polygon files."""
    x = lines(spark, path).withColumn("line", F.trim("line")).where("line <> ''")
    by = Window.partitionBy("file").orderBy("n")
    ply = F.max(F.when(F.lower("line") == "ply", 1).otherwise(0)).over(Window.partitionBy("file")) == 1
    x = x.withColumn("ply", ply)
    # PLY: counts in the header, then that many vertices and faces. VTK: POINTS n, POLYGONS n, each followed by rows.
    x = x.withColumn("head", F.max(F.when(F.lower("line") == "end_header", F.col("n"))).over(Window.partitionBy("file")))
    x = x.withColumn("nv", F.max(F.regexp_extract("line", r"^(?i:element vertex|POINTS)\s+(\d+)", 1).try_cast("int")).over(Window.partitionBy("file")))
    x = x.withColumn("part", F.last(F.when(F.col("line").rlike("^POINTS"), "v").when(F.col("line").rlike("^POLYGONS"), "f").when(F.col("line").rlike("^[A-Z_]+"), "o"), ignorenulls=True).over(by))
    rows = x.where(F.when(F.col("ply"), F.col("n") > F.col("head")).otherwise(~F.col("line").rlike("^[A-Za-z#_]"))).withColumn("p", F.split("line", r"\s+"))
    at = F.row_number().over(by) - 1
    p = rows.where("ply").withColumn("at", at)
    num = lambda k: F.col("p")[k].cast("double")
    v_ply = p.where("at < nv").select("file", "at", F.slice("p", 1, 3).alias("p"))
    f_ply = p.where("at >= nv").select("file", (F.col("at") - F.col("nv")).alias("at"), "p")
    vtk = rows.where("not ply")
    flat = lambda kind, width: vtk.where(F.col("part") == kind).select("file", "n", F.posexplode("p").alias("c", "x")).withColumn("q", F.row_number().over(Window.partitionBy("file").orderBy("n", "c")) - 1).groupBy("file", F.floor(F.col("q") / width).cast("int").alias("at")).agg(F.transform(F.array_sort(F.collect_list(F.struct("q", "x"))), lambda s: s["x"]).alias("p"))
    v, f = v_ply.unionByName(flat("v", 3)), f_ply.unionByName(flat("f", 4))
    whole = lambda k: F.col("p")[k].cast("int")
    return v.select("file", F.col("at").alias("id"), num(0).alias("x"), num(1).alias("y"), num(2).alias("z")), f.select("file", F.col("at").alias("id"), whole(1).alias("v0"), whole(2).alias("v1"), whole(3).alias("v2"))


def connectivity_json(groups: DataFrame) -> DataFrame:
    """value: one JSON object of all subjects of group_subject_files(), each with its files' names and texts. One row, as the file is one object; subjects are in order."""
    rows = groups.select("subject", F.to_json("files").alias("files"))
    entry = F.concat(F.to_json(F.array("subject")).substr(F.lit(2), F.length(F.to_json(F.array("subject"))) - 2), F.lit(":"), F.col("files"))
    whole = F.transform(F.array_sort(F.collect_list(F.struct("subject", entry.alias("e")))), lambda x: x["e"])
    return rows.agg(F.concat(F.lit("{"), F.array_join(whole, ","), F.lit("}")).alias("value"))
