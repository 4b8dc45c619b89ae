"""Images and binary matrices read by ranges of bytes, so that one large file is the work of many tasks.

Python data sources: planning reads a header of each file (a few hundred bytes, by a pool of threads), a task reads the range of
whole records that it was given: planes of an image, rows of a matrix. Comparisons of t and k are pushed down and leave out
planes before anything is read. A gzip file has no places to start from: it is one task that unpacks as it goes, holds one
plane, and stops after the last plane asked for. As a stream, the source's offset is a file's name and its number of frames.
Paths are what pyarrow.fs opens (local and shared folders, object stores, HDFS where its library is installed).
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from fnmatch import fnmatch
from operator import eq, ge, gt, le, lt
from posixpath import basename, dirname

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

from .files import BINARY_MAGIC, BINARY_TYPES, nifti_header
from .images import NRRD_TYPES

PLANES = "file string, t int, k int, voxel long, v double"
ROWS = "file string, row long, vals array<double>"
HEAD = 4096  # bytes that hold the header of a plain file


@dataclass
class Layout(InputPartition):
    """Where the records of a file are: record n has shape values and starts at offset + n * bytes; frames of planes are t * planes + k."""

    path: str
    packed: bool
    offset: int
    kind: str
    shape: tuple[int, ...]
    planes: int
    records: int
    slope: float = 1.0
    shift: float = 0.0
    first: int = 0
    chosen: tuple[int, ...] = ()  # of a packed file: the records wanted

    @property
    def bytes(self) -> int:
        return int(np.prod(self.shape)) * np.dtype(self.kind).itemsize


def opened(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path if "://" in path or path.startswith("/") else path.replace("file:", "file://", 1))


def listed(path: str) -> list[tuple[str, int]]:
    """(path, size) of the files under a folder, of one file, or of those whose names match a pattern in the last part; sorted."""
    fs, base = opened(path)
    info = fs.get_file_info(base)
    if info.type == pafs.FileType.File:
        return [(path, info.size)]
    pattern = "*" if info.type == pafs.FileType.Directory else basename(base)
    folder = base if pattern == "*" else dirname(base)
    root = path[: len(path) - len(base)] if path.endswith(base) else ""
    found = fs.get_file_info(pafs.FileSelector(folder, recursive=False))
    return sorted((root + f.path, f.size) for f in found if f.type == pafs.FileType.File and fnmatch(f.base_name, pattern) and not f.base_name.startswith((".", "_")))


def unpacked(stream, want: int) -> Iterator[bytes]:
    """Pieces of a gzip stream's content, unpacked as they are read."""
    inflate = zlib.decompressobj(31)
    while piece := stream.read(max(HEAD, min(1 << 20, want))):
        while piece:
            out = inflate.decompress(piece)
            if out:
                yield out
            piece = inflate.unused_data if inflate.eof else b""
            if inflate.eof and piece:
                inflate = zlib.decompressobj(31)


def head_of(path: str) -> tuple[bytes, bool]:
    """The first bytes of a file's content, and whether it is packed; no more than they need is read."""
    fs, base = opened(path)
    with fs.open_input_file(base) as f:
        start = f.read_at(HEAD, 0)
    if start[:2] != b"\x1f\x8b":
        return start, False
    with fs.open_input_stream(base, compression=None) as f:
        out = b""
        for piece in unpacked(f, HEAD):
            out += piece
            if len(out) >= HEAD:
                break
    return out[:HEAD], True


def layout(path: str) -> Layout:
    head, packed = head_of(path)
    if head[:4] == b"NRRD":
        text = head.partition(b"\n\n")[0]
        field = {k.strip().lower(): v.strip() for k, _, v in (r.partition(":") for r in text.decode("ascii", "replace").splitlines()[1:] if r and not r.startswith("#"))}
        if field.get("encoding", "raw") != "raw" or len(text) == len(head):
            raise ValueError(f"{path}: only raw NRRD data after a header of at most {HEAD} bytes is read by ranges")
        sizes = [int(x) for x in field["sizes"].split()]
        a, b, c, t = (sizes + [1] * 4)[:4]
        return Layout(path, packed, len(text) + 2, (">" if field.get("endian") == "big" else "<") + NRRD_TYPES[field["type"]], (a, b), c, c * t)
    if len(head) >= 16 and np.frombuffer(head, "<i4", 1)[0] == BINARY_MAGIC:
        _, kind, rows, cols = (int(x) for x in np.frombuffer(head, "<i4", 4))
        return Layout(path, packed, 16, BINARY_TYPES[kind], (cols,), 1, rows)
    h = nifti_header(head)
    a, b, c, t, u = h["dims"]
    return Layout(path, packed, h["offset"], h["type"], (a, b), c, c * t * u, h["slope"], h["shift"])


def layouts(files: list[str]) -> list[Layout]:
    with ThreadPoolExecutor(32) as pool:
        return list(pool.map(layout, files))


def cut(part: Layout, records: np.ndarray, most: int) -> Iterator[Layout]:
    """Partitions of about `most` bytes that hold the given records; runs of consecutive ones of a plain file are read at once."""
    if not len(records):
        return
    if part.packed:
        yield Layout(**{**part.__dict__, "chosen": tuple(int(r) for r in records), "records": len(records)})
        return
    each = max(1, most // max(1, part.bytes))
    for run in np.split(records, np.flatnonzero(np.diff(records) != 1) + 1):
        for at in range(0, len(run), each):
            yield Layout(**{**part.__dict__, "first": int(run[at]), "records": min(each, len(run) - at)})


def values(part: Layout) -> Iterator[tuple[int, np.ndarray]]:
    """(record, its values) of a partition; one record is held at a time."""
    fs, base = opened(part.path)
    if not part.packed:
        with fs.open_input_file(base) as f:
            for r in range(part.first, part.first + part.records):
                yield r, np.frombuffer(f.read_at(part.bytes, part.offset + r * part.bytes), part.kind)
        return
    want, at, kept = set(part.chosen), 0, bytearray()  # at: place in the content of kept[0]
    r, last = 0, max(part.chosen)
    with fs.open_input_stream(base, compression=None) as f:
        for piece in unpacked(f, part.bytes):
            kept += piece
            while r <= last and at + len(kept) >= part.offset + (r + 1) * part.bytes:
                begin = part.offset + r * part.bytes - at
                if r in want:
                    yield r, np.frombuffer(bytes(kept[begin : begin + part.bytes]), part.kind)
                del kept[: begin + part.bytes]
                at += begin + part.bytes
                r += 1
            if r > last:
                return


class _Reader:
    """Reading a partition, for batches and streams alike."""

    def read(self, part: Layout) -> Iterator[pa.RecordBatch]:
        name = basename(part.path)
        if len(part.shape) == 1:
            for r, v in values(part):
                yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([r], pa.int64()), pa.array([v.astype(float)], pa.list_(pa.float64()))], ["file", "row", "vals"])
            return
        n = part.shape[0] * part.shape[1]
        for r, v in values(part):
            t, k = divmod(r, part.planes)
            cols = [pa.array([name] * n), pa.array(np.full(n, t, np.int32)), pa.array(np.full(n, k, np.int32)), pa.array(np.arange(k * n, (k + 1) * n)), pa.array(v.astype(float) * part.slope + part.shift)]
            yield pa.RecordBatch.from_arrays(cols, ["file", "t", "k", "voxel", "v"])


class _Batch(_Reader, DataSourceReader):
    COMPARE = {EqualTo: eq, GreaterThan: gt, GreaterThanOrEqual: ge, LessThan: lt, LessThanOrEqual: le}

    def __init__(self, options: dict) -> None:
        self.path, self.most = options["path"], int(options.get("rangebytes", 64 << 20))
        self.tests: list[tuple[str, object, object]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            name = f.attribute[0] if hasattr(f, "attribute") and len(f.attribute) == 1 else None
            if name in ("t", "k") and type(f) in self.COMPARE:
                self.tests.append((name, self.COMPARE[type(f)], f.value))
            elif name in ("t", "k") and isinstance(f, In):
                self.tests.append((name, np.isin, list(f.value)))
            else:
                yield f

    def partitions(self) -> list[Layout]:
        out = []
        for part in layouts([p for p, _ in listed(self.path)]):
            records = np.arange(part.records)
            place = {"t": records // part.planes, "k": records % part.planes}
            for name, test, value in self.tests:
                keep = test(place[name], value)
                place = {n: v[keep] for n, v in place.items()}
                records = records[keep]
            out += cut(part, records, self.most)
        return out


class _Stream(_Reader, DataSourceStreamReader):
    """Frames in the order of files' names and of frames in each. A file may grow; a new one must sort after those seen."""

    def __init__(self, options: dict) -> None:
        self.path, self.most = options["path"], int(options.get("rangebytes", 64 << 20))

    def initialOffset(self) -> dict:
        return {"file": "", "frames": 0}

    def there(self, path: str, size: int) -> int:
        """Whole frames that a file holds by now."""
        part = layout(path)
        whole = part.records if part.packed else min(part.records, (size - part.offset) // part.bytes)
        return whole // part.planes

    def latestOffset(self) -> dict:
        files = listed(self.path)
        return {"file": files[-1][0], "frames": self.there(*files[-1])} if files else self.initialOffset()

    def partitions(self, start: dict, end: dict) -> list[Layout]:
        out = []
        for path, size in listed(self.path):
            if start["file"] <= path <= end["file"]:
                part = layout(path)
                begin = start["frames"] if path == start["file"] else 0
                stop = end["frames"] if path == end["file"] else self.there(path, size)
                out += cut(part, np.arange(begin * part.planes, stop * part.planes), self.most)
        return out


class ArrayRanges(DataSource):
    """Planes (file, t, k, voxel, v) of NIfTI-1 and raw NRRD files; option matrix = true: rows (file, row, vals) of binary matrices."""

    @classmethod
    def name(cls) -> str:
        return "array_ranges"

    def schema(self) -> str:
        return ROWS if self.options.get("matrix") == "true" else PLANES

    def reader(self, schema) -> DataSourceReader:
        return _Batch(self.options)

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _Stream(self.options)


def _source(spark: SparkSession) -> None:
    spark.dataSource.register(ArrayRanges)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def read_planes(spark: SparkSession, path: str, range_bytes: int = 64 << 20) -> DataFrame:
    """file, t, k, voxel, v of the images of a folder, file or pattern; filters on t and k read only the planes they keep."""
    _source(spark)
    return spark.read.format("array_ranges").option("rangebytes", range_bytes).load(path)


def read_matrix_rows(spark: SparkSession, path: str, range_bytes: int = 64 << 20) -> DataFrame:
    """file, row, vals of binary matrices."""
    _source(spark)
    return spark.read.format("array_ranges").option("rangebytes", range_bytes).option("matrix", "true").load(path)


def plane_stream(spark: SparkSession, path: str, range_bytes: int = 64 << 20) -> DataFrame:
    """The same planes as a stream: files that land in the folder and frames by which its last file grows."""
    _source(spark)
    return spark.readStream.format("array_ranges").option("rangebytes", range_bytes).load(path)


def read_headers(spark: SparkSession, path: str) -> DataFrame:
    """file, dims, code, spacing, frame_bytes of NIfTI images: Spark lists the files, tasks read the bytes of a header."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name in batch.column(0).to_pylist():
                h = nifti_header(head_of(name)[0])
                frame = int(np.prod(h["dims"][:3])) * np.dtype(h["type"]).itemsize
                yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([h["dims"]], pa.list_(pa.int32())), pa.array([h["code"]], pa.int32()), pa.array([h["spacing"]], pa.list_(pa.float64())), pa.array([frame], pa.int64())], ["file", "dims", "code", "spacing", "frame_bytes"])

    files = spark.read.format("binaryFile").load(path).select("path")
    return files.mapInArrow(run, "file string, dims array<int>, code int, spacing array<double>, frame_bytes long")
