"""More image and transformation files: NRRD, TIFF stacks, grid transformations, and a sink of whole files such as NIfTI images."""

from __future__ import annotations

import gzip
import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from .files import lines, nifti_bytes

#: Fixed values of the NRRD header: type name -> numpy type.
NRRD_TYPES = {"uint8": "u1", "uchar": "u1", "unsigned char": "u1", "int8": "i1", "int16": "i2", "short": "i2", "uint16": "u2", "ushort": "u2", "int32": "i4", "int": "i4", "uint32": "u4", "float": "f4", "double": "f8"}
#: Fixed values of TIFF: tag numbers, and field type -> numpy type.
WIDTH, HEIGHT, BITS, COMPRESSION, OFFSETS, SAMPLES, COUNTS, PREDICTOR, SAMPLE_FORMAT = 256, 257, 258, 259, 273, 277, 279, 317, 339
PLAIN, LZW, DEFLATE, OLD_DEFLATE, PACKED_BITS = 1, 5, 8, 32946, 32773
TIFF_FIELDS = {1: "u1", 3: "u2", 4: "u4"}
VOXELS = "file string, voxel long, i int, j int, k int, c int, v double"


def nrrd_array(data: bytes) -> np.ndarray:
    """The array of an NRRD file with attached raw or gzip data; axes in the file's order, fastest first."""
    head, _, body = data.partition(b"\n\n")
    rows = head.decode("ascii", "replace").splitlines()
    if not rows or not rows[0].startswith("NRRD"):
        raise ValueError("not an NRRD file")
    field = {k.strip().lower(): v.strip() for k, _, v in (r.partition(":") for r in rows[1:] if r and not r.startswith("#"))}
    coding = field.get("encoding", "raw")
    if coding not in ("raw", "gzip", "gz"):
        raise ValueError(f"encoding {coding} of NRRD is not read")
    kind = (">" if field.get("endian") == "big" else "<") + NRRD_TYPES[field["type"]]
    sizes = [int(x) for x in field["sizes"].split()]
    return np.frombuffer(body if coding == "raw" else gzip.decompress(body), kind, int(np.prod(sizes))).reshape(sizes, order="F")


def unpack_bits(data: bytes) -> bytes:
    """Runs of bytes: a count n of 0..127 is followed by n + 1 bytes, one of 129..255 by a byte that stands 257 - n times."""
    out, at = bytearray(), 0
    while at < len(data):
        n = data[at]
        if n < 128:
            out += data[at + 1 : at + 2 + n]
            at += n + 2
        else:
            if n > 128:
                out += data[at + 1 : at + 2] * (257 - n)
            at += 2 if n > 128 else 1
    return bytes(out)


def unpack_lzw(data: bytes) -> bytes:
    """Codes of 9 to 12 bits, most significant bit first; 256 clears the table, 257 ends; a width grows one code early."""
    first = [bytes([k]) for k in range(256)] + [b"", b""]
    table, width, last, out, bits, held = list(first), 9, None, bytearray(), 0, 0
    for byte in data:
        held, bits = held << 8 | byte, bits + 8
        if bits < width:
            continue
        bits -= width
        code, held = held >> bits, held & (1 << bits) - 1
        if code == 257:
            break
        if code == 256:
            table, width, last = list(first), 9, None
            continue
        piece = table[code] if code < len(table) else last + last[:1]
        if last is not None:
            table.append(last + piece[:1])
        out += piece
        last = piece
        width = 9 if len(table) < 511 else 10 if len(table) < 1023 else 11 if len(table) < 2047 else 12
    return bytes(out)


def tiff_array(data: bytes) -> np.ndarray:
    """The pages of a TIFF in strips, plain or packed (runs, LZW, deflate), with axes i (width), j (height), k (page), c (sample)."""
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    if order is None or np.frombuffer(data, f"{order}u2", 1, 2)[0] != 42:
        raise ValueError("not a TIFF file")
    one = lambda at, t: int(np.frombuffer(data, order + t, 1, at)[0])
    at, pages = one(4, "u4"), []
    while at:
        tags, n = {}, one(at, "u2")
        for e in range(at + 2, at + 2 + 12 * n, 12):
            kind, count = TIFF_FIELDS.get(one(e + 2, "u2")), one(e + 4, "u4")
            if kind:
                inline = count * np.dtype(kind).itemsize <= 4
                tags[one(e, "u2")] = np.frombuffer(data, order + kind, count, e + 8 if inline else one(e + 8, "u4")).tolist()
        coding = tags.get(COMPRESSION, [PLAIN])[0]
        unpack = {PLAIN: bytes, LZW: unpack_lzw, DEFLATE: zlib.decompress, OLD_DEFLATE: zlib.decompress, PACKED_BITS: unpack_bits}.get(coding)
        if unpack is None or OFFSETS not in tags:
            raise ValueError(f"a TIFF of compression {coding} or in tiles is not read")
        width, height, samples = tags[WIDTH][0], tags[HEIGHT][0], tags.get(SAMPLES, [1])[0]
        kind = {1: "u", 2: "i", 3: "f"}[tags.get(SAMPLE_FORMAT, [1])[0]] + str(tags.get(BITS, [8])[0] // 8)
        raw = b"".join(unpack(data[o : o + n]) for o, n in zip(tags[OFFSETS], tags[COUNTS]))
        page = np.frombuffer(raw, order + kind, width * height * samples).reshape(height, width, samples)
        if tags.get(PREDICTOR, [1])[0] == 2:  # differences along a row
            page = np.cumsum(page, axis=1, dtype=page.dtype)
        pages.append(page.transpose(1, 0, 2))
        at = one(at + 2 + 12 * n, "u4")
    return np.stack(pages, axis=2)


def _read(spark: SparkSession, path: str, parse: Callable[[bytes], np.ndarray]) -> DataFrame:
    """file, voxel, i, j, k, c, v of each file's array; one batch of rows for each plane, so a task holds one file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                a = parse(data)
                a = a.reshape(*a.shape, *[1] * (4 - a.ndim))
                x, y, z, parts = a.shape
                i, j = (v.ravel(order="F") for v in np.meshgrid(np.arange(x), np.arange(y), indexing="ij"))
                for k in range(z):
                    for c in range(parts):
                        whole = [np.full(x * y, v, np.int32) for v in (k, c)]
                        cols = [pa.array([name] * (x * y)), pa.array((i + x * (j + y * k)).astype(np.int64)), *(pa.array(v.astype(np.int32)) for v in (i, j, *whole)), pa.array(a[:, :, k, c].ravel(order="F").astype(float))]
                        yield pa.RecordBatch.from_arrays(cols, ["file", "voxel", "i", "j", "k", "c", "v"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, VOXELS)


def read_nrrd(spark: SparkSession, path: str) -> DataFrame:
    return _read(spark, path, nrrd_array)


def read_tiff(spark: SparkSession, path: str) -> DataFrame:
    return _read(spark, path, tiff_array)


def read_grid_transform(spark: SparkSession, path: str) -> tuple[dict, DataFrame]:
    """A grid transformation: its few parameters (linear 3 x 4, origin, spacing, dims), and its nodes(gi, gj, gk, dx, dy, dz).

    A file without a linear part has the identity there. The number of parameters is fixed; nodes stay in Spark.
    """
    x = lines(spark, path).withColumn("line", F.trim("line")).where("line <> ''")
    mark = x.withColumn("part", F.when(F.col("line").startswith("#"), F.lower(F.substring("line", 2, 100))))
    starts = {r["part"]: r["n"] for r in mark.where("part is not null").select("part", "n").collect()}
    nodes_at = starts["displacements"]
    few = {r["n"]: r["line"].split() for r in x.where((F.col("n") < nodes_at) & ~F.col("line").startswith("#")).select("n", "line").collect()}
    after = lambda part, rows=1: [[float(v) for v in few[starts[part] + 1 + r]] for r in range(rows)]
    linear = after("linear component", 3) if "linear component" in starts else [[1.0, 0, 0, 0], [0, 1.0, 0, 0], [0, 0, 1.0, 0]]
    dims = [int(v) for v in after("dimensions")[0]]
    p = x.where(F.col("n") > nodes_at).where(~F.col("line").startswith("#")).select(F.split("line", r"\s+").alias("p"))
    at = F.col("p")[0].cast("long")
    place = [(at % dims[0]), F.floor(at / dims[0]) % dims[1], F.floor(at / (dims[0] * dims[1]))]
    nodes = p.select(*[c.cast("int").alias(f"g{a}") for c, a in zip(place, "ijk")], *[F.col("p")[k + 1].cast("double").alias(f"d{a}") for k, a in enumerate("xyz")])
    return {"linear": linear, "origin": after("origin")[0], "spacing": after("spacing")[0], "dims": dims}, nodes


def read_matrix_transform(spark: SparkSession, path: str) -> list[list[float]]:
    """A transformation of three or four text lines of four numbers."""
    rows = lines(spark, path).where("trim(line) <> ''").orderBy("n").limit(3).collect()
    return [[float(v) for v in r["line"].split()] for r in rows]


# --- a sink of whole files ------------------------------------------------------------------------------------------


class WholeFiles(DataSource):
    """Rows (name, content) as one file each under a folder that all executors share; a row that is written again replaces its file."""

    @classmethod
    def name(cls) -> str:
        return "whole_files"

    def schema(self) -> str:
        return "name string, content binary"

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _FileWriter(self.options["path"])


class _FileWriter(DataSourceWriter):
    def __init__(self, path: str) -> None:
        self.path = path

    def write(self, rows) -> WriterCommitMessage:
        fs, base = pafs.FileSystem.from_uri(self.path)
        fs.create_dir(base, recursive=True)
        for r in rows:
            part = f"{base}/.{uuid.uuid4().hex}"
            with fs.open_output_stream(part) as f:
                f.write(r["content"])
            fs.move(part, f"{base}/{r['name']}")
        return WriterCommitMessage()


def nifti_files(images: DataFrame, spacing: tuple[float, ...] = (1.0, 1.0, 1.0, 1.0), compress: bool = True) -> DataFrame:
    """name, content: a NIfTI-1 file of each image of (name, i, j, k, t, v), 0 where a voxel is missing. One image is one group, as its file is."""

    def make(table: pa.Table) -> pa.Table:
        at = [table.column(c).to_numpy() for c in "ijkt"]
        a = np.zeros([int(x.max()) + 1 for x in at], np.float32)
        a[tuple(at)] = table.column("v").to_numpy()
        data = nifti_bytes(a, spacing)
        return pa.table({"name": [table.column("name")[0].as_py()], "content": pa.array([gzip.compress(data) if compress else data], pa.binary())})

    return images.select("name", "i", "j", "k", "t", "v").groupBy("name").applyInArrow(make, "name string, content binary")


def write_files(files: DataFrame, path: str) -> None:
    files.sparkSession.dataSource.register(WholeFiles)
    files.select("name", "content").write.format("whole_files").mode("append").save(path)


def write_nifti(images: DataFrame, path: str, spacing: tuple[float, ...] = (1.0, 1.0, 1.0, 1.0), compress: bool = True) -> None:
    """images(name, i, j, k, t, v) as NIfTI-1 files under path."""
    write_files(nifti_files(images, spacing, compress), path)


def frame_names(images: DataFrame, prefix: str) -> DataFrame:
    """(name, i, j, k, t, v) with each frame as an image of its own, named prefix_<frame from 1>.nii.gz: what write_nifti() writes as a file a frame."""
    return images.select(F.concat(F.lit(f"{prefix}_"), (F.col("t") + 1).cast("string"), F.lit(".nii.gz")).alias("name"), "i", "j", "k", F.lit(0).alias("t"), "v")
