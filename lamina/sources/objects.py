"""Objects of several types in JSON: matrices, images, transformations, text, electrode grids and lists of parameters.

An object's fields are a VARIANT; numbers are a payload, deflated and in base64, which tasks decode by Arrow batches. The
reader of a file is chosen by the type that its object names, or by its ending.
"""

from __future__ import annotations

import base64
import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .electrodes import read_electrodes
from .files import nifti_header, read_binary_matrix, read_matr, read_matrix, read_surface
from .images import read_grid_transform, read_nrrd, read_tiff
from .matlab import read_matlab
from .ranges import read_planes

#: Fixed values of the format: the key that names an object's type, the types, and names of number types.
KIND = "bisformat"
MATRIX, IMAGE, LINEAR, GRID, TEXT, ELECTRODES, COLLECTION = "BisMatrix", "BisImage", "BisLinearTransformation", "BisGridTransformation", "BisText", "BisElectrodeMultiGrid", "BisDataObjectCollection"
NUMBERS = {"float": "<f4", "double": "<f8", "short": "<i2", "ushort": "<u2", "int": "<i4", "uint": "<u4", "uchar": "u1", "schar": "i1", "int64": "<i8"}


def pack(data: bytes) -> str:
    return base64.b64encode(zlib.compress(data)).decode()


def unpack(text: str) -> bytes:
    """Of a deflated or gzipped payload."""
    return zlib.decompress(base64.b64decode(text), 47)


def read_objects(spark: SparkSession, path: str) -> DataFrame:
    """file, kind, name, comments (array), body VARIANT of JSON object files; kind is null if a file names no type. Files that are not JSON are an error."""
    t = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.parse_json("value").alias("body"))
    get = lambda p, kind: F.try_variant_get("body", p, kind)
    return t.select("file", get(f"$.{KIND}", "string").alias("kind"), get("$.filename", "string").alias("name"), get("$.comments", "array<string>").alias("comments"), "body")


def matrices(objects: DataFrame) -> DataFrame:
    """file, row, vals of the matrices among objects."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, dims, kind, data in zip(*(batch.column(k).to_pylist() for k in range(4))):
                m = np.frombuffer(unpack(data), NUMBERS[kind or "float"]).reshape(dims).astype(float)
                yield pa.RecordBatch.from_arrays([pa.array([file] * len(m)), pa.array(np.arange(len(m))), pa.array(list(m), pa.list_(pa.float64()))], ["file", "row", "vals"])

    get = lambda p, kind: F.variant_get("body", p, kind)
    rows = objects.where(F.col("kind") == MATRIX).select("file", get("$.dimensions", "array<int>").alias("dims"), F.try_variant_get("body", "$.datatype", "string").alias("type"), get("$.matrix", "string").alias("data"))
    return rows.mapInArrow(run, "file string, row long, vals array<double>")


def images(objects: DataFrame) -> DataFrame:
    """file, t, k, voxel, v of the images among objects (a NIfTI-1 file is their payload), a batch for each plane."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                data = unpack(text)
                h = nifti_header(data)
                n, planes = h["dims"][0] * h["dims"][1], int(np.prod(h["dims"][2:]))
                v = np.frombuffer(data, h["type"], n * planes, h["offset"]).reshape(planes, n).astype(float) * h["slope"] + h["shift"]
                for r in range(planes):
                    t, k = divmod(r, h["dims"][2])
                    yield pa.RecordBatch.from_arrays([pa.array([file] * n), pa.array(np.full(n, t, np.int32)), pa.array(np.full(n, k, np.int32)), pa.array(np.arange(k * n, (k + 1) * n)), pa.array(v[r])], ["file", "t", "k", "voxel", "v"])

    rows = objects.where(F.col("kind") == IMAGE).select("file", F.variant_get("body", "$.data", "string").alias("data"))
    return rows.mapInArrow(run, "file string, t int, k int, voxel long, v double")


def linear_transforms(objects: DataFrame) -> DataFrame:
    """file, m (16 numbers by rows), parameters of the linear transformations among objects."""
    rows = objects.where(F.col("kind") == LINEAR)
    return rows.select("file", F.flatten(F.variant_get("body", "$.matrix", "array<array<double>>")).alias("m"), F.try_variant_get("body", "$.parameters", "array<double>").alias("parameters"))


def grid_transforms(objects: DataFrame) -> DataFrame:
    """file, dims, spacing, origin, node, gi, gj, gk, dx, dy, dz of the grid transformations among objects; displacements are stored axis by axis."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, dims, spacing, origin, text in zip(*(batch.column(k).to_pylist() for k in range(5))):
                a, b, c = dims
                d = np.frombuffer(unpack(text), "<f4").reshape(3, a * b * c).astype(float)
                n = np.arange(a * b * c)
                whole = [pa.array([x] * len(n)) for x in (file, dims, spacing, origin)]
                whole[1] = whole[1].cast(pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([*whole, pa.array(n), *(pa.array(x.astype(np.int32)) for x in (n % a, n // a % b, n // (a * b))), *(pa.array(x) for x in d)], ["file", "dims", "spacing", "origin", "node", "gi", "gj", "gk", "dx", "dy", "dz"])

    get = lambda p, kind: F.variant_get("body", p, kind)
    rows = objects.where(F.col("kind") == GRID).select("file", get("$.dimensions", "array<int>").alias("dims"), get("$.spacing", "array<double>").alias("spacing"), get("$.origin", "array<double>").alias("origin"), get("$.dispfield", "string").alias("data"))
    return rows.mapInArrow(run, "file string, dims array<int>, spacing array<double>, origin array<double>, node long, gi int, gj int, gk int, dx double, dy double, dz double")


def _object(kind: str, name: str, fields: dict) -> str:
    return json.dumps({KIND: kind, "filename": name, "comments": [], **fields})


def matrix_objects(m: DataFrame, kind: str = "float") -> DataFrame:
    """name, value: a JSON object of each matrix of (name, row, vals); a matrix is one group, as its object is."""

    def make(t: pa.Table) -> pa.Table:
        t = t.sort_by("row")
        v = np.array(t.column("vals").to_pylist(), NUMBERS[kind])
        name = t.column("name")[0].as_py()
        return pa.table({"name": [name], "value": [_object(MATRIX, name, {"dimensions": list(v.shape), "datatype": kind, "matrix": pack(v.tobytes())})]})

    return m.select("name", "row", "vals").groupBy("name").applyInArrow(make, "name string, value string")


def image_objects(files: DataFrame) -> DataFrame:
    """name, value: a JSON object of each NIfTI-1 file (name, content), such as nifti_files() makes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                rows.append(_object(IMAGE, name, {"data": pack(zlib.decompress(data, 47) if data[:2] == b"\x1f\x8b" else data)}))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.string())], ["name", "value"])

    return files.select("name", "content").mapInArrow(run, "name string, value string")


def grid_objects(nodes: DataFrame, dims: list[int], spacing: list[float], origin: list[float]) -> DataFrame:
    """name, value: a JSON object of each grid transformation of (name, gi, gj, gk, dx, dy, dz)."""

    def make(t: pa.Table) -> pa.Table:
        at = t.column("gi").to_numpy() + dims[0] * (t.column("gj").to_numpy() + dims[1] * t.column("gk").to_numpy().astype(np.int64))
        d = np.zeros((3, int(np.prod(dims))), "<f4")
        for axis, c in enumerate(("dx", "dy", "dz")):
            d[axis, at] = t.column(c).to_numpy()
        name = t.column("name")[0].as_py()
        return pa.table({"name": [name], "value": [_object(GRID, name, {"dimensions": list(dims), "spacing": list(spacing), "origin": list(origin), "dispfield": pack(d.tobytes()), "linearinterpmode": False})]})

    return nodes.select("name", "gi", "gj", "gk", "dx", "dy", "dz").groupBy("name").applyInArrow(make, "name string, value string")


# --- parameter lists --------------------------------------------------------------------------------------------------


def parameters(text: Column) -> Column:
    """map of name -> array of strings from a JSON object whose values are strings, numbers, booleans or lists of them."""
    raw = F.from_json(text, "map<string, string>")
    return F.transform_values(raw, lambda k, v: F.when(v.startswith("["), F.from_json(v, "array<string>")).otherwise(F.array(v)))


def text_value(p: Column, name: str, default: str) -> Column:
    return F.coalesce(F.get(p[name], F.lit(0)), F.lit(default))


def int_value(p: Column, name: str, default: int, at: int = 0) -> Column:
    """The whole number that a value begins with, 0 if it begins with none; the default if there is no such value."""
    v = F.get(p[name], F.lit(at))
    return F.when(v.isNull(), F.lit(default)).otherwise(F.coalesce(F.regexp_extract(v, r"^\s*([+-]?\d+)", 1).try_cast("int"), F.lit(0)))


def float_value(p: Column, name: str, default: float, at: int = 0) -> Column:
    v = F.get(p[name], F.lit(at))
    return F.when(v.isNull(), F.lit(float(default))).otherwise(F.coalesce(F.regexp_extract(v, r"^\s*([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)", 1).try_cast("double"), F.lit(0.0)))


def bool_value(p: Column, name: str, default: bool) -> Column:
    v = F.get(p[name], F.lit(0))
    return F.when(v.isNull(), F.lit(default)).otherwise(v == "true")


# --- the reader of a file -----------------------------------------------------------------------------------------------

#: Readers by the ending of a file's name.
READERS = {
    ".csv": read_matrix, ".txt": read_matrix, ".matr": read_matr, ".binmatr": read_binary_matrix, ".mat": read_matlab, ".nii": read_planes, ".nii.gz": read_planes, ".nrrd": read_nrrd, ".tif": read_tiff, ".tiff": read_tiff,
    ".ply": read_surface, ".vtk": read_surface, ".grd": read_grid_transform, ".mgrid": read_electrodes,
}
OBJECTS = {MATRIX: matrices, IMAGE: images, LINEAR: linear_transforms, GRID: grid_transforms}


def load(spark: SparkSession, path: str):
    """What a file or pattern holds, by its ending; of JSON objects, by the type that they name: a table (a transformation in text and a surface give what their readers give)."""
    low = path.lower()
    for end in sorted(READERS, key=len, reverse=True):
        if low.endswith(end):
            return READERS[end](spark, path)
    found = read_objects(spark, path)
    kinds = [r["kind"] for r in found.select("kind").distinct().limit(2).collect()]
    return OBJECTS[kinds[0]](found) if len(kinds) == 1 and kinds[0] in OBJECTS else found
