"""Matrices of MATLAB level 5 files (v6 and v7) as a data source: planning walks the tags, tasks read ranges of columns.

A file is a header of 128 bytes and a row of elements, each a tag (type, length) and data padded to eight bytes. An array is
an element of elements: flags, dimensions, name, numbers by columns. Fields of structs and items of cells are arrays within it;
they are named s.field and c{0}. Packed elements (v7) are unpacked by the task that reads them.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .ranges import listed, opened

#: Fixed values of the format: element type -> numpy type; other element types; array classes.
NUMBERS = {1: "i1", 2: "u1", 3: "i2", 4: "u2", 5: "i4", 6: "u4", 7: "f4", 9: "f8", 12: "i8", 13: "u8", 16: "u1"}
ARRAY, PACKED = 14, 15
CELL, STRUCT, NUMERIC = 1, 2, range(6, 16)
CELLS = "file string, name string, row long, col long, v double"


@dataclass
class Piece(InputPartition):
    """Columns first to last of a matrix that starts at offset, or (rows < 0) a whole element to be walked by the task."""

    path: str
    order: str
    offset: int
    length: int
    name: str = ""
    kind: str = ""
    rows: int = -1
    first: int = 0
    last: int = 0


def tag(data: bytes, at: int, order: str) -> tuple[int, int, int, int]:
    """(type, length, place of the data, place of the next element); a short element holds up to four bytes inside its tag."""
    word, length = np.frombuffer(data, f"{order}u4", 2, at).tolist()
    if word >> 16:
        return word & 0xFFFF, word >> 16, at + 4, at + 8
    return word, length, at + 8, at + 8 + (length if word == PACKED else -(-length // 8) * 8)


def array_head(data: bytes, at: int, order: str) -> tuple[int, bool, list[int], str, int]:
    """(class, complex, dimensions, name, place of what follows) of an array's data."""
    _, _, flags, at = tag(data, at, order)
    word = int(np.frombuffer(data, f"{order}u4", 1, flags)[0])
    _, n, dims, at = tag(data, at, order)
    shape = np.frombuffer(data, f"{order}i4", n // 4, dims).tolist()
    _, n, name, at = tag(data, at, order)
    return word & 0xFF, bool(word & 0x800), shape, data[name : name + n].decode("ascii", "replace"), at


def walk(data: bytes, at: int, end: int, order: str, above: str | None = None) -> Iterator[tuple[str, np.ndarray]]:
    """(name, matrix) of every real numeric array in data[at:end], those in structs and cells too; more dimensions are columns."""
    while at + 8 <= end:
        kind, n, body, at = tag(data, at, order)
        if kind == PACKED:
            inner = zlib.decompress(data[body : body + n])
            yield from walk(inner, 0, len(inner), order, above)
        elif kind == ARRAY and n:
            yield from array(data, body, body + n, order, above)


def array(data: bytes, at: int, end: int, order: str, above: str | None) -> Iterator[tuple[str, np.ndarray]]:
    cls, _, shape, own, at = array_head(data, at, order)
    name = own if above is None else above
    if cls in NUMERIC:
        kind, n, body, _ = tag(data, at, order)
        if kind in NUMBERS:
            dtype = order + NUMBERS[kind]
            v = np.frombuffer(data, dtype, n // np.dtype(dtype).itemsize, body)
            yield name, v.reshape(shape[0], -1, order="F") if shape[0] else v.reshape(0, 0)
    elif cls == CELL:
        for k in range(int(np.prod(shape))):
            _, n, body, at = tag(data, at, order)
            if n:
                yield from array(data, body, body + n, order, f"{name}{{{k}}}")
    elif cls == STRUCT:
        _, _, size, at = tag(data, at, order)
        width = int(np.frombuffer(data, f"{order}i4", 1, size)[0])
        _, n, names, at = tag(data, at, order)
        fields = [data[names + k : names + k + width].split(b"\0")[0].decode("ascii", "replace") for k in range(0, n, width)]
        count = int(np.prod(shape))
        for item in range(count):
            for field in fields:
                _, n, body, at = tag(data, at, order)
                if n:
                    yield from array(data, body, body + n, order, f"{name}{f'({item})' if count > 1 else ''}.{field}")


class _Reader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.path, self.most = options["path"], int(options.get("rangebytes", 64 << 20))

    def partitions(self) -> list[Piece]:
        out = []
        for path, size in listed(self.path):
            fs, base = opened(path)
            with fs.open_input_file(base) as f:
                head = f.read_at(128, 0)
                order = {b"IM": "<", b"MI": ">"}.get(head[126:128])
                if order is None:
                    raise ValueError(f"{path} is not a MATLAB level 5 file")
                at = 128
                while at + 8 <= size:
                    start = f.read_at(4096, at)
                    kind, n, body, after = tag(start, 0, order)
                    if kind == ARRAY and n:
                        cls, _, shape, name, inner = array_head(start, body, order)
                        plain = cls in NUMERIC and inner + 8 <= len(start)
                        kind, n, data, _ = tag(start, inner, order) if plain else (0, 0, 0, 0)
                        if kind in NUMBERS and shape[0]:
                            dtype = order + NUMBERS[kind]
                            column = shape[0] * np.dtype(dtype).itemsize
                            cols, each = n // column, max(1, self.most // column)
                            out += [Piece(path, order, at + data, n, name, dtype, shape[0], c, min(c + each, cols)) for c in range(0, cols, each)]
                        else:
                            out.append(Piece(path, order, at, after))
                    elif kind == PACKED:
                        out.append(Piece(path, order, at, after))
                    at += after
        return out

    def read(self, part: Piece) -> Iterator[pa.RecordBatch]:
        fs, base = opened(part.path)
        name = part.path.rsplit("/", 1)[-1]
        with fs.open_input_file(base) as f:
            if part.rows < 0:
                data = f.read_at(part.length, part.offset)
                for own, m in walk(data, 0, len(data), part.order):
                    for c in range(m.shape[1]):
                        yield self.column(name, own, c, m[:, c])
                return
            width = part.rows * np.dtype(part.kind).itemsize
            for c in range(part.first, part.last):
                yield self.column(name, part.name, c, np.frombuffer(f.read_at(width, part.offset + c * width), part.kind))

    @staticmethod
    def column(file: str, name: str, c: int, v: np.ndarray) -> pa.RecordBatch:
        n = len(v)
        return pa.RecordBatch.from_arrays([pa.array([file] * n, pa.string()), pa.array([name] * n, pa.string()), pa.array(np.arange(n)), pa.array(np.full(n, c)), pa.array(v.astype(float))], ["file", "name", "row", "col", "v"])


class MatlabArrays(DataSource):
    @classmethod
    def name(cls) -> str:
        return "matlab_arrays"

    def schema(self) -> str:
        return CELLS

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


def read_matlab(spark: SparkSession, path: str, range_bytes: int = 64 << 20) -> DataFrame:
    """file, name, row, col, v of the real numeric arrays of MATLAB files."""
    spark.dataSource.register(MatlabArrays)
    return spark.read.format("matlab_arrays").option("rangebytes", range_bytes).load(path)
