"""Numpy views of Arrow text inside tasks: chunks of whole documents, words and their hashes, all without a loop over bytes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
ODD = 0x9E3779B97F4A7C15
ASCII_LOWER = np.arange(256, dtype=np.uint8)
ASCII_LOWER[65:91] += 32
#: True for bytes of a word when words are split at \x20 and \x09-\x0D.
BLACK = np.ones(256, bool)
BLACK[[0x20, *range(0x09, 0x0E)]] = False


def chunks(batch: pa.RecordBatch, column: str = "text", most: int = 1 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, offsets from 0, bytes) of runs of whole texts of about `most` bytes; null is empty. A longer text is a chunk of its own."""
    texts = batch.column(batch.schema.get_field_index(column)).cast(pa.large_binary()).fill_null(b"")
    if not len(texts):
        return
    _, offs, data = texts.buffers()
    offs = np.frombuffer(offs, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    i = 0
    while i < len(texts):
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + most, "right")) - 1)
        yield i, j, offs[i : j + 1] - offs[i], data[offs[i] : offs[j]]
        i = j


def words(buf: np.ndarray, offs: np.ndarray, inside: np.ndarray = BLACK) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of words (never across documents), and for each document the index of its first word, plus the total."""
    mark = np.zeros(len(buf) + 1, bool)
    mark[:-1] = inside[buf]
    edge = np.zeros(len(buf) + 1, bool)
    edge[offs] = True
    before = np.zeros(len(buf) + 1, bool)
    before[1:] = mark[:-1]
    starts = np.flatnonzero(mark & (~before | edge))
    ends = np.flatnonzero(before & (~mark | edge))
    return starts, ends, np.searchsorted(starts, offs)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


class Hasher:
    """Hashes of any byte ranges of a buffer from one running sum of byte * ODD**position modulo 2**64."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, U)

    def _grow(self, n: int) -> None:
        if len(self.up) < n:
            n = max(n, 1 << 20)
            steps = np.full(n, ODD, U)
            steps[0] = 1
            self.up = np.cumprod(steps)
            steps[1:] = pow(ODD, -1, 1 << 64)
            self.down = np.cumprod(steps)

    def load(self, buf: np.ndarray) -> None:
        self._grow(len(buf) + 1)
        self.sums = np.zeros(len(buf) + 1, U)
        np.cumsum((buf.astype(U) + U(1)) * self.up[: len(buf)], out=self.sums[1:])

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix((self.sums[ends] - self.sums[starts]) * self.down[starts] + (ends - starts).astype(U) * U(0xD6E8FEB86659FD93))
