"""Language-model scoring by logistic context mixing over bits, next to a unigram base.

A text (A-Z lower-cased) is a sequence of bytes and an end mark. After the two bytes before it, each byte has a rank
(how often it follows them in training); the rank is a path of binary decisions in a code tree, so likely bytes cost few
decisions. Hashed contexts (four and six bytes back, and the word so far) each predict every decision from counts
over all training texts. Predictions are mixed in the logistic domain with weights gated by the tree node and by how
often the word so far was seen; while a text is read, each block of decisions refines the weights online for the blocks
after it. The sum of -log2 p over a text is its total of bits.

Counts of contexts are arrays of a fixed size, added up by Spark. Base counts grow with the corpus: texts are read in
blocks of whole texts, each with a dictionary of its distinct words; dictionaries meet in buckets, where words are
compared byte by byte, and each bucket answers a block in one row. A word found everywhere costs one entry a block.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .arrow_text import ASCII_LOWER, BLACK, U, chunks, mix, words
from .common import keep

END = 255  # no byte of UTF-8: the end mark, and what stands before a text
PAD = 6
INPUTS = 3
BITS = (22, 22, 22)  # of each input's table
LEVELS = np.array([1, 3, 12])  # of how often the word so far was seen: with the tree node, they select the weights
UNIT = 16  # steps of a log odd in the tables
BLOCK = 1024
RATE = 0.02
SEGMENT = 1 << 18  # bytes of text whose decisions are held at once; a longer text is read in segments
RANKED = 16_384  # pairs of bytes with ranks of their own; after others, bytes have the ranks that the last byte gives
M = np.uint32
#: Counts as bytes: exact below 128, then in steps of 13 %.
COUNTS = np.concatenate([np.arange(128), np.rint(128 * 2 ** (np.arange(1, 129) / 5.5))]).astype(np.int32)
PAIRS = COUNTS[np.indices((256, 256))[::-1]].transpose(1, 2, 0).astype(np.float32).reshape(-1).view(np.complex64)  # zeros and ones by their two bytes
BINS = np.searchsorted([-64, -32, -12, 0, 12, 32, 64], np.arange(256).astype(np.uint8).view(np.int8), "right")  # of log odds in UNITs, by their byte
CELLS = 8**INPUTS  # of each gate
SEEN = np.searchsorted(LEVELS, np.arange(LEVELS[-1] + 1), "right").astype(np.uint8)  # level of a count up to the last of LEVELS
GROUP = 1 << 14  # decisions that are worked on at once: what stays in a core's cache


# --- symbols, contexts and decisions ---------------------------------------------------------------------------------


def lay(buf: np.ndarray, offs: np.ndarray, before: np.ndarray | None = None, end: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased texts, PAD marks before and one after each; the places of what is coded, and its offsets by text. before: bytes that stand before a single text."""
    n = np.diff(offs)
    step = n + PAD + end
    start = np.cumsum(step) - step
    out = np.full(int(step.sum()), END, np.uint8)
    coded = np.ones(len(out), bool)
    for k in range(PAD):
        coded[start + k] = False
    body = coded
    if end:
        body = coded.copy()
        body[start + PAD + n] = False
    out[body] = ASCII_LOWER[buf]
    if before is not None:
        out[PAD - len(before) : PAD] = ASCII_LOWER[before]
    return out, np.flatnonzero(coded), offs + np.arange(len(offs)) * end


def segments(batch: pa.RecordBatch, most: int) -> Iterator[tuple[int, int, bool, tuple[np.ndarray, np.ndarray, np.ndarray]]]:
    """(first row, end row, whether they begin here, laid-out symbols) of runs of whole texts of about `most` bytes, or of one longer text's next SEGMENT bytes."""
    for i, j, offs, buf in chunks(batch, most=most):
        if j > i + 1 or len(buf) <= SEGMENT:
            yield i, j, True, lay(buf, offs)
            continue
        for a in range(0, len(buf), SEGMENT):
            part = buf[a : a + SEGMENT]
            yield i, j, a == 0, lay(part, np.array([0, len(part)]), buf[max(0, a - PAD) : a], a + SEGMENT >= len(buf))


def keep_freed() -> None:
    """Frees 24 MB: from then on glibc keeps freed arrays of up to that size for the next ones, which else cost page faults again and again."""
    np.empty(3 << 20)


def pairs(s: np.ndarray) -> np.ndarray:
    """The byte before each place (low) and the one before that."""
    out = np.full(len(s), END | END << 8, np.uint16)
    out[1:] = s[:-1] | (out[1:] & M(0xFF00).astype(np.uint16))
    out[2:] = s[1:-1] | (s[:-2].astype(np.uint16) << np.uint16(8))
    return out


def contexts(s: np.ndarray) -> list[np.ndarray]:
    """32-bit hashes of each place's contexts: four and six bytes back, and the word so far (from its start in s)."""
    two = np.full(len(s) + 4, END | END << 8, M)
    two[4:] = pairs(s)
    c4 = two[4:] | two[2:-2] << M(16)
    c6 = c4 * M(0x9E3779B1) ^ two[:-4] * M(0x85EBCA6B)
    inside = BLACK[s] & (s != END)
    new = np.ones(len(s), bool)
    np.logical_not(inside[:-1], out=new[1:])
    start = np.flatnonzero(new)
    up, down = powers(1 << int(len(s)).bit_length())
    sums = np.zeros(len(s) + 1, M)
    np.cumsum((s + M(1)) * up[: len(s)], dtype=M, out=sums[1:])
    n = np.diff(start, append=len(s))
    word = (sums[:-1] - np.repeat(sums[start], n)) * np.repeat(down[start], n)
    out = []
    for k, x in enumerate((c4, c6, word)):
        x = (x + M(k + 1)) * M(0x85EBCA6B)
        x ^= x >> M(15)
        out.append(x * M(0x2C1B3C6D))
    return out


@lru_cache(1)
def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Of an odd number and of its inverse, modulo 2**32."""
    odd = np.full((2, n), 0x9E3779B1, M)
    odd[1] = pow(0x9E3779B1, -1, 1 << 32)
    odd[:, 0] = 1
    return tuple(np.cumprod(odd, axis=1, dtype=M))


class Code:
    """Ranks of bytes after each pair of bytes, and a Huffman tree over ranks whose nodes are numbered from the root down."""

    def __init__(self, pair: np.ndarray, symbol: np.ndarray, n: np.ndarray, ranked: int = RANKED, least: int = 32) -> None:
        """From counts n of symbols after pairs; a pair seen `least` times, up to `ranked` of them, has ranks of its own."""
        one, all_ = np.zeros((256, 256)), np.zeros(256)
        np.add.at(one, (pair & 255, symbol), n)
        np.add.at(all_, symbol, n)
        seen, at = np.unique(pair, return_inverse=True)
        total = np.bincount(at, n, len(seen)) if len(seen) else np.zeros(0)
        own = np.sort(np.argsort(-total, kind="stable")[:ranked])
        own = own[total[own] >= least]
        two = np.zeros((len(own), 256))
        where = np.full(len(seen), -1)
        where[own] = np.arange(len(own))
        ok = where[at] >= 0
        np.add.at(two, (where[at[ok]], symbol[ok]), n[ok])
        after_one = one + all_ / (all_.sum() + 1)
        self.row = (np.arange(1 << 16) & 255).astype(np.int32)
        self.row[seen[own]] = 256 + np.arange(len(own))
        self.rank = np.concatenate([ranks(after_one), ranks(two + (after_one / after_one.sum(1, keepdims=True).clip(1e-9))[seen[own] & 255])])
        often = np.bincount(self.rank[self.row[pair], symbol], n, 256) if len(n) else np.zeros(256)
        heap = [(int(c) + 1, i, i) for i, c in enumerate(often)]
        heapq.heapify(heap)
        kids: dict[int, tuple[int, int]] = {}
        for name in range(256, 511):
            (c0, _, a), (c1, _, b) = heapq.heappop(heap), heapq.heappop(heap)
            kids[name] = (a, b)
            heapq.heappush(heap, (c0 + c1, name, name))
        number, level, paths = {}, [(510, [])], {}
        while level:
            below = []
            for x, path in level:
                if x < 256:
                    paths[x] = path
                else:
                    number[x] = len(number)
                    below += [(kids[x][b], [*path, (number[x], b)]) for b in (0, 1)]
            level = below
        self.length = np.array([len(paths[i]) for i in range(256)], np.int64)
        self.first = np.concatenate([[0], np.cumsum(self.length)[:-1]])
        flat = [d for i in range(256) for d in paths[i]]
        self.node = np.array([x for x, _ in flat] + [0] * BLOCK, np.uint8)  # filled up for the padding of blocks
        self.bit = np.array([b for _, b in flat] + [0] * BLOCK, np.uint8)

    def ranks_of(self, s: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Rank of each coded symbol; its decisions are length[rank] entries of node and bit from first[rank]."""
        return self.rank[self.row[pairs(s)[at]], s[at]]


def ranks(weight: np.ndarray) -> np.ndarray:
    """Rank of each column by weight in each row; equal weights by column."""
    order = np.argsort(-weight, axis=1, kind="stable")
    out = np.empty_like(order)
    np.put_along_axis(out, order, np.broadcast_to(np.arange(256), order.shape), 1)
    return out.astype(np.uint8)


def run_of(n: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Indexes first, first + 1, ... for n of each symbol, one after the other."""
    return np.arange(n.sum()) + np.repeat(first - (np.cumsum(n) - n), n)


# --- the mixer -------------------------------------------------------------------------------------------------------


@dataclass
class Mixer:
    code: Code
    bits: tuple[int, ...]
    odds: list[np.ndarray]  # by input: log odds of each slot in UNITs
    level: np.ndarray  # of each slot of the last input
    weight: np.ndarray  # (node * 4 + level, input)

    def inputs(self, ctx: list[np.ndarray], n: np.ndarray, node: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Log odds by input, and the gate of each decision; n decisions for each place of ctx."""
        x = np.empty((INPUTS, len(node)), np.float32)
        for k in range(INPUTS):
            at = np.repeat((ctx[k] >> M(32 - self.bits[k])).astype(np.int64), n)
            at ^= node
            np.multiply(np.take(self.odds[k], at), np.float32(1 / UNIT), out=x[k], dtype=np.float32)
        return x, node * 4 + np.take(self.level, at)

    def log2_loss(self, s: np.ndarray, at: np.ndarray, offs: np.ndarray, delta: np.ndarray) -> np.ndarray:
        """Bits of each text. Texts go side by side, a block of decisions at a time; delta, by text, is refined in place."""
        rank = self.code.ranks_of(s, at)
        n, first = self.code.length[rank], self.code.first[rank]
        count = np.add.reduceat(n, offs[:-1])
        blocks = -(-count // BLOCK)
        top = np.concatenate([[0], np.cumsum(blocks)])
        n[offs[1:] - 1] += blocks * BLOCK - count  # padding belongs to each text's last symbol
        ctx, end = [c[at] for c in contexts(s)], np.cumsum(n)
        x, z0, sign = np.empty((INPUTS, end[-1]), np.float32), np.empty(end[-1], np.float32), np.empty(end[-1], np.float32)
        cut = np.unique([0, *np.searchsorted(end, np.arange(GROUP, end[-1], GROUP)), len(n)]).tolist()
        for i, j in zip(cut[:-1], cut[1:]):
            sym, dec = slice(i, j), slice(end[i] - n[i], end[j - 1])
            step = run_of(n[sym], first[sym])
            node = self.code.node[step].astype(np.int64)
            np.multiply(self.code.bit[step], np.float32(2), out=sign[dec])
            x[:, dec], gate = self.inputs([c[sym] for c in ctx], n[sym], node)
            z0[dec] = 0
            for k in range(INPUTS):
                z0[dec] += np.take(self.column[k], gate) * x[k, dec]
        sign -= 1
        for a, b in zip((top[:-1] * BLOCK + count).tolist(), (top[1:] * BLOCK).tolist()):
            sign[a:b] = 0
        x = np.ascontiguousarray(x.reshape(INPUTS, -1, BLOCK).transpose(1, 0, 2))
        z0, sign = z0.reshape(-1, BLOCK), sign.reshape(-1, BLOCK)
        loss, rate = np.zeros(len(count)), np.float32(RATE / np.sqrt(BLOCK))
        order = np.argsort(-blocks, kind="stable")
        steps = blocks[order]
        for b in range(int(steps[0])):
            who = order[: np.searchsorted(-steps, -b)]
            rows = top[who] + b
            y, xs, own = sign[rows], x[rows], delta[who]
            z = np.matmul(own[:, None], xs)[:, 0]
            z += z0[rows]
            z *= y
            np.maximum(z, -30, out=z)
            e = np.exp(-z)
            e1 = e + 1
            loss[who] += (np.log(e1) * (y != 0)).sum(1)
            e /= e1
            e *= y
            own += rate * np.matmul(xs, e[:, :, None])[:, :, 0]
            delta[who] = np.minimum(np.maximum(own, -2), 2)
        return loss / np.log(2)

    def __post_init__(self) -> None:
        self.column = [np.ascontiguousarray(self.weight[:, k]) for k in range(INPUTS)]


def log_odds(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    odds = np.add(ones, 0.3, dtype=np.float32)
    odds /= np.add(zeros, 0.3, dtype=np.float32)
    np.log(odds, out=odds)
    odds *= UNIT
    np.rint(odds, out=odds)
    return np.clip(odds, -127, 127, out=odds).astype(np.int8)


def levels(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    return SEEN.take(np.minimum(zeros + ones, LEVELS[-1]).astype(np.int64))


def survey(train: DataFrame) -> tuple[Code, int]:
    """The code and the bytes of train(text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_freed()
        total = np.zeros((2, 0), np.int64)
        for batch in batches:
            for i, j, begin, (s, at, offs) in segments(batch, SEGMENT * 8):
                code, n = runs(pairs(s)[at].astype(np.uint32) << M(8) | s[at])
                u, where = np.unique(np.concatenate([total[0], code]), return_inverse=True)
                total = np.stack([u, np.bincount(where, np.concatenate([total[1], n]), len(u)).astype(np.int64)])
        part = total[0] >> 16
        cut = np.searchsorted(part, np.arange(257))
        rows = [(int(p), total[0, cut[p] : cut[p + 1]].tobytes(), total[1, cut[p] : cut[p + 1]].tobytes()) for p in np.flatnonzero(np.diff(cut))]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows) if rows else ([],) * 3, (pa.int32(), pa.binary(), pa.binary()))], ["part", "key", "n"])

    def add(table: pa.Table) -> pa.Table:
        key, n = (np.concatenate([np.frombuffer(x, np.int64) for x in table.column(c).to_pylist()]) for c in ("key", "n"))
        u, at = np.unique(key, return_inverse=True)
        return pa.table({"key": pa.array([u.tobytes()], pa.binary()), "n": pa.array([np.bincount(at, n, len(u)).astype(np.int64).tobytes()], pa.binary())})

    found = train.select("text").mapInArrow(run, "part int, key binary, n binary")
    rows = found.groupBy("part").applyInArrow(add, "key binary, n binary").collect()  # at most 256 rows, 2**24 counts
    key, n = (np.concatenate([np.frombuffer(r[c], np.int64) for r in rows] or [np.zeros(0, np.int64)]) for c in ("key", "n"))
    return Code(key >> 8, key & 255, n), int(n.sum())


def slot_counts(code: Code, ctx: np.ndarray, rank: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """slot * 2 + bit of decisions in an input's table (of at most 2**24 slots), and how often each comes: symbols are counted first, then their decisions."""
    key, times = runs((ctx >> M(32 - bits)) << M(8) | rank)
    r = key & M(255)
    n = code.length[r]
    step = run_of(n, code.first[r])
    return (np.repeat((key >> M(8)).astype(np.int64), n) ^ code.node[step]) * 2 + code.bit[step], np.repeat(times, n)


def runs(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, sorted, and their counts."""
    keys = np.sort(keys)
    begin = np.concatenate([np.zeros(min(1, len(keys)), np.int64), np.flatnonzero(keys[1:] != keys[:-1]) + 1])
    return keys[begin], np.diff(begin, append=len(keys)).astype(np.uint32)


def add_counts(total: list[np.ndarray], code: Code, bits: tuple[int, ...], s: np.ndarray, at: np.ndarray) -> None:
    rank = code.ranks_of(s, at)
    for k, ctx in enumerate(contexts(s)):
        np.add.at(total[k], *slot_counts(code, ctx[at], rank, bits[k]))


def count_contexts(train: DataFrame, code, bits: tuple[int, ...]) -> tuple[list, list, list]:
    """By input, log odds, levels, and counts as places in COUNTS (of slot * 2 + bit), from all training texts."""
    width, pieces = [2 << b for b in bits], 128

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_freed()
        total = [np.zeros(w, np.uint32) for w in width]
        for batch in batches:
            for _, _, _, (s, at, _) in segments(batch, SEGMENT * 4):
                add_counts(total, code.value, bits, s, at)
        rows = [(k * pieces + p, part.tobytes()) for k in range(INPUTS) for p, part in enumerate(np.split(total[k], pieces))]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], ["piece", "n"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:  # a row for each task that counts
            k, p = divmod(batch.column("piece")[0].as_py(), pieces)
            total = np.zeros(width[k] // pieces) if total is None else total
            for x in batch.column("n"):
                total += np.frombuffer(x.as_buffer(), np.uint32)
        packed = np.searchsorted((COUNTS[1:] + COUNTS[:-1].astype(np.int64)) / 2, total, "right").astype(np.uint8)
        parts = {"odds": log_odds(total[::2], total[1::2]), "level": levels(total[::2], total[1::2]), "packed": packed}
        yield pa.RecordBatch.from_pydict({"piece": pa.array([k * pieces + p], pa.int32()), **{c: pa.array([v.tobytes()], pa.binary()) for c, v in parts.items()}})

    # Each task sends whole tables, so tasks are as many as the cluster's cores ask for, not as many as the input's splits.
    few = train.select("text").coalesce(2 * train.sparkSession.sparkContext.defaultParallelism)
    sent = few.mapInArrow(run, "piece int, n binary").groupBy("piece")
    rows = {r["piece"]: r for r in sent.applyInArrow(add, "piece int, odds binary, level binary, packed binary").collect()}
    out = []
    for c, kind in (("odds", np.int8), ("level", np.uint8), ("packed", np.uint8)):
        out.append([np.concatenate([np.frombuffer(rows[k * pieces + p][c], kind) for p in range(pieces)]) for k in range(INPUTS)])
    return tuple(out)


def fit_mixer(docs: DataFrame, bits: tuple[int, ...] = BITS, steps: int = 50, at_once: int = SEGMENT // 4) -> tuple[Mixer, int]:
    """Counts and gated weights from all training texts of docs(text, train), and their bytes. Weights take `steps` Newton steps at most; texts are read `at_once` bytes at a time."""
    train = docs.where("train")
    code, size = survey(train)
    gates = np.full((256 * 4, INPUTS), 0.3, np.float32)
    if not size:
        return Mixer(code, bits, [np.zeros(1 << b, np.int8) for b in bits], np.zeros(1 << bits[-1], np.uint8), gates), 0
    sent = docs.sparkSession.sparkContext.broadcast(code)
    odds, level, packed = count_contexts(train, sent, bits)
    return Mixer(code, bits, odds, level[-1], gate_weights(train, sent, bits, packed, gates, steps, at_once)), size


def seen_by_others(code: Code, bits: tuple[int, ...], counts: list[np.ndarray], s: np.ndarray, at: np.ndarray, offs: np.ndarray, own: list[np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Log odds (in UNITs) by input, gate and bit of each decision of laid-out texts, by counts (of slot * 2 + bit, or their places in COUNTS) without the text's own.

    own: the counts of the one text that these symbols are a segment of; without it, the texts are whole. A complex number holds zeros and ones.
    """
    rank = code.ranks_of(s, at)
    n, first = code.length[rank], code.first[rank]
    slots = [(ctx[at] >> M(32 - b)).astype(np.int64) for ctx, b in zip(contexts(s), bits)]
    cut = np.concatenate([[0], np.cumsum(n)])[offs]
    x, gate, bit = np.empty((INPUTS, cut[-1]), np.int8), np.empty(cut[-1], np.int64), np.empty(cut[-1], np.uint8)
    tables = [v.view("<u2") if v.dtype == np.uint8 else v.astype(np.float32).view(np.complex64) for v in counts]
    owner, i = np.empty(0, np.int32), 0
    while i < len(cut) - 1:
        j = max(i + 1, int(np.searchsorted(cut, cut[i] + GROUP, "right")) - 1)
        sym, dec = slice(offs[i], offs[j]), slice(cut[i], cut[j])
        step = run_of(n[sym], first[sym])
        node, bit[dec] = code.node.take(step), code.bit.take(step)
        y, one = bit[dec].astype(np.int64), np.ones(len(step), np.float32)
        text = np.repeat(np.arange(j - i), np.diff(cut[i : j + 1]))
        mixed, text = text * 0x9E3779B1, text << 24
        size = 1 << int(len(step)).bit_length() + 2
        owner = owner if len(owner) >= size else np.empty(size, np.int32)
        for k in range(INPUTS):
            slot = np.repeat(slots[k][sym], n[sym])
            slot ^= node
            both = tables[k].take(slot)
            both = (PAIRS.take(both) if both.dtype == np.uint16 else both).view(np.float32)
            if own is None:
                place = same(slot + text, slot + mixed & size - 1, owner)
                less = np.zeros(2 * len(place), np.float32)
                np.add.at(less, 2 * place + y, one)
                both -= less.view(np.complex64).take(place).view(np.float32)
            else:
                both[::2] -= own[k].take(2 * slot)
                both[1::2] -= own[k].take(2 * slot + 1)
            np.maximum(both, 0, out=both)  # counts of 128 and more are not exact
            x[k, dec] = log_odds(both[::2], both[1::2])
        gate[dec] = node * np.int64(4) + levels(both[::2], both[1::2])
        i = j
    return x, gate, bit


def same(key: np.ndarray, low: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """A place in key for each entry, the same for equal keys and for no others. low: hashes of the keys, places in the scratch array owner."""
    owner[low] = np.arange(len(key), dtype=np.int32)
    place = owner.take(low).astype(np.int64)
    lost = np.flatnonzero(key.take(place) != key)  # another key took their place
    if len(lost):
        _, at, back = np.unique(key[lost], return_index=True, return_inverse=True)
        place[lost] = lost[at[back]]
    return place


def gate_weights(train: DataFrame, code, bits: tuple[int, ...], packed: list[np.ndarray], start: np.ndarray, steps: int, at_once: int) -> np.ndarray:
    """Weights of each gate: a logistic regression on all decisions of all training texts, each predicted by the counts of all other texts.

    Tasks add decisions up in cells of log odds within a gate: how many, how many ones, and the sums of each input. Cells
    are whole numbers, so weights do not depend on how rows are split. Each gate's regression is on its cells' means.
    """
    held = train.sparkSession.sparkContext.broadcast(packed)
    pieces, cells = 64, len(start) * CELLS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_freed()
        total = np.zeros((2 + INPUTS, cells), np.int64)
        for batch in batches:
            for i, j, _, buf in chunks(batch, most=at_once):
                texts, own = batch.slice(i, j - i), None
                if j == i + 1 and len(buf) > SEGMENT:
                    own = [np.zeros(2 << b, np.uint32) for b in bits]
                    for *_, (s, at, _) in segments(texts, at_once):
                        add_counts(own, code.value, bits, s, at)
                for *_, laid in segments(texts, at_once):
                    x, gate, bit = seen_by_others(code.value, bits, held.value, *laid, own)
                    for a in range(0, len(bit), GROUP):
                        cell = gate[a : a + GROUP]
                        for v in x[:, a : a + GROUP]:
                            cell *= 8
                            cell += BINS.take(v.view(np.uint8))
                        for k, v in enumerate((np.ones(len(cell)), bit[a : a + GROUP], *x[:, a : a + GROUP])):
                            np.add.at(total[k], cell, v.astype(np.int64))
        for p, part in enumerate(np.split(total, pieces, axis=1)):
            yield pa.RecordBatch.from_arrays([pa.array([p], pa.int32()), pa.array([part.tobytes()], pa.binary())], ["piece", "n"])

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = 0
        for batch in batches:  # a row for each task that adds up
            p = batch.column("piece")[0].as_py()
            for v in batch.column("n"):
                total = total + np.frombuffer(v.as_buffer(), np.int64).reshape(2 + INPUTS, -1, CELLS)
        own = start[p * len(start) // pieces :][: total.shape[1]].astype(float)
        out = [newton(total[0, g], total[1, g], total[2:, g], own[g], steps) for g in range(len(own))]
        yield pa.RecordBatch.from_arrays([pa.array([p], pa.int32()), pa.array([np.array(out, np.float32).tobytes()], pa.binary())], ["piece", "weight"])

    few = train.select("text").coalesce(2 * train.sparkSession.sparkContext.defaultParallelism)  # as in count_contexts
    rows = few.mapInArrow(run, "piece int, n binary").groupBy("piece").applyInArrow(solve, "piece int, weight binary").collect()
    return np.concatenate([np.frombuffer(r["weight"], np.float32) for r in sorted(rows, key=lambda r: r["piece"])]).reshape(start.shape).copy()


def newton(n: np.ndarray, ones: np.ndarray, sums: np.ndarray, start: np.ndarray, steps: int, ridge: float = 4.0) -> np.ndarray:
    """Weights of a logistic regression from n decisions a cell, `ones` of them 1, and sums (input, cell) of log odds in UNITs; `ridge` holds them near start where decisions are few."""
    has = n > 0
    n, ones, x = n[has].astype(float), ones[has].astype(float), sums[:, has] / n[has] / UNIT
    w = start.copy()
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(w @ x, -30, 30)))
        step = np.linalg.solve((x * (n * p * (1 - p))) @ x.T + ridge * np.eye(len(w)), x @ (ones - n * p) - ridge * (w - start))
        w += np.clip(step, -0.5, 0.5)
        if np.abs(step).max() < 1e-6:
            break
    return w


# --- scores by block -------------------------------------------------------------------------------------------------


def word_array(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Words of a buffer as an Arrow array of bytes; starts and ends are those of all its words."""
    mark = np.zeros(len(buf) + 1, np.int8)
    mark[starts] += 1
    mark[ends] -= 1
    inside = np.cumsum(mark[:-1], dtype=np.int8).astype(bool)
    offs = np.concatenate([[0], np.cumsum(ends - starts)])
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offs.astype(np.int64)), pa.py_buffer(buf[inside])])


def word_buckets(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, buckets: int) -> np.ndarray:
    """A bucket of each word by its length and its first and last eight bytes."""
    h = (ends - starts).astype(U)
    for k in range(8):
        for at, inside in ((starts + k, starts + k < ends), (ends - 1 - k, ends - 1 - k >= starts)):
            h = h * U(0x9E3779B97F4A7C15) + np.where(inside, buf[np.where(inside, at, starts)], 0)
    return (mix(h) % U(buckets)).astype(np.int64)


def packed(a: pa.Array) -> tuple[bytes, bytes]:
    """Bytes and lengths of an array of bytes."""
    offs = np.frombuffer(a.buffers()[1], np.int64)[a.offset : a.offset + len(a) + 1]
    data = a.buffers()[2]
    return (data.to_pybytes()[offs[0] : offs[-1]] if data is not None else b""), np.diff(offs).astype(np.uint32).tobytes()


def unpacked(data: list[bytes], lengths: list[bytes]) -> pa.Array:
    n = np.concatenate([np.frombuffer(x, np.uint32) for x in lengths])
    offs = np.concatenate([[0], np.cumsum(n, dtype=np.int64)])
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(n), [None, pa.py_buffer(offs), pa.py_buffer(b"".join(data))])


BLOCKS = "block long, doc_id array<long>, n_bytes binary, bits binary, n_words binary, word binary, cut binary, entry binary, length binary, train binary, texts long"


def score_blocks(docs: DataFrame, model, buckets: int, most: int) -> DataFrame:
    """A row for each block of texts: ids, bytes and bits of its texts, their words as places in its dictionary, and the dictionary in order of buckets with training counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_freed()
        m, names = model.value, TaskContext.get().partitionId() << 32
        for batch in batches:
            doc, train = batch.column(1), np.array(batch.column(2).to_pylist(), bool)
            loss, delta = np.zeros(len(batch)), None
            for i, j, begin, laid in segments(batch, SEGMENT):
                delta = np.zeros((j - i, INPUTS), np.float32) if begin else delta
                loss[i:j] += m.log2_loss(*laid, delta)
            for i, j, offs, buf in chunks(batch, most=most):
                low = ASCII_LOWER[buf]
                starts, ends, first = words(low, offs)
                coded = word_array(low, starts, ends).dictionary_encode()
                at = coded.indices.to_numpy().astype(np.int32)
                place = np.zeros(len(coded.dictionary), np.int64)
                place[at[::-1]] = np.arange(len(at))[::-1]  # where each word stands first
                part = word_buckets(low, starts[place], ends[place], buckets)
                order = np.argsort(part, kind="stable")
                back = np.empty(len(order), np.int32)
                back[order] = np.arange(len(order))
                n = np.diff(first)
                seen = np.bincount(back[at[np.repeat(train[i:j], n)]], minlength=len(order)).astype(np.uint32)
                entry, length = packed(coded.dictionary.take(pa.array(order)))
                cut = np.searchsorted(part[order], np.arange(buckets + 1)).astype(np.int32)
                row = [names, doc.slice(i, j - i).to_pylist(), np.diff(offs).tobytes(), loss[i:j].tobytes(), n.tobytes(), back[at].tobytes(), cut.tobytes(), entry, length, seen.tobytes(), int(train[i:j].sum())]
                names += 1
                kinds = [pa.int64(), pa.list_(pa.int64()), *[pa.binary()] * 8, pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, kinds)], [c.split()[0] for c in BLOCKS.split(", ")])

    return docs.select("text", "doc_id", "train").mapInArrow(run, BLOCKS)


def word_counts(blocks: DataFrame) -> DataFrame:
    """block, bucket, count (packed, in the order of the block's dictionary): training counts of its words of each bucket; tokens and kinds of a bucket stand in one of its rows."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, cut, entry, length, train in zip(*(batch.column(c).to_pylist() for c in range(5))):
                cut, n = np.frombuffer(cut, np.int32), np.frombuffer(length, np.uint32)
                offs = np.concatenate([[0], np.cumsum(n, dtype=np.int64)])
                rows = [(int(b), block, entry[offs[cut[b]] : offs[cut[b + 1]]], length[4 * cut[b] : 4 * cut[b + 1]], train[4 * cut[b] : 4 * cut[b + 1]]) for b in np.flatnonzero(np.diff(cut))]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), (pa.int32(), pa.int64(), *[pa.binary()] * 3))], ["bucket", "block", "entry", "length", "train"])

    def meet(table: pa.Table) -> pa.Table:
        block, entry, length, train = (table.column(c).to_pylist() for c in ("block", "entry", "length", "train"))
        coded = unpacked(entry, length).dictionary_encode()
        at, n = coded.indices.to_numpy(), np.concatenate([np.frombuffer(x, np.uint32) for x in train])
        total = np.bincount(at, n, len(coded.dictionary)).astype(np.int64)
        parts = np.split(total[at], np.cumsum([len(x) // 4 for x in length])[:-1])
        none = [0] * (len(block) - 1)
        return pa.table({"block": block, "bucket": table.column("bucket"), "count": pa.array([x.tobytes() for x in parts], pa.binary()), "tokens": pa.array([int(total.sum()), *none]), "kinds": pa.array([int((total > 0).sum()), *none])})

    sent = blocks.select("block", "cut", "entry", "length", "train").mapInArrow(send, "bucket int, block long, entry binary, length binary, train binary")
    return sent.groupBy("bucket").applyInArrow(meet, "block long, bucket int, count binary, tokens long, kinds long")


def base_scores(blocks: DataFrame, counts: DataFrame) -> DataFrame:
    """doc_id, n_words, n_known, logs (sum of log10(c + 0.1) over words), bits, n_bytes of every text."""

    def finish(texts: pa.Table, found: pa.Table) -> pa.Table:
        out = []
        bucket = found.column("bucket").to_numpy()
        parts = [np.frombuffer(found.column("count")[int(i)].as_py(), np.int64) for i in np.argsort(bucket)]
        c = np.concatenate([*parts, np.zeros(0, np.int64)])
        for r in texts.to_pylist():
            n, at = np.frombuffer(r["n_words"], np.int64), np.frombuffer(r["word"], np.int32)
            who = np.repeat(np.arange(len(n)), n)
            known, logs = np.bincount(who, (c > 0)[at], len(n)).astype(np.int64), np.bincount(who, np.log10(c + 0.1)[at], len(n))
            out.append(pa.table({"doc_id": pa.array(r["doc_id"], pa.int64()), "n_words": n, "n_known": known, "logs": logs, "bits": np.frombuffer(r["bits"], np.float64), "n_bytes": np.frombuffer(r["n_bytes"], np.int64)}))
        return pa.concat_tables(out)

    texts = blocks.select("block", "doc_id", "n_words", "word", "bits", "n_bytes").groupBy("block")
    return texts.cogroup(counts.select("block", "bucket", "count").groupBy("block")).applyInArrow(finish, "doc_id long, n_words long, n_known long, logs double, bits double, n_bytes long")


def score(docs: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text", bits: tuple[int, ...] = BITS, block_bytes: int = 4 << 20, bucket_bytes: int = 24 << 20) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte of every row over its whole text.

    train marks the rows to learn from. score is the mixer's log10 probability of the lower-cased text with its end, base_score
    the unigram's. Null text is empty: its only token is the end. Repeated rows are counted and scored each; a null id stays
    null and is learned from where train is not true for it only if it says so. Without training rows every count is 0. Of
    other columns none is read.
    """
    sc = docs.sparkSession.sparkContext
    d = docs.select(F.col(text_col).alias("text"), F.col(id_col).cast("long").alias("doc_id"), F.coalesce(train, F.lit(False)).alias("train"))
    mixer, size = fit_mixer(d, bits)
    blocks = keep(score_blocks(d, sc.broadcast(mixer), max(8, -(-size // bucket_bytes)), block_bytes))
    counts = keep(word_counts(blocks))
    texts = blocks.agg(F.coalesce(F.sum("texts"), F.lit(0))).first()[0]
    tokens, kinds = counts.agg(F.coalesce(F.sum("tokens"), F.lit(0)), F.coalesce(F.sum("kinds"), F.lit(0))).first()
    tokens, kinds = tokens + texts, kinds + (texts > 0)
    n_tokens = F.col("n_words") + 1
    base = F.col("logs") + F.lit(float(np.log10(texts + 0.1))) - n_tokens * F.lit(float(np.log10(tokens + 0.1 * (kinds + 1))))
    return base_scores(blocks, counts).select(
        "doc_id", n_tokens.alias("n_tokens"), (F.col("n_known") + int(texts > 0)).alias("n_known"), F.lit(tokens).cast("long").alias("train_tokens"), base.alias("base_score"),
        (-F.col("bits") * float(np.log10(2))).alias("score"), (F.col("bits") / (F.col("n_bytes") + 1)).alias("bits_per_byte"),
    )
