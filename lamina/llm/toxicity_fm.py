"""Toxicity by a factorization machine over hashed terms.

Terms are the words of a text and their beginnings of 4, 5 and 6 bytes, as 64-bit hashes. From labelled texts the
terms that tell the classes apart best are chosen (G-squared over document counts); a second-order factorization
machine on their presence learns a weight for each term and, through inner products of factors, one for each pair,
such as an insult next to a mention of a group. Scoring is a table look-up per term inside tasks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow_text import ASCII_LOWER, Hasher, U, chunks, words
from .common import keep

#: Bytes of words: letters a-z and all bytes of other letters.
LETTER = np.zeros(256, bool)
LETTER[97:123] = True
LETTER[128:] = True
STEMS = (4, 5, 6)


def terms(buf: np.ndarray, offs: np.ndarray, hasher: Hasher) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all terms of a chunk, and the document of each."""
    low = ASCII_LOWER[buf]
    starts, ends, first = words(low, offs, LETTER)
    hasher.load(low)
    doc = np.repeat(np.arange(len(offs) - 1), np.diff(first))
    h, who = [hasher.of(starts, ends)], [doc]
    for k in STEMS:
        long = ends - starts > k
        h.append(hasher.of(starts[long], starts[long] + k) ^ U(0xA0761D6478BD642F))
        who.append(doc[long])
    return np.concatenate(h), np.concatenate(who)


def unique_terms(buf: np.ndarray, offs: np.ndarray, hasher: Hasher) -> list[np.ndarray]:
    h, who = terms(buf, offs, hasher)
    order = np.argsort(who, kind="stable")
    cut = np.searchsorted(who[order], np.arange(len(offs)))
    return [np.unique(h[order[a:b]]) for a, b in zip(cut[:-1], cut[1:])]


@dataclass
class Machine:
    """bias + sum w + sum over pairs of <v, v'> over the known terms present in a text."""

    known: np.ndarray  # sorted hashes
    bias: float
    w: np.ndarray
    v: np.ndarray

    def __post_init__(self) -> None:
        self.sieve = np.zeros(1 << 22, bool)
        self.sieve[(self.known >> U(42)).astype(np.int64)] = True

    def present(self, h: np.ndarray, who: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Indexes of known terms and their documents, each pair once, ordered by document."""
        maybe = self.sieve[(h >> U(42)).astype(np.int64)]
        h, who = h[maybe], who[maybe]
        if not len(self.known):
            return np.empty(0, np.int64), np.empty(0, np.int64)
        at = np.minimum(np.searchsorted(self.known, h), len(self.known) - 1)
        ok = self.known[at] == h
        both = np.unique(who[ok].astype(np.int64) * len(self.known) + at[ok])
        return both % len(self.known), both // len(self.known)

    def margin(self, term: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
        out = np.full(n, self.bias)
        np.add.at(out, doc, self.w[term])
        total = np.zeros((n, self.v.shape[1]))
        np.add.at(total, doc, self.v[term])
        square = np.zeros(n)
        np.add.at(square, doc, (self.v[term] ** 2).sum(1))
        return out + 0.5 * ((total**2).sum(1) - square)

    def score(self, buf: np.ndarray, offs: np.ndarray, hasher: Hasher) -> np.ndarray:
        term, doc = self.present(*terms(buf, offs, hasher))
        return 1 / (1 + np.exp(-np.clip(self.margin(term, doc, len(offs) - 1), -500, 500)))


def train_machine(known: np.ndarray, term: np.ndarray, doc: np.ndarray, y: np.ndarray, factors: int = 8, epochs: int = 60, rate: float = 0.1, l2: float = 1e-4, seed: int = 7) -> Machine:
    """AdaGrad on the logistic loss; each class weighs half. term[i] is present in document doc[i] (ordered by doc)."""
    rng = np.random.default_rng(seed)
    m = Machine(known, 0.0, np.zeros(len(known)), rng.normal(0, 0.01, (len(known), factors)))
    weight = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum())) * len(y)
    gw, gv, gb = np.full(len(known), 1e-6), np.full((len(known), factors), 1e-6), 1e-6
    cut = np.searchsorted(doc, np.arange(len(y) + 1))
    for _ in range(epochs):
        order = rng.permutation(len(y))
        for at in range(0, len(y), 256):
            pick = order[at : at + 256]
            n = cut[pick + 1] - cut[pick]
            t = term[np.repeat(cut[pick] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())]
            d = np.repeat(np.arange(len(pick)), n)
            z = m.margin(t, d, len(pick))
            g = (1 / (1 + np.exp(-np.clip(z, -50, 50))) - y[pick]) * weight[pick] / len(pick)
            total = np.zeros((len(pick), factors))
            np.add.at(total, d, m.v[t])
            dw = np.bincount(t, g[d], len(known)).astype(float)
            dv = np.zeros_like(m.v)
            np.add.at(dv, t, g[d][:, None] * (total[d] - m.v[t]))
            hit = np.bincount(t, minlength=len(known)) > 0
            dw[hit] += l2 * m.w[hit]
            dv[hit] += l2 * m.v[hit]
            gw += dw**2
            gv += dv**2
            gb += g.sum() ** 2
            m.w -= rate * dw / np.sqrt(gw)
            m.v -= rate * dv / np.sqrt(gv)
            m.bias -= rate * g.sum() / np.sqrt(gb)
    return m


def fit(docs: DataFrame, labels: DataFrame, per_class: int = 3000, n_terms: int = 4096, least: int = 4) -> Machine:
    """A machine from docs(doc_id, text) and labels(doc_id, toxic).

    Bound of the sample: per_class documents of each class, those first by crc32 of the id; ids are chosen before texts
    are read. Chosen are the n_terms terms of highest G-squared among those in `least` texts of the sample or more. Without
    both classes the machine knows no term and scores 0. An id labelled twice takes the larger label; of rows that share
    an id one is read.
    """
    known = labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("y"))
    ids = docs.select("doc_id").join(known.hint("merge"), "doc_id").distinct()
    order = [F.crc32(F.col("doc_id").cast("string").cast("binary")), F.col("doc_id")]
    parts = [ids.where(F.col("y") == y).orderBy(*order).limit(per_class) for y in (0, 1)]
    chosen = keep(parts[0].unionByName(parts[1]))
    sample = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").dropDuplicates(["doc_id"])  # 2 * per_class ids
    sample = sample.select("y", "text").toArrow()
    y = sample.column("y").to_numpy().astype(np.int64)
    if y.sum() in (0, len(y)):
        return Machine(np.empty(0, U), -20.0, np.zeros(0), np.zeros((0, 1)))
    hasher, sets = Hasher(), []
    with np.errstate(over="ignore"):
        for batch in sample.to_batches():
            for _, _, offs, buf in chunks(batch):
                sets += unique_terms(buf, offs, hasher)
    slots = U((1 << 22) - 1)
    often = np.zeros(1 << 22, np.uint16)  # never less than a term's own count: rare terms go before any is sorted
    for x in sets:
        np.add.at(often, (x & slots).astype(np.int64), np.uint16(1))
    sets = [x[often[(x & slots).astype(np.int64)] >= least] for x in sets]
    del sample, often
    h, who = np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    u, at = np.unique(h, return_inverse=True)
    has = np.stack([np.bincount(at[y[who] == k], minlength=len(u)) for k in (0, 1)]).astype(float)
    n = np.array([(y == 0).sum(), y.sum()], float)[:, None]
    cells = np.stack([has, n - has])
    expect = cells.sum(1, keepdims=True) * n[None] / n.sum()
    g2 = 2 * np.where(cells > 0, cells * np.log(np.maximum(cells, 1e-12) / np.maximum(expect, 1e-12)), 0).sum((0, 1))
    g2[has.sum(0) < least] = 0
    best = np.argsort(-g2, kind="stable")[:n_terms]
    best = np.sort(best[g2[best] > 16])  # chance gives this once in 16,000 terms
    place = np.full(len(u), -1)
    place[best] = np.arange(len(best))
    ok = place[at] >= 0
    return train_machine(u[best], place[at[ok]], who[ok], y)


def score(docs: DataFrame, machine: Machine, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score (0..1) of every row over its whole text; null text scores as empty. Repeated rows come back repeated."""
    model = docs.sparkSession.sparkContext.broadcast(machine)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        with np.errstate(over="ignore"):
            for batch in batches:
                for i, j, offs, buf in chunks(batch):
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(model.value.score(buf, offs, hasher))], ["doc_id", "score"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, score double")


def drop_toxic(docs: DataFrame, machine: Machine, least: float = 0.7) -> DataFrame:
    """The rows of docs whose text scores below `least`, with all their columns, in one pass and without a join."""
    model = docs.sparkSession.sparkContext.broadcast(machine)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        with np.errstate(over="ignore"):
            for batch in batches:
                for i, j, offs, buf in chunks(batch):
                    yield batch.slice(i, j - i).filter(pa.array(model.value.score(buf, offs, hasher) < least))

    return docs.mapInArrow(run, docs.schema)
