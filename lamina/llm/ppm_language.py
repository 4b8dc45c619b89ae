"""Language identification by prediction by partial matching over bytes.

For each language a variable-order context tree (up to three preceding bytes) holds counts from all training texts.
The cost of a byte is -log2 of its probability in the longest context known to the language, after escapes (method C:
an escape has the weight of the number of distinct bytes seen in the context) down to the empty context and then to
1/256. Statistics are frozen, so a byte's costs depend on itself and the three bytes before it (a 4-gram); a text is
given to the language with the shortest code.

Counting is a Spark aggregation of byte 4-grams; no count of any language is left out. Costs of contexts up to one byte
are a table of fixed size. Costs of the 4-grams that are most frequent in training are broadcast; all other 4-grams of
the texts meet the full counts in buckets of their two middle bytes, which hold all that their costs need. Which
4-grams are broadcast sets the traffic only: costs are whole multiples of UNIT bits, so sums do not depend on it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow_text import ASCII_LOWER, chunks
from .common import keep

NO_LANGUAGE = "und"
UNIT = 2.0**-20  # bits
HOT = 65_536  # 4-grams whose costs are broadcast


def history(buf: np.ndarray, offs: np.ndarray) -> list[np.ndarray]:
    """The byte before each byte, and the two before that; 0 before a text's start."""
    out, x, first = [], buf, offs[:-1][np.diff(offs) > 0]
    for _ in range(3):
        x = np.concatenate([np.zeros(1, buf.dtype), x[:-1]]) if len(x) else x
        x[first] = 0
        out.append(x)
    return out


def grams(train: DataFrame, most_groups: int = 2_000_000) -> DataFrame:
    """lang, gram, n from train(text, lang): counts of four bytes, the last after the three before it in the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names: dict[str, int] = {}
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def merged() -> tuple[np.ndarray, np.ndarray]:
            if not held:
                return np.empty(0, np.int64), np.empty(0, np.int64)
            keys, n = np.concatenate([k for k, _ in held]), np.concatenate([c for _, c in held])
            u, at = np.unique(keys, return_inverse=True)
            return u, np.bincount(at, n, len(u)).astype(np.int64)

        def rows(u: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
            label = list(names)
            return pa.RecordBatch.from_arrays([pa.array([label[i] for i in u >> 32], pa.string()), pa.array(u & 0xFFFFFFFF, pa.int64()), pa.array(n)], ["lang", "gram", "n"])

        for batch in batches:
            langs = batch.column(1).to_pylist()
            for i, j, offs, buf in chunks(batch):
                code = codes(buf, offs)
                who = np.array([names.setdefault(x, len(names)) for x in langs[i:j]], np.int64)
                for k in np.unique(who):
                    u, n = np.unique(code[np.repeat(who == k, np.diff(offs))], return_counts=True)
                    held.append((u.astype(np.int64) | (int(k) << 32), n.astype(np.int64)))
            if len(held) > 64:
                held = [merged()]
                if len(held[0][0]) > most_groups:
                    yield rows(*held[0])
                    held = []
        u, n = merged()
        if len(u):
            yield rows(u, n)

    return train.select("text", "lang").mapInArrow(run, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def codes(buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """The 4-gram that ends at each byte of texts, lower-cased."""
    low = ASCII_LOWER[buf]
    p1, p2, p3 = history(low, offs)
    return (p3.astype(np.uint32) << 24) | (p2.astype(np.uint32) << 16) | (p1.astype(np.uint32) << 8) | low


def bucket_of(gram: np.ndarray, buckets: int) -> np.ndarray:
    """A bucket by the two middle bytes: contexts of two and three bytes and their counts are in one bucket."""
    return (((gram.astype(np.int64) >> 8) * 40503) & 0xFFFF) * buckets >> 16


class Trees:
    """The languages' context trees as counts by depth: costs in bits of 4-grams, a column for each language.

    below gives the costs of shorter contexts by the 4-gram's last two bytes where the depths do not start at 0. At most
    `cells` costs are worked out at once.
    """

    def __init__(self, langs: list[str], lang: np.ndarray, gram: np.ndarray, n: np.ndarray, cells: int = 1 << 20, depths: tuple[int, ...] = (0, 1, 2, 3), below: np.ndarray | None = None) -> None:
        self.langs, self.cells, self.below = langs, cells, below
        self.depths = []
        lang, gram = lang.astype(np.int64) << 32, gram.astype(np.int64)
        for d in depths:
            key, at = np.unique(lang | (gram & ((1 << 8 * (d + 1)) - 1)), return_inverse=True)
            count = np.bincount(at, n, len(key))
            context, at = np.unique((key >> 32 << 32) | ((key & 0xFFFFFFFF) >> 8), return_inverse=True)
            total, kinds = np.bincount(at, count, len(context)), np.bincount(at, minlength=len(context))
            own = -np.log2(count / (total + kinds)[at]) if len(key) else count
            self.depths.append((d, key, own, context, -np.log2(kinds / (total + kinds)) if len(context) else total))

    def costs(self, grams: np.ndarray) -> np.ndarray:
        """Bits of each 4-gram's last byte after the others: in each context its own cost or, after an escape, its parent's."""
        out, step = np.empty((len(grams), len(self.langs))), max(1, self.cells // max(1, len(self.langs)))
        for a in range(0, len(grams), step):
            g = grams[a : a + step].astype(np.int64)
            cost = np.full((len(g), len(self.langs)), 8.0) if self.below is None else self.below[g & 0xFFFF]  # 1/256 for every byte
            for d, key, own, context, escape in self.depths:
                low = g & ((1 << 8 * (d + 1)) - 1)
                for k in range(len(self.langs)):
                    c = cost[:, k] + find(context, escape, low >> 8 | k << 32, 0.0)
                    cost[:, k] = find(key, own, low | k << 32, c)
            out[a : a + step] = cost
        return out

    def bits(self, buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
        """Code length of each text under each language."""
        out, full = np.zeros((len(offs) - 1, len(self.langs))), np.diff(offs) > 0
        if full.any():
            out[full] = np.add.reduceat(self.costs(codes(buf, offs)), offs[:-1][full], axis=0)
        return out


def find(keys: np.ndarray, values: np.ndarray, x: np.ndarray, other) -> np.ndarray:
    """values where sorted keys hold x, else other."""
    if not len(keys):
        return np.broadcast_to(other, x.shape)
    at = np.minimum(np.searchsorted(keys, x), len(keys) - 1)
    return np.where(keys[at] == x, values[at], other)


def units(bits: np.ndarray) -> np.ndarray:
    return np.rint(bits / UNIT).astype(np.int32)


@dataclass
class Model:
    """All counts as a table, and what is broadcast: costs of contexts up to one byte, and of frequent 4-grams."""

    langs: list[str]
    counts: DataFrame  # bucket, lang (its place in langs), gram, n: every 4-gram of the training texts
    buckets: int
    below: np.ndarray  # (last two bytes, language), bits
    gram: np.ndarray  # frequent 4-grams, sorted
    cost: np.ndarray  # (4-gram, language), units; a last row of zeros


def fit(train: DataFrame, hot: int = HOT, size: int = 0) -> Model | None:
    """Model of train(text, lang) without nulls: every 4-gram of every language with a byte to learn from. None without any. size: bytes of the texts to be told apart."""
    sc = train.sparkSession.sparkContext
    counts = keep(grams(train))
    low = counts.groupBy("lang", F.col("gram").bitwiseAND(0xFFFF).alias("gram")).agg(F.sum("n").alias("n"), F.count("*").alias("kinds")).toPandas()  # at most 65,536 rows a language
    if low.empty:
        return None
    langs = sorted(set(low.lang))
    place = F.create_map(*[F.lit(x) for i, lang in enumerate(langs) for x in (lang, i)])
    buckets = max(8, -(-int(low.kinds.sum()) // 1_000_000), -(-size // (64 << 20)))
    where = low.lang.map({x: i for i, x in enumerate(langs)}).to_numpy(np.int64)
    below = Trees(langs, where, low.gram.to_numpy(np.int64), low.n.to_numpy(np.float64), depths=(0, 1)).costs(np.arange(1 << 16))
    bucket = F.shiftright((F.shiftright("gram", 8) * 40503).bitwiseAND(0xFFFF) * buckets, 16).cast("int")  # as bucket_of
    table = counts.select(bucket.alias("bucket"), place[F.col("lang")].alias("lang"), "gram", "n")
    top = counts.groupBy("gram").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "gram").limit(hot).select("gram").toPandas()
    frequent, known = sc.broadcast(np.sort(top.gram.to_numpy(np.int64))), sc.broadcast(below)

    def cost(rows: pa.Table) -> pa.Table:
        b = rows.column("bucket")[0].as_py()
        g = frequent.value[bucket_of(frequent.value, buckets) == b]
        lang, gram, n = (rows.column(c).to_numpy() for c in ("lang", "gram", "n"))
        return pa.table({"gram": pa.array([g.tobytes()], pa.binary()), "cost": pa.array([units(Trees(langs, lang, gram, n, depths=(2, 3), below=known.value).costs(g)).tobytes()], pa.binary())})

    rows = table.groupBy("bucket").applyInArrow(cost, "gram binary, cost binary").collect()  # a row for each bucket, `hot` 4-grams in all
    gram = np.concatenate([np.frombuffer(r["gram"], np.int64) for r in rows])
    costs = np.concatenate([np.frombuffer(r["cost"], np.int32).reshape(-1, len(langs)) for r in rows])
    order = np.argsort(gram)
    return Model(langs, table, buckets, below, gram[order].astype(np.uint32), np.concatenate([costs[order], np.zeros((1, len(langs)), np.int32)]))


def predictions(d: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score, bits_per_byte of every row of d(doc_id, text, letter).

    Texts go in blocks of whole texts. A block keeps its sums over broadcast 4-grams; its other 4-grams go to their buckets,
    and each bucket answers a block in one row.
    """
    sc, langs, buckets = d.sparkSession.sparkContext, model.langs, model.buckets
    shared = sc.broadcast((model.gram, model.cost))
    known = sc.broadcast(model.below)
    columns = {"bucket": pa.int32(), "block": pa.int64(), "doc_id": pa.list_(pa.int64()), "letter": pa.binary(), "size": pa.binary(), "gram": pa.binary(), "who": pa.binary(), "units": pa.binary()}
    schema = "bucket int, block long, doc_id array<long>, letter binary, size binary, gram binary, who binary, units binary"

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gram, cost = shared.value
        cold = len(gram)
        slot = lambda g: (g * np.uint32(0x9E3779B1)) >> np.uint32(12)
        first = np.full(1 << 20, max(0, cold - 1), np.int32)
        first[slot(gram)] = np.arange(cold)
        block = TaskContext.get().partitionId() << 32
        for batch in batches:
            letter = np.array(batch.column(2).to_pylist(), bool)
            for i, j, offs, buf in chunks(batch):
                code, m, n = codes(buf, offs), j - i, np.diff(offs)
                at = np.take(first, slot(code)) if cold else np.zeros(len(code), np.int32)
                miss = np.flatnonzero(gram[at] != code) if cold else np.arange(len(code))
                at[miss] = find(gram, np.arange(cold), code[miss], cold)
                out = np.zeros((m, len(langs)), np.int64)
                full = n > 0
                if full.any():
                    out[full] = np.add.reduceat(cost[at], offs[:-1][full], axis=0, dtype=np.int64)
                rows = [(block % buckets, block, batch.column(0).slice(i, m).to_pylist(), letter[i:j].tobytes(), n.astype(np.int64).tobytes(), None, None, out.tobytes())]
                miss = miss[at[miss] == cold]
                who, rare = (np.searchsorted(offs, miss, "right") - 1).astype(np.uint32), code[miss]
                part = bucket_of(rare, buckets)
                order = np.argsort(part, kind="stable")
                cut = np.searchsorted(part[order], np.arange(buckets + 1))
                for b in np.flatnonzero(np.diff(cut)):
                    x = order[cut[b] : cut[b + 1]]
                    rows.append((int(b), block, None, None, None, rare[x].tobytes(), who[x].tobytes(), None))
                block += 1
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), columns.values())], list(columns))

    def meet(counts: pa.Table, sent: pa.Table) -> pa.Table:
        own = sent.filter(pa.compute.is_null(sent.column("gram")))
        asked = sent.filter(pa.compute.is_valid(sent.column("gram"))).select(["bucket", "block", "gram", "who"]).to_pylist()
        if not asked:
            return own
        u, at = np.unique(np.concatenate([np.frombuffer(r["gram"], np.uint32) for r in asked]), return_inverse=True)
        lang, gram, n = (counts.column(c).to_numpy() for c in ("lang", "gram", "n"))
        cost = units(Trees(langs, lang, gram, n, depths=(2, 3), below=known.value).costs(u))
        rows, base = [], 0
        for r in asked:
            who, place = np.unique(np.frombuffer(r["who"], np.uint32), return_inverse=True)
            sums = np.zeros((len(who), len(langs)), np.int64)
            np.add.at(sums, place, cost[at[base : base + len(place)]])
            base += len(place)
            rows.append((r["bucket"], r["block"], None, None, None, None, who.tobytes(), sums.tobytes()))
        return pa.concat_tables([own, pa.table([pa.array(c, k) for c, k in zip(zip(*rows), columns.values())], names=list(columns))])

    def finish(table: pa.Table) -> pa.Table:
        head = table.filter(pa.compute.is_valid(table.column("size"))).to_pylist()[0]
        size, ok = np.frombuffer(head["size"], np.int64), np.frombuffer(head["letter"], bool)
        total = np.frombuffer(head["units"], np.int64).reshape(-1, len(langs)).copy()
        for r in table.filter(pa.compute.is_null(table.column("size"))).select(["who", "units"]).to_pylist():
            total[np.frombuffer(r["who"], np.uint32)] += np.frombuffer(r["units"], np.int64).reshape(-1, len(langs))
        best = total.argmin(1)
        least = total[np.arange(len(best)), best]
        pred = [langs[b] if k else NO_LANGUAGE for b, k in zip(best, ok)]
        score = np.where(ok, 1 / np.exp2(np.maximum((least[:, None] - total) * UNIT, -1000)).sum(1), 0.0)
        return pa.table({"doc_id": pa.array(head["doc_id"], pa.int64()), "lang_pred": pa.array(pred, pa.string()), "score": score, "bits_per_byte": least * UNIT / np.maximum(size, 1)})

    sent = d.select("doc_id", "text", "letter").mapInArrow(send, schema)
    parts = model.counts.groupBy("bucket").cogroup(sent.groupBy("bucket")).applyInArrow(meet, schema)
    return parts.groupBy("block").applyInArrow(finish, "doc_id long, lang_pred string, score double, bits_per_byte double")


def identify(docs: DataFrame, train: DataFrame, id_col: str = "doc_id", text_col: str = "text", hot: int = HOT) -> DataFrame:
    """doc_id, lang_pred, score, bits_per_byte of every row; whole texts.

    A null text, a text without a letter, or a train table without rows gives 'und' with score 0. score is the posterior
    of the language under equal priors. Ties go to the first language by code point. Repeated rows come back repeated.
    """
    letter = F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False))
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), letter.alias("letter"))
    size = d.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    model = fit(train.where("lang is not null and text is not null").select("text", "lang"), hot, size)
    if model is None:
        return d.select("doc_id", F.lit(NO_LANGUAGE).alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(0.0).alias("bits_per_byte"))
    return predictions(d, model)
