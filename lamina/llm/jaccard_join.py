"""N-gram Jaccard join: exact links between documents whose sets of word shingles are similar, and their groups.

Set-relation skipping keeps the work near linear without losing a link:

* Equal sets are one set (128-bit fingerprint); one document stands for its copies.
* A set with a partner shares at least `similarity` of its shingles with other sets. Counting which shingles occur in
  two sets or more (one exchange of packed 48-bit hashes; a hash is sent once per block of documents) leaves only
  the live sets. Passages that many documents share do not make a document live.
* Live sets index only a prefix of their shingles, rare ones first; two similar sets meet in a prefix. Index lists are
  cut in blocks by size. If h is the first shingle that two sets share, at place i of the smaller one x, the partner's
  size is at most (|x| - i) / similarity: x enters only the blocks up to that size, and all others are skipped.
* Within a block no pair is formed but those with one leader p. From the leader's answers follow all others: |x & y| =
  |x & y & p| + |(x - p) & (y - p)|, so a pair in different groups that can link either shares a shingle outside p, or
  both overlaps with p reach the bound, which takes one set that p does not link with and one smaller than p. The next,
  much shorter lists are therefore p's sets by the rare shingles that they hold besides p's, and its sets of those two
  kinds; they are treated alike until the pairs left are about as many as their entries. Those are compared one by one.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow_text import ASCII_LOWER, Hasher, U, chunks, mix, words
from .common import components, keep, settled

PASSES, PASS = 4, 5_000_000  # turns in which much is exchanged, so that a quarter of it is on disk at a time; shingles from which a further turn pays
SHIFTS = [U(pow(0xC2B2AE3D27D4EB4F, k, 1 << 64)) for k in range(1, 8)]


def shingle_sets(buf: np.ndarray, offs: np.ndarray, hasher: Hasher, width: int) -> list[np.ndarray]:
    """Sorted 64-bit hashes of each document's distinct shingles; with fewer than `width` words, of the whole sequence."""
    low = ASCII_LOWER[buf]
    starts, ends, first = words(low, offs)
    hasher.load(low)
    h = hasher.of(starts, ends)
    n = max(0, len(h) - width + 1)
    wide = np.full(n, width, U)
    for k in range(width):
        wide += h[k : k + n] * SHIFTS[k]
    wide = mix(wide)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        if b - a >= width:
            out.append(np.unique(wide[a : b - width + 1]))
        elif b > a:
            short = U(b - a)
            for k in range(b - a):
                short += h[a + k] * SHIFTS[k]
            out.append(mix(np.array([short], U)))
        else:
            out.append(np.empty(0, U))
    return out


def _sets(batches: Iterator[pa.RecordBatch], width: int, most: int = 1 << 20) -> Iterator[tuple[list, list[np.ndarray]]]:
    hasher = Hasher()
    with np.errstate(over="ignore"):
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for i, j, offs, buf in chunks(batch, most=most):
                yield ids[i:j], shingle_sets(buf, offs, hasher, width)


def fingerprints(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, n, f1, f2: size and 128-bit fingerprint of each document's set."""

    def run(batches):
        for ids, sets in _sets(batches, width):
            n = [len(s) for s in sets]
            f1 = [int(s.sum(dtype=U)) for s in sets]
            f2 = [int(mix(s ^ U(0x5851F42D4C957F2D)).sum(dtype=U)) for s in sets]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(n, pa.int64()), pa.array(np.array(f1, U).view(np.int64)), pa.array(np.array(f2, U).view(np.int64))], ["doc_id", "n", "f1", "f2"])

    return docs.mapInArrow(run, "doc_id long, n long, f1 long, f2 long")


def _packed(batches: Iterator[pa.RecordBatch], most: int = 200_000) -> Iterator[tuple[list, list[np.ndarray]]]:
    for batch in batches:
        ids, sets = batch.column(0).to_pylist(), [np.frombuffer(x, U) for x in batch.column(1).to_pylist()]
        i = 0
        while i < len(ids):
            j, total = i + 1, len(sets[i])
            while j < len(ids) and total + len(sets[j]) <= most:
                total, j = total + len(sets[j]), j + 1
            yield ids[i:j], sets[i:j]
            i = j


def shared_counts(docs: DataFrame, width: int | None, buckets: int, block: int = 1 << 20, passes: int = 1) -> DataFrame:
    """doc_id, shared: how many of a document's shingles also occur in another row (documents without any may be missing).

    docs holds (doc_id, text), or with width None (doc_id, shingles) as packed_sets gives them.

    Documents are packed in blocks. A hash found twice in a block is credited at once and sent as a marker; others are
    sent with their document's place in the block. So a hash costs one entry per block, however many documents hold it, and
    the answers of a bucket to a block come back as one row. A block's ids travel once, with its credits: what a block sends to
    a bucket grows with its hashes there alone, also where many buckets leave few hashes to each. passes: buckets are worked on
    in so many turns, each of which reads docs anew and has only its own share of the hashes on disk.
    """
    if passes > 1:
        turns = [keep(_shared_in_turn(docs, width, buckets, block, passes, turn)) for turn in range(passes)]
        out = turns[0]
        for more in turns[1:]:
            out = out.unionByName(more)
    else:
        out = _shared_in_turn(docs, width, buckets, block, 1, 0)
    return out.groupBy("doc_id").agg(F.sum("shared").alias("shared"))


def _shared_in_turn(docs: DataFrame, width: int | None, buckets: int, block: int, passes: int, turn: int) -> DataFrame:
    """doc_id, shared of the buckets of one turn, a row for each block that holds the document."""

    def send(batches):
        for ids, sets in _packed(batches) if width is None else _sets(batches, width, block):
            if not (total := sum(map(len, sets))):
                continue
            h = np.concatenate(sets)
            who = np.repeat(np.arange(len(sets), dtype=np.uint32), [len(s) for s in sets])
            order = np.argsort(h, kind="stable")
            h, who = h[order], who[order]
            new = np.ones(total, bool)
            new[1:] = h[1:] != h[:-1]
            run = np.diff(np.append(np.flatnonzero(new), total))
            twice = np.repeat(run > 1, run)
            credit = np.bincount(who[twice], minlength=len(sets))
            h, who, many = h[new], who[new], run > 1
            part = (h % U(buckets)).astype(np.int64)
            if passes > 1:
                now = part % passes == turn
                h, who, many, part = h[now], who[now], many[now], part[now]
                credit *= turn == 0
            order = np.argsort(part, kind="stable")
            h, who, many, part = h[order], who[order], many[order], part[order]
            cut = np.searchsorted(part, np.arange(buckets + 1))
            owner = np.array([-1 if x is None else x for x in ids], np.int64)
            rows = {"bucket": [], "block": [], "hash": [], "who": [], "ids": [], "credit": []}
            name = int.from_bytes(blake2b(owner.tobytes(), digest_size=8).digest(), "little", signed=True)  # blocks of one name have the same ids at the same places
            small = np.iinfo(np.uint16 if len(sets) < 65_000 else np.uint32)
            for b in np.flatnonzero(np.diff(cut)):
                x = slice(cut[b], cut[b + 1])
                packed = h[x] >> U(16)
                rows["bucket"].append(int(b))
                rows["block"].append(name)
                rows["hash"].append((packed >> U(16)).astype(np.uint32).tobytes() + (packed & U(0xFFFF)).astype(np.uint16).tobytes())
                rows["who"].append(np.where(many[x], small.max, who[x]).astype(small.dtype).tobytes())
                rows["ids"].append(None)
                rows["credit"].append(None)
            rows["bucket"].append(int(owner[0]) % buckets)
            rows["block"].append(name)
            for c in ("hash", "who"):
                rows[c].append(b"")
            rows["ids"].append(owner.tobytes())
            rows["credit"].append(credit.astype(np.uint32).tobytes())
            kinds = [pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(rows.values(), kinds)], list(rows))

    def meet(table: pa.Table) -> pa.Table:
        out = {"block": [], "ids": [], "who": [], "shared": []}
        hashes, places, docs_of, blocks, base = [], [], [], [], 0
        for block, hb, wb, ib, cb in zip(*(table.column(c).to_pylist() for c in ("block", "hash", "who", "ids", "credit"))):
            if cb is not None:
                for c, v in zip(out, (block, ib, None, cb)):
                    out[c].append(v)
                continue
            n = len(hb) // 6
            hashes.append((np.frombuffer(hb[: 4 * n], np.uint32).astype(U) << U(16)) | np.frombuffer(hb[4 * n :], np.uint16))
            w = np.frombuffer(wb, np.uint16 if len(wb) == 2 * n else np.uint32)
            used, place = np.unique(w, return_inverse=True)
            places.append(np.where(w == np.iinfo(w.dtype).max, -1, place + base))
            docs_of.append(used)
            blocks.append(block)
            base += len(used)
        if hashes:
            h, p = np.concatenate(hashes), np.concatenate(places)
            order = np.argsort(h, kind="stable")
            h, p = h[order], p[order]
            same = h[1:] == h[:-1]
            hit = np.zeros(len(h), bool)
            hit[1:] |= same
            hit[:-1] |= same
            n = np.bincount(p[hit & (p >= 0)], minlength=base)
            for block, used, part in zip(blocks, docs_of, np.split(n, np.cumsum([len(x) for x in docs_of])[:-1])):
                if part.any():
                    for c, v in zip(out, (block, None, used[part > 0].astype(np.uint32).tobytes(), part[part > 0].astype(np.uint32).tobytes())):
                        out[c].append(v)
        return pa.table({c: pa.array(v, t) for (c, v), t in zip(out.items(), (pa.int64(), pa.binary(), pa.binary(), pa.binary()))})

    def add(table: pa.Table) -> pa.Table:
        ids = next(np.frombuffer(x, np.int64) for x in table.column("ids").to_pylist() if x is not None)
        total = np.zeros(len(ids), np.int64)
        for who, n in zip(table.column("who").to_pylist(), table.column("shared").to_pylist()):
            total[slice(None) if who is None else np.frombuffer(who, np.uint32)] += np.frombuffer(n, np.uint32)
        u, at = np.unique(ids[total > 0], return_inverse=True)
        return pa.table({"doc_id": u, "shared": np.bincount(at, total[total > 0], len(u)).astype(np.int64)})

    sent = docs.mapInArrow(send, "bucket int, block long, hash binary, who binary, ids binary, credit binary")
    met = sent.groupBy("bucket").applyInArrow(meet, "block long, ids binary, who binary, shared binary")
    return met.groupBy("block").applyInArrow(add, "doc_id long, shared long")


def packed_sets(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, n, shingles: sorted 8-byte hashes."""

    def run(batches):
        for ids, sets in _sets(batches, width):
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], ["doc_id", "n", "shingles"])

    return docs.mapInArrow(run, "doc_id long, n long, shingles binary")


def sketch(live: DataFrame, bits: int) -> np.ndarray:
    """Counts of shingles by hash slot, 2**bits of them: what rarity is read from. Its size is fixed; it changes only the order of the index, never a result."""

    def count(batches):
        total = np.zeros(1 << bits, np.int64)
        for batch in batches:
            for x in batch.column(0).to_pylist():
                np.add.at(total, (np.frombuffer(x, U) & U((1 << bits) - 1)).astype(np.int64), 1)
        for i, part in enumerate(np.split(total, 64)):
            yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([part.tobytes()], pa.binary())], ["part", "counts"])

    def add(table: pa.Table) -> pa.Table:
        rows = table.column("counts").to_pylist()
        total = sum(np.frombuffer(x, np.int64) for x in rows)
        return pa.table({"part": pa.array([table.column("part")[0].as_py()], pa.int32()), "counts": pa.array([total.tobytes()], pa.binary())})

    parts = live.select("shingles").mapInArrow(count, "part int, counts binary").groupBy("part").applyInArrow(add, "part int, counts binary").collect()
    out = np.zeros(1 << bits, np.int64)
    for r in parts:
        out[r["part"] * (len(out) // 64) :][: len(out) // 64] = np.frombuffer(r["counts"], np.int64)
    return out


def size_block(n: np.ndarray) -> np.ndarray:
    """Blocks of sizes, each 15 % wide: never decreasing in n."""
    return np.floor(np.log(np.maximum(n, 1)) / np.log(1.15) + 1e-9).astype(np.int64)


def by_rarity(s: np.ndarray, counts: np.ndarray) -> np.ndarray:
    return s[np.lexsort((s, counts[(s & U(len(counts) - 1)).astype(np.int64)]))]


def index_lists(live: DataFrame, rarity, similarity: Fraction) -> DataFrame:
    """k, doc, n, m: entries of each live set's prefix, in order of rarity, in every block of an index list in which a partner can be."""
    p, q = similarity.numerator, similarity.denominator

    def run(batches):
        for batch in batches:
            cols = {k: [] for k in ("k", "doc", "n", "m")}
            for doc, blob, m in zip(*(batch.column(k).to_pylist() for k in range(3))):
                s = np.frombuffer(blob, U)
                n = len(s)
                pick = by_rarity(s, rarity.value)[: n - (-(-p * n // q)) + 1]
                own = size_block(np.array([n]))[0]
                more = size_block((n - np.arange(len(pick))) * q // p) - own + 1
                more = np.maximum(more, 1)
                block = own + np.arange(more.sum()) - np.repeat(np.cumsum(more) - more, more)
                cols["k"].append(mix(np.repeat(pick, more) + block.astype(U) * U(0xA24BAED4963EE407)).view(np.int64))
                for c, v in (("doc", doc), ("n", n), ("m", m)):
                    cols[c].append(np.full(len(block), v, np.int64))
            if cols["k"]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(v)) for v in cols.values()], list(cols))

    return live.select("doc_id", "shingles", "m").mapInArrow(run, "k long, doc long, n long, m long")


def compare(pairs: DataFrame, live: DataFrame, similarity: Fraction, rarity=None) -> DataFrame:
    """a, b, na, nb, m, both, rest: sizes and overlap of pairs of live sets, m of b; with rarity, rest has the prefix of b - a by which b can meet another set outside a."""
    p, q = similarity.numerator, similarity.denominator

    def run(batches):
        for batch in batches:
            a, b, m, x, y = (batch.column(i).to_pylist() for i in range(5))
            na, nb, both, rest = [], [], [], []
            for s, t in zip(x, y):
                s, t = np.frombuffer(s, U), np.frombuffer(t, U)
                inside = s[np.minimum(np.searchsorted(s, t), len(s) - 1)] == t
                na.append(len(s))
                nb.append(len(t))
                both.append(int(inside.sum()))
                if rarity is not None:  # b and a partner share at least p/q of b, and of that at most `both` inside a
                    out = by_rarity(t[~inside], rarity.value)
                    out = out[: len(out) - max(1, -(-p * len(t) // q) - both[-1]) + 1]
                    rest.append(out.view(np.int64).tolist())
                else:
                    rest.append(None)
            ints = [pa.array(v, pa.int64()) for v in (a, b, na, nb, m, both)]
            yield pa.RecordBatch.from_arrays([*ints, pa.array(rest, pa.list_(pa.int64()))], ["a", "b", "na", "nb", "m", "both", "rest"])

    left = live.select(F.col("doc_id").alias("a"), F.col("shingles").alias("x"))
    right = live.select(F.col("doc_id").alias("b"), F.col("shingles").alias("y"), "m")
    both = pairs.join(left.hint("merge"), "a").join(right.hint("merge"), "b").select("a", "b", "m", "x", "y")
    return both.mapInArrow(run, "a long, b long, na long, nb long, m long, both long, rest array<long>")


def open_lists(seen: DataFrame, group: DataFrame, similarity: Fraction, rows: int) -> DataFrame:
    """k, doc, n, m, g, o, r, inside from leaders' answers: lists in which sets x, y of different groups g can still link. They share min(ox, oy) + min(rx, ry) at most."""
    p, q = similarity.numerator, similarity.denominator
    member = seen.join(group.select(F.col("id").alias("b"), F.col("component").alias("g")), "b", "left").withColumn("g", F.coalesce("g", "b"))

    def split(keys: list[str], rows: DataFrame) -> DataFrame:
        torn = rows.groupBy(*keys).agg(F.min("g").alias("lo"), F.max("g").alias("hi")).where("lo <> hi").select(*keys)
        return rows.join(torn, keys)

    member = keep(split(["a"], member), rows)
    outside = split(["a", "e"], member.select("a", "b", "nb", "m", "g", "both", (F.col("m") - F.col("both")).alias("r"), F.explode("rest").alias("e")))
    linked = F.col("both") * (p + q) >= (F.col("na") + F.col("nb")) * p
    inside = split(["a"], member.where((F.col("both") * q >= F.col("nb") * p) & (~linked | (F.col("nb") < F.col("na")))))
    inside = inside.select("a", "b", "nb", "m", "g", "both", F.lit(0).cast("long").alias("r"), F.lit(None).cast("long").alias("e"))
    rows = outside.select(*inside.columns).unionByName(inside)
    k = F.xxhash64("a", "e", F.col("e").isNull())
    return rows.select(k.alias("k"), F.col("b").alias("doc"), F.col("nb").alias("n"), "m", "g", F.col("both").alias("o"), "r", F.col("e").isNull().alias("inside"))


def similar_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, similarity: Fraction = Fraction(3, 4), bits: int = 20, bucket_rows: int = 3_000_000, few: int = 16) -> DataFrame:
    """doc_id, n_shingles, component_id of every row.

    Words are runs other than \\x20 and \\x09-\\x0D of the A-Z-lower-cased text. Two documents link when overlap >=
    similarity * union (exact, in whole numbers). component_id is the smallest id reachable by links, itself included.
    Null and text without words have the empty set, which links with nothing. Rows that share an id are one document; a
    null id stays null and links with nothing. Repeated rows come back repeated; an empty table gives an empty table.
    Lists go to further leaders while they hold over `few` pairs an entry; results do not depend on it.
    """
    spark = docs.sparkSession
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    marks = keep(fingerprints(d, width))
    key = ["n", "f1", "f2"]
    copies = keep(marks.where("n > 0 and doc_id is not null").groupBy(*key).agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("many")).where("many > 1"))
    total = marks.agg(F.sum("n")).first()[0] or 0
    buckets = max(8, -(-total // bucket_rows))
    passes = max(1, min(PASSES, total // PASS))
    shared = shared_counts(d.where("doc_id is not null"), width, buckets, passes=passes)
    enough = F.col("shared") * similarity.denominator >= F.col("n") * similarity.numerator
    live_ids = shared.join(marks.where("n > 0").distinct(), "doc_id").where(enough)
    live_ids = keep(live_ids.join(copies, key, "left").where("rep is null or rep = doc_id").select("doc_id").distinct())
    packed = None
    for turn in range(passes):  # texts are sent to their ids in turns too
        some = d.where(F.pmod(F.xxhash64("doc_id"), F.lit(passes)) == turn) if passes > 1 else d
        sets = keep(packed_sets(some.join(live_ids.hint("merge"), "doc_id", "left_semi"), width).dropDuplicates(["doc_id", "shingles"]))
        packed = sets if packed is None else packed.unionByName(sets)
    live_total = packed.agg(F.sum("n")).first()[0] or 0
    among = shared_counts(packed.select("doc_id", "shingles"), None, max(8, -(-live_total // bucket_rows))).withColumnRenamed("shared", "m")
    live = keep(packed.join(among.hint("merge"), "doc_id").where(F.col("m") * similarity.denominator >= F.col("n") * similarity.numerator))
    rarity = spark.sparkContext.broadcast(sketch(live, bits))
    p, q = similarity.numerator, similarity.denominator

    def reaches(x, na, nb):  # overlap >= s/(1+s) * (na + nb)
        return x * (p + q) >= (na + nb) * p

    is_link = reaches(F.col("both"), F.col("na"), F.col("nb"))
    lists, links, group, pairs, entries, rounds = keep(index_lists(live, rarity, similarity)), None, None, 1, 0, 0
    while pairs > (few * entries if rounds else 0) and rounds < 8:
        best = F.min(F.struct((-F.col("m") / F.col("n")).alias("rank"), (-F.col("n")).alias("size"), "doc"))
        leaders = lists.groupBy("k").agg(best.alias("l"), F.count(F.lit(1)).alias("sets")).where("sets > 1").select("k", F.col("l.doc").alias("a"))
        led = keep(lists.join(leaders, "k").where("doc <> a").select("a", F.col("doc").alias("b")).distinct())
        n_led = led.count()
        seen = keep(compare(led, live, similarity, rarity), n_led, 10_000)
        new = seen.where(is_link).select("a", "b")
        links = new if links is None else links.unionByName(new)
        group = components(links)
        lists = keep(open_lists(seen, group, similarity, n_led))
        # A pair of an `inside` list is one comparison of numbers, a pair of another a comparison of sets.
        c = F.count(F.lit(1))
        cost = F.when(F.col("inside"), F.lit(1 / 32)).otherwise(F.lit(1.0)) * F.col("c") * (F.col("c") - 1) / 2
        pairs, entries = lists.groupBy("k", "inside").agg(c.alias("c")).agg(F.coalesce(F.sum(cost), F.lit(0.0)), F.coalesce(F.sum("c"), F.lit(0))).first()
        rounds += 1
    if pairs:
        x = lists.select("k", F.col("doc").alias("x"), F.col("n").alias("nx"), F.col("g").alias("gx"), F.col("o").alias("ox"), F.col("r").alias("rx"))
        y = lists.select(F.col("k").alias("ky"), F.col("doc").alias("y"), F.col("n").alias("ny"), F.col("g").alias("gy"), F.col("o").alias("oy"), F.col("r").alias("ry"))
        able = reaches(F.least("ox", "oy") + F.least("rx", "ry"), F.col("nx"), F.col("ny"))
        left = x.join(y, (F.col("k") == F.col("ky")) & (F.col("x") < F.col("y")) & (F.col("gx") != F.col("gy")) & able)
        last = compare(left.select(F.col("x").alias("a"), F.col("y").alias("b")).distinct(), live, similarity)
        more = keep(last.where(is_link).select("a", "b"))
        if more.limit(1).count():
            group = components(links.unionByName(more))
    out = marks.join(copies, key, "left").withColumn("rep", F.coalesce("rep", "doc_id"))
    out = out.join(group.withColumnRenamed("id", "rep"), "rep", "left")
    out = out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "rep", "doc_id").alias("component_id"))
    return out


def drop_similar(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that stay, with all their columns whatever their names: of each group the row of the smallest id.

    Rows are judged by id and text: texts that share an id with another text, and texts without an id, get a key of their
    own below all ids, and go or stay by themselves. A group's row with an id stays rather than one without. Of rows equal in id and
    text one stays. Null and empty texts link with nothing, so one row for each id stays. An empty table gives an empty table.
    """
    mark = F.md5(F.coalesce(docs[text_col], F.lit("")))
    marks = keep(docs.select(docs[id_col].cast("long").alias("k"), mark.alias("m")))
    per = keep(marks.groupBy("k", "m").agg(F.count(F.lit(1)).alias("n")))
    several = per.groupBy(F.col("k").alias("kk")).agg(F.min("m").alias("least"), F.count(F.lit(1)).alias("texts"))
    several = several.where("texts > 1 or kk is null")
    others = per.join(several, F.col("k").eqNullSafe(F.col("kk"))).where("k is null or m <> least")
    low = F.lit(min(0, marks.agg(F.min("k")).first()[0] or 0))
    strays = keep(others.select("k", "m", (low - 1 - F.monotonically_increasing_id()).alias("stray")))
    own = strays.select(F.col("k").alias("s_k"), F.col("m").alias("s_m"), "stray")
    row = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), docs[id_col].cast("long").alias("k"), docs[text_col].alias("text"), mark.alias("m"))
    row = row.join(own, F.col("k").eqNullSafe(F.col("s_k")) & (F.col("m") == F.col("s_m")), "left").withColumn("key", F.coalesce("stray", "k"))
    groups = settled(docs.sparkSession, lambda: similar_groups(row.select("key", "text"), "key", "text").select(F.col("doc_id").alias("key"), "component_id").distinct())
    real = groups.join(strays.select(F.col("stray").alias("key"), "k", F.lit(True).alias("is_stray")), "key", "left").withColumn("k", F.when(F.col("is_stray"), F.col("k")).otherwise(F.col("key")))
    stays = real.groupBy("component_id").agg(F.min(F.struct(F.col("k").isNull().alias("none"), "k", F.col("is_stray").isNotNull().alias("s"), (-F.col("key")).alias("minus"))).alias("b"))
    gone = real.join(stays, "component_id").where(F.col("key") != -F.col("b.minus")).select("key", F.lit(True).alias("gone"))
    twice = per.where("n > 1").join(own, F.col("k").eqNullSafe(F.col("s_k")) & (F.col("m") == F.col("s_m")), "left").select(F.coalesce("stray", "k").alias("key"))
    left = row.join(gone.hint("merge"), "key", "left").where("gone is null").select("key", "row")
    if not per.where("n > 1").limit(1).count():
        return left.select("row.*")
    twice = keep(twice)
    again = left.join(twice.hint("merge"), "key", "left_semi").dropDuplicates(["key"])
    return left.join(twice.hint("merge"), "key", "left_anti").unionByName(again).select("row.*")
