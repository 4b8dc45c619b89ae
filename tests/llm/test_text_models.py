"""Operators with numpy inside tasks against brute force, exact round trips and held-out accuracy."""

import random
import re
from collections import defaultdict

import numpy as np
import pytest
from cases import empty, frame
from pyspark.sql import functions as F

from lamina.llm import jaccard_join, ppm_language, queries, toxicity_fm, unigram_pieces
from lamina.llm.common import table

SF = "/root/testdata/sf0.01"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def groups(rows):
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER))
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    holders = defaultdict(list)
    for i, s in sets.items():
        for x in s:
            holders[x].append(i)
    near = {(a, b) for v in holders.values() for a in v for b in v if a < b}
    for a, b in near:
        if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {(i, len(s), find(i)) for i, s in sets.items()}


def near_copies(seed=3):
    """A base text, copies of it with single words changed (not all similar to one another), chains, and shared passages."""
    rnd = random.Random(seed)
    word = lambda: f"v{rnd.randint(0, 5000)}"
    base = [word() for _ in range(300)]
    passage = [word() for _ in range(60)]
    out = [base]
    for k in range(80):
        c = list(base)
        for _ in range(rnd.randint(1, 10)):
            c[rnd.randrange(len(c))] = word()
        out.append(c)
    chain = [word() for _ in range(200)]
    for k in range(12):
        chain = chain[6:] + [word() for _ in range(6)]
        out.append(chain)
    for k in range(40):
        out.append([word() for _ in range(rnd.randint(10, 100))] + passage)
    long = [word() for _ in range(160)]
    for k in range(60):  # parts of one text, similar to one another or not, some with an edit
        i = rnd.randint(0, 70)
        c = long[i : i + rnd.randint(60, 90)]
        if k % 3 == 0:
            c[rnd.randrange(len(c))] = word()
        out.append(c)
    rnd.shuffle(out)
    return [(i, " ".join(c)) for i, c in enumerate(out)]


@pytest.mark.parametrize("data", ["cases", "table", "near"])
def test_jaccard(spark, data):
    docs = {"cases": lambda: frame(spark), "table": lambda: table(spark, SF, "documents"), "near": lambda: spark.createDataFrame(near_copies(), "doc_id long, text string")}[data]()
    want = groups([(r.doc_id, r.text) for r in docs.collect()])
    for few in (16, 0) if data == "near" else (16,):  # 0: leaders all the way
        got = jaccard_join.similar_groups(docs, bucket_rows=2000, few=few).collect()
        assert len(got) == docs.count()
        assert {tuple(r) for r in got} == want
    if data == "cases":
        assert jaccard_join.similar_groups(empty(spark)).count() == 0


def test_language(spark):
    docs = table(spark, SF, "documents")
    out = queries.op9_language(spark, SF).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert sum(r.lang == r.lang_pred for r in out) >= 0.97 * len(out)
    assert all(0 <= r.score <= 1 for r in out)
    train = docs.where("lang in ('en', 'fr')")
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "123 !"), (4, "the thing and of"), (4, "the thing and of")], "doc_id long, text string")
    got = sorted((r.doc_id, r.lang_pred) for r in ppm_language.identify(odd, train).collect())
    assert got == [(1, "und"), (2, "und"), (3, "und"), (4, "en"), (4, "en")]
    assert ppm_language.identify(odd, train.limit(0)).where("lang_pred <> 'und'").count() == 0
    assert ppm_language.identify(empty(spark), train).count() == 0


def test_language_costs_by_hand():
    texts = {0: [b"abab", b"abc"], 1: [b"bca"]}
    gram, lang = [], []
    for k, ts in texts.items():
        for t in ts:
            p = b"\0\0\0" + t
            for i in range(len(t)):
                gram.append(int.from_bytes(p[i : i + 4], "big"))
                lang.append(k)
    u, n = np.unique(np.array(gram) | (np.array(lang) << 32), return_counts=True)
    trees = ppm_language.Trees(["x", "y"], u >> 32, u & 0xFFFFFFFF, n.astype(float), 1 << 20)
    test = b"abcabz"

    def cost(k, context, c):
        seen = defaultdict(int)
        for t in texts[k]:
            p = b"\0\0\0" + t
            for i in range(len(t)):
                if p[i + 3 - len(context) : i + 3] == context:
                    seen[p[i + 3]] += 1
        total, kinds = sum(seen.values()), len(seen)
        if seen.get(c):
            return -np.log2(seen[c] / (total + kinds))
        escape = -np.log2(kinds / (total + kinds)) if total else 0.0
        return escape + (cost(k, context[1:], c) if context else 8.0)

    p = b"\0\0\0" + test
    want = [sum(cost(k, p[i : i + 3], p[i + 3]) for i in range(len(test))) for k in (0, 1)]
    got = trees.bits(np.frombuffer(test, np.uint8), np.array([0, len(test)]))
    assert np.allclose(got, [want], atol=1e-4)


def test_language_rare(spark):
    """A language with 1/1000 of the rows, its letters few, is told; costs use every 4-gram, whichever are broadcast."""
    rnd = random.Random(4)
    # Contexts of the common language fill any list of a bounded length; the rare one shares its letters.
    common = [("".join(rnd.choice("abcdefghijklmnopqrstuvwxyz 0123456789") for _ in range(700)), "aa") for _ in range(3000)]
    words = ["zhivko", "brulam", "tesqui", "ondrex"]
    rare = [(" ".join(rnd.choice(words) for _ in range(20)), "zz") for _ in range(3)]
    train = spark.createDataFrame(common + rare, "text string, lang string")
    docs = [(i, " ".join(rnd.choice(words) for _ in range(12))) for i in range(20)] + [(i + 100, common[i][0][:300]) for i in range(20)] + [(500, "\u3042 zhivko"), (501, ""), (502, None)]
    frame_ = spark.createDataFrame(docs, "doc_id long, text string")
    runs = [sorted(map(tuple, ppm_language.identify(frame_, train, hot=hot).collect())) for hot in (ppm_language.HOT, 7)]
    assert runs[0] == runs[1]
    assert all(r[1] == ("zz" if r[0] < 100 else "aa") for r in runs[0] if r[0] < 500)
    gram, lang = [], []
    for t, x in common[:200] + rare:
        p = b"\0\0\0" + t.encode()
        gram += [int.from_bytes(p[i : i + 4], "big") for i in range(len(t))]
        lang += [int(x == "zz")] * len(t)
    u, n = np.unique(np.array(gram) | (np.array(lang) << 32), return_counts=True)
    trees = ppm_language.Trees(["aa", "zz"], u >> 32, u & 0xFFFFFFFF, n.astype(float), 1 << 20)
    small = {r.doc_id: r.bits_per_byte for r in ppm_language.identify(frame_, spark.createDataFrame(common[:200] + rare, "text string, lang string"), hot=50).collect()}
    for i, t in docs:
        b = (t or "").encode()
        want = trees.bits(np.frombuffer(b, np.uint8), np.array([0, len(b)]))[0].min() / max(1, len(b))
        assert small[i] == pytest.approx(want, abs=1e-4)


def test_toxicity(spark):
    sf = "/root/testdata/sf0.1"  # the smaller tables have some thirty toxic texts to learn from
    labels = table(spark, sf, "labels")
    out = queries.op8_toxicity(spark, sf).join(labels, "doc_id").where("held_out").collect()
    caught = sum(r.predicted for r in out if r.toxic)
    assert caught >= 0.8 * sum(r.toxic for r in out)
    assert sum(r.predicted for r in out if not r.toxic) <= 0.02 * len(out)
    machine = queries.toxicity_machine(table(spark, sf, "documents"), labels)
    assert toxicity_fm.score(frame(spark), machine).where("score < 0 or score > 1 or score is null").count() == 0
    assert toxicity_fm.score(empty(spark), machine).count() == 0
    assert toxicity_fm.fit(empty(spark), labels).w.size == 0 and toxicity_fm.fit(frame(spark), labels.where("toxic = 0")).w.size == 0
    kept = toxicity_fm.drop_toxic(frame(spark), machine)
    assert kept.columns == frame(spark).columns and kept.count() == frame(spark).count()


def test_factorization_machine_learns_a_pair():
    """Two terms that are toxic only together: no sum of single weights can tell them apart at all four corners."""
    rng = np.random.default_rng(1)
    x = rng.integers(0, 2, (800, 2))
    y = (x[:, 0] == x[:, 1]).astype(np.int64)
    doc, term = np.nonzero(x)
    m = toxicity_fm.train_machine(np.array([1 << 60, 1 << 61], np.uint64), term, doc, y, epochs=100)
    z = m.margin(term, doc, len(y))
    assert ((z > 0) == y).mean() == 1.0


def test_pieces(spark):
    m = unigram_pieces.Unigram.load()
    texts = [r.text for r in table(spark, SF, "documents").limit(40).collect()] + ["", " ", "  two  spaces ", "▁ mark ▁▁", "日本語 emoji 😀 \x00\x01", "line\nline\n\n", "é" * 300]
    for t in texts:
        assert m.decode(m.encode(t)) == t
    whole = unigram_pieces.Unigram.load()
    whole.by_runs = False
    for t in texts:
        assert sum(m.scores[i] for i in m.encode(t[:800])) == pytest.approx(sum(m.scores[i] for i in whole.encode(t[:800])))
    out = unigram_pieces.encode(frame(spark))
    assert out.where("not round_trip or (n_ids <> size(ids) and ids is not null)").count() == 0 and out.count() == frame(spark).count()
    back = unigram_pieces.decode(out).join(frame(spark).select("doc_id", F.col("text").alias("was")).distinct(), "doc_id")
    assert back.where("not (text <=> was)").count() == 0
    assert unigram_pieces.encode(empty(spark)).count() == 0


def test_viterbi_by_brute_force():
    pieces, scores = ["▁", "a", "b", "ab", "▁a", "aba", "bb"], [-3.0, -2.0, -2.5, -3.9, -4.0, -6.1, -4.4]
    m = unigram_pieces.Unigram(pieces + [f"<0x{i:02X}>" for i in range(256)], scores + [0.0] * 256, ["normal"] * 7 + ["byte"] * 256)
    rnd = random.Random(2)
    for _ in range(200):
        t = "".join(rnd.choice("ab c") for _ in range(rnd.randint(1, 9)))
        s = "▁" + t.replace(" ", "▁")

        def best(i):
            if i == len(s):
                return 0.0
            ways = [scores[k] + best(i + len(p)) for k, p in enumerate(pieces) if s.startswith(p, i)]
            return max(ways) if any(p == s[i] for p in pieces) else max([*ways, m.unknown + best(i + 1)])

        total = sum(scores[k] if k < 7 else m.unknown for k in m.encode(t))
        assert total == pytest.approx(best(0)) and m.decode(m.encode(t)) == t


def unigram(rows, train):
    """Base scores by the formula, token by token."""
    tokens = [(i, [*re.findall(rb"[^\x20\x09-\x0D]+", (t or "").translate(LOWER).encode()), None]) for i, t in rows]
    c = defaultdict(int)
    for i, w in tokens:
        if train(i):
            for x in w:
                c[x] += 1
    n, v = sum(c.values()), len(c)
    return {i: (len(w), sum(x in c for x in w), n, sum(np.log10((c.get(x, 0) + 0.1) / (n + 0.1 * (v + 1))) for x in w)) for i, w in tokens}


@pytest.mark.parametrize("data", ["cases", "table"])
def test_lm_score(spark, data):
    import zlib

    from lamina.llm import context_mixing
    from lamina.llm.common import crc_mod

    docs = (frame(spark) if data == "cases" else table(spark, SF, "documents")).cache()
    held = lambda i: zlib.crc32(str(i).encode()) % 10 == 0
    want = unigram([(r.doc_id, r.text) for r in docs.collect()], lambda i: not held(i))
    small = {"block_bytes": 3000, "bucket_bytes": 5000} if data == "cases" else {}  # many blocks and buckets
    got = context_mixing.score(docs, crc_mod(F.col("doc_id"), 10) != 0, **small).collect()
    assert len(got) == docs.count()
    for r in got:
        n_tokens, known, total, base = want[r.doc_id]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (n_tokens, known, total)
        assert r.base_score == pytest.approx(base, rel=1e-9) and r.score < 0
    if data == "table":  # held-out texts cost less than under the unigram
        assert sum(r.score for r in got if held(r.doc_id)) > 0.97 * sum(r.base_score for r in got if held(r.doc_id))
        nothing = context_mixing.score(docs.limit(3), F.lit(False)).collect()
        assert [(r.n_known, r.train_tokens) for r in nothing] == [(0, 0)] * 3
    else:
        assert context_mixing.score(empty(spark), F.lit(True)).count() == 0


def test_mixer_counts_every_text(spark):
    """The mixer's log odds are those of all training texts, tuned on or not, and do not depend on how rows are split."""
    from lamina.llm import context_mixing as c

    docs = table(spark, SF, "documents").limit(300).select("doc_id", "text").cache()
    bits = (14, 14, 16)
    fit = lambda parts: c.fit_mixer(docs.repartition(parts).withColumn("train", F.lit(True)), bits, 50, 30_000)[0]
    m, other = fit(1), fit(5)
    texts = [r.text for r in docs.collect()]
    counts = [np.zeros((1 << b, 2)) for b in bits]
    for t in texts:  # symbol by symbol
        s, at, _ = c.lay(np.frombuffer(t.encode(), np.uint8), np.array([0, len(t.encode())]))
        rank, ctx = m.code.ranks_of(s, at), c.contexts(s)
        for r, i in zip(rank.tolist(), at.tolist()):
            for d in range(m.code.first[r], m.code.first[r] + m.code.length[r]):
                for k in range(c.INPUTS):
                    counts[k][(int(ctx[k][i]) >> (32 - bits[k])) ^ int(m.code.node[d]), m.code.bit[d]] += 1
    for k in range(c.INPUTS):
        assert np.array_equal(m.odds[k], c.log_odds(counts[k][:, 0], counts[k][:, 1]))
    assert np.array_equal(m.level, c.levels(counts[-1][:, 0], counts[-1][:, 1]))
    assert np.array_equal(m.weight, other.weight) and all(map(np.array_equal, m.odds, other.odds))


def test_weights_come_from_every_text(spark):
    """Decisions seen by the counts of other texts, one text after the other; a gate's weights are where its loss is least; any text counts."""
    from lamina.llm import context_mixing as c

    rng = np.random.default_rng(7)
    m = small_mixer(rng)
    texts = [rng.integers(97, 112, n).astype(np.uint8) for n in (400, 3, 0, 900)]
    laid = c.lay(np.concatenate(texts), np.cumsum([0, *map(len, texts)]))
    own = [[c.slot_counts(m.code, ctx[at], m.code.ranks_of(s, at), 10) for ctx in c.contexts(s)] for s, at, _ in (c.lay(t, np.array([0, len(t)])) for t in texts)]
    counts = [np.zeros(2048, np.int32) for _ in m.bits]
    for k in range(c.INPUTS):
        for o in own:
            np.add.at(counts[k], o[k][0], o[k][1].astype(np.int32))
    x, gate, bit = c.seen_by_others(m.code, m.bits, counts, *laid)
    start = 0
    for t, o in zip(texts, own):
        s, at, _ = c.lay(t, np.array([0, len(t)]))
        rank, less = m.code.ranks_of(s, at), [v.copy() for v in counts]
        for k in range(c.INPUTS):
            np.subtract.at(less[k], o[k][0], o[k][1].astype(np.int32))
        n = m.code.length[rank]
        node = m.code.node[c.run_of(n, m.code.first[rank])].astype(int)
        for k, ctx in enumerate(c.contexts(s)):
            slot = np.repeat((ctx[at] >> c.M(22)).astype(int), n) ^ node
            assert np.array_equal(x[k, start : start + len(node)], c.log_odds(less[k][2 * slot], less[k][2 * slot + 1]))
        start += len(node)
    assert start == len(bit) == len(gate)
    y = rng.integers(-100, 100, (c.INPUTS, 40))
    ones = np.rint(1000 / (1 + np.exp(-np.array([0.5, 0.2, 0.4]) @ y / c.UNIT))).astype(int)
    assert c.newton(np.full(40, 1000), ones, y * 1000, np.full(3, 0.3), 50) == pytest.approx([0.5, 0.2, 0.4], abs=0.02)
    docs = table(spark, SF, "documents").limit(40).select("doc_id", "text").withColumn("train", F.lit(True))
    odd = spark.createDataFrame([(10**9, "zq " * 400_000, True)], "doc_id long, text string, train boolean")  # above 1 MB
    w = [c.fit_mixer(d, (14, 14, 16))[0].weight for d in (docs, docs.unionByName(odd))]
    assert (w[0] != np.float32(0.3)).any() and not np.array_equal(*w)


def test_own_counts_are_taken_off_beside_the_tables():
    """Tables of counts are only read, as numbers or as bytes; a text in segments loses its own counts of all segments."""
    from lamina.llm import context_mixing as c

    import pyarrow as pa

    rng = np.random.default_rng(8)
    m = small_mixer(rng)
    texts = [rng.integers(97, 112, n).astype(np.uint8) for n in (3000, 0, 900, 40)]
    laid = c.lay(np.concatenate(texts), np.cumsum([0, *map(len, texts)]))
    counts = [rng.integers(0, 128, 2048).astype(np.int32) for _ in m.bits]
    c.add_counts(counts, m.code, m.bits, *laid[:2])
    packed = [np.searchsorted((c.COUNTS[1:] + c.COUNTS[:-1].astype(np.int64)) / 2, v, "right").astype(np.uint8) for v in counts]
    for v in (*counts, *packed):
        v.flags.writeable = False
    want, got = (c.seen_by_others(m.code, m.bits, v, *laid) for v in ([c.COUNTS[p] for p in packed], packed))
    assert all(map(np.array_equal, want, got))
    one = c.seen_by_others(m.code, m.bits, counts, *c.lay(texts[0], np.array([0, 3000])))
    batch = pa.RecordBatch.from_arrays([pa.array([texts[0].tobytes()])], ["text"])
    segment, c.SEGMENT = c.SEGMENT, 700
    try:
        parts = [laid for *_, laid in c.segments(batch, 700)]
    finally:
        c.SEGMENT = segment
    own = [np.zeros(2048, np.uint32) for _ in m.bits]
    for s, at, _ in parts:
        c.add_counts(own, m.code, m.bits, s, at)
    found = [c.seen_by_others(m.code, m.bits, counts, *laid, own) for laid in parts]
    assert np.array_equal(np.concatenate([x[:2] for x, _, _ in found], 1), one[0][:2]) and np.array_equal(np.concatenate([bit for *_, bit in found]), one[2])


def small_mixer(rng):
    from lamina.llm import context_mixing as c

    code = c.Code(rng.integers(0, 1 << 16, 500), rng.integers(97, 110, 500), rng.integers(1, 50, 500), least=8)
    bits = (10,) * c.INPUTS
    return c.Mixer(code, bits, [rng.integers(-60, 60, 1024).astype(np.int8) for _ in bits], rng.integers(0, 4, 1024).astype(np.uint8), rng.normal(0.3, 0.1, (1024, c.INPUTS)).astype(np.float32))


def test_mixer_by_a_loop():
    """Mixing and online refinement of several texts at once against one decision after the other."""
    from lamina.llm import context_mixing as c

    rng = np.random.default_rng(6)
    m = small_mixer(rng)
    texts = [rng.integers(97, 112, n).astype(np.uint8) for n in (900, 3, 0, 2000)]
    s, at, offs = c.lay(np.concatenate(texts), np.cumsum([0, *map(len, texts)]))
    got = m.log2_loss(s, at, offs, np.zeros((4, c.INPUTS), np.float32))
    rank, ctx = m.code.ranks_of(s, at), c.contexts(s)
    for t in range(4):
        loss, n, delta, grad = 0.0, 0, np.zeros(c.INPUTS), np.zeros(c.INPUTS)
        for p in range(offs[t], offs[t + 1]):
            for d in range(m.code.first[rank[p]], m.code.first[rank[p]] + m.code.length[rank[p]]):
                node, y = int(m.code.node[d]), 2.0 * m.code.bit[d] - 1
                slot = [(int(ctx[k][at[p]]) >> 22) ^ node for k in range(c.INPUTS)]
                x = np.array([float(m.odds[k][slot[k]]) / c.UNIT for k in range(c.INPUTS)])
                z = y * (m.weight[node * 4 + int(m.level[slot[-1]])] + delta) @ x
                loss += np.log2(1 + np.exp(-z))
                grad += y / (1 + np.exp(z)) * x
                n += 1
                if n % c.BLOCK == 0:
                    delta, grad = np.clip(delta + c.RATE / np.sqrt(c.BLOCK) * grad, -2, 2), np.zeros(c.INPUTS)
        assert got[t] == pytest.approx(loss, rel=1e-4)


def test_mixer_probabilities_add_up():
    """Over all next symbols after a text, the mixer's probabilities add up to 1; a long text in segments costs what it costs at once."""
    from lamina.llm import context_mixing as c

    rng = np.random.default_rng(5)
    m = small_mixer(rng)
    zero = lambda: np.zeros((1, c.INPUTS), np.float32)
    head = np.frombuffer(b"hi t", np.uint8)
    alone = m.log2_loss(*c.lay(head, np.array([0, 4]), end=False), zero())[0]
    loss = []
    for x in range(256):  # the last symbol is the end mark or any byte that lower-casing leaves as it is
        s, at, _ = c.lay(head, np.array([0, 4]))
        s[-1] = x
        loss.append(m.log2_loss(s, at, np.array([0, 5]), zero())[0])
    assert np.exp2(alone - np.array(loss)).sum() == pytest.approx(1, abs=1e-4)
    import pyarrow as pa

    text = bytes(rng.integers(97, 110, 3000).astype(np.uint8))
    batch = pa.RecordBatch.from_arrays([pa.array([text])], ["text"])
    whole = [laid for *_, laid in c.segments(batch, c.SEGMENT)]
    segment, c.SEGMENT = c.SEGMENT, 700
    try:
        parts = [laid for *_, laid in c.segments(batch, 700)]
    finally:
        c.SEGMENT = segment
    assert len(whole) == 1 and len(parts) == 5 and sum(len(at) for _, at, _ in parts) == 3001
    for k in range(2):  # contexts of bytes do not notice a segment's edge
        joined = np.concatenate([c.contexts(s)[k][at] for s, at, _ in parts])
        assert np.array_equal(joined, c.contexts(whole[0][0])[k][whole[0][1]])
