"""Native operators against brute force on a small fixture and on the small tables."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from cases import empty, frame, rows
from pyspark.sql import functions as F

from lamina.llm import exact_dedup, kd_shards, license_scan, mixing, quality_rules
from lamina.llm.common import components, table

SF = "/root/testdata/sf0.001"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WHITE = r"[^\x20\x09-\x0D]+"


@pytest.fixture(params=["cases", "table"])
def docs(spark, request):
    return frame(spark) if request.param == "cases" else table(spark, SF, "documents")


def test_exact_groups(docs):
    data = [(r.doc_id, (r.text or "").translate(LOWER)) for r in docs.select("doc_id", "text").collect()]
    groups = defaultdict(list)
    for i, t in data:
        groups[t].append(i)
    want = sorted((i, max(groups[t]), len(groups[t]), i == max(groups[t]), hashlib.sha256(t.encode()).hexdigest()) for i, t in data)
    for h in (F.md5, lambda c: F.substring(F.md5(c), 1, 1)):  # a weak hash makes collisions
        assert sorted(map(tuple, exact_dedup.exact_groups(docs, largest=True, content_hash=h).collect())) == want
    assert exact_dedup.drop_copies(docs).count() == len(groups)


def test_quality_statistics(docs):
    data = docs.select("doc_id", "text").collect()
    want = []
    for i, t in ((r.doc_id, r.text or "") for r in data):
        w = re.findall(WHITE, t)
        lines = [x for x in t.split("\n") if re.search(WHITE, x)]
        tri = Counter(zip(w, w[1:], w[2:]))
        hit = {p + k for p in range(len(w) - 2) if tri[tuple(w[p : p + 3])] > 1 for k in range(3)}
        want.append((i, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(hit)))
    got = quality_rules.statistics(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_quality_rules_hold_out(spark):
    docs, labels = table(spark, "/root/testdata/sf0.01", "documents"), table(spark, "/root/testdata/sf0.01", "labels")
    out = quality_rules.judge(docs, labels).join(labels, "doc_id").where("not base_failed").groupBy("quality", "kept").count().collect()
    n = {(r["quality"], r["kept"]): r["count"] for r in out}
    assert n.get((1, False), 0) <= 0.02 * n[(1, True)]
    assert n.get((0, True), 0) <= 0.5 * n.get((0, False), 1)
    assert quality_rules.judge(empty(spark), labels).count() == 0
    assert quality_rules.judge(frame(spark), labels.limit(0)).count() == len(rows())


def test_license_scan(docs):
    data = docs.select("doc_id", "text").collect()
    got = {(r.doc_id, r.n_words): r for r in license_scan.scan(docs).collect()}
    for r in data:
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (r.text or "").translate(LOWER))
        places = [(k, x) for p, x in license_scan.BASE.items() for k in range(len(w)) if w[k : k + len(p.split())] == p.split()]
        g = got[(r.doc_id, len(w))]
        assert (g.n_base, g.first_word, g.last_word) == (len(places), min((k for k, _ in places), default=None), max((k for k, _ in places), default=None))
        assert g.base_labels == ",".join(sorted({x for _, x in places}))
        assert {x for _, x in places} <= set(g.labels.split(",")) and 0 <= g.score <= 1
        for a in g.detections:
            for b in g.detections:
                assert a is b or not (b.s <= a.s and a.e <= b.e)


def test_license_rules(spark):
    assert len(license_scan.rules()) > 200
    for r in license_scan.rules():
        re.compile(r.pattern)
    cases = {
        "SPDX-License-Identifier: GPL-3.0-only": "gpl",
        "Licensed under CC BY-NC 4.0.": "cc-by-nc",
        "This work is licensed under the GNU General Public License, version 3.": "gpl",
        "the GNU Lesser General Public License v2.1": "gpl,lgpl",
        "Licensed under the Apache License, Version 2.0.": "apache",
        "The BSD 3-Clause License, all rights reserved": "all-rights-reserved,bsd",
        "nothing here": "",
    }
    out = license_scan.scan(spark.createDataFrame(list(enumerate(cases)), "doc_id long, text string")).collect()
    got = {r.doc_id: r.labels for r in out}
    assert [got[i] for i in range(len(cases))] == list(cases.values())


def sentences(pattern, n, rnd):
    """The shortest text that a rule's pattern matches, and n others at random."""
    from re import _parser

    def say(nodes, pick):
        out = ""
        for kind, x in nodes:
            kind = str(kind)
            if kind == "LITERAL":
                out += chr(x)
            elif kind == "IN":
                one = pick(x)
                out += chr(one[1] if str(one[0]) == "LITERAL" else pick(range(one[1][0], one[1][1] + 1)))
            elif kind == "BRANCH":
                out += say(pick(x[1]), pick)
            elif kind == "SUBPATTERN":
                out += say(x[3], pick)
            else:
                assert kind == "MAX_REPEAT" and x[:2] == (0, 1)
                out += say(x[2], pick) if pick((False, True)) else ""
        return out

    tree = _parser.parse(pattern)
    return [say(tree, lambda a: a[0])] + [say(tree, rnd.choice) for _ in range(n)]


def test_license_prefilter_loses_nothing(spark):
    """The scan of sentences planted for each rule, against all rules without any prefilter."""
    rnd = random.Random(7)
    table_ = license_scan.rules()
    texts = [f"so {t} it is" for r in table_ for t in sentences(r.pattern, 3, rnd)]
    texts += ["Redistribution and use in source and binary forms, with or without modification, are permitted", "Released under MIT.", "licensed under Creative Commons Attribution 4.0", "released into the public domain"]
    whole = [re.compile(f" (?:{r.pattern})(?= )") for r in table_]
    want = {}
    for i, t in enumerate(texts):
        norm = " " + " ".join(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t.translate(LOWER))) + " "
        hits = sorted((norm[: m.start()].count(" "), -norm[: m.end()].count(" "), k) for k, p in enumerate(whole) for m in p.finditer(norm))
        want[i] = [(k, s, -e) for j, (s, e, k) in enumerate(hits) if not any(-y >= -e for _, y, _ in hits[:j])]
    assert all(want.values())
    got = {r.doc_id: [(x.rule, x.s, x.e) for x in r.detections] for r in license_scan.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert [texts[i] for i in want if got[i] != want[i]] == []


def test_mix(docs):
    data = docs.select("doc_id", "text", "source").collect()
    size = defaultdict(int)
    for r in data:
        size[r.source] += len(re.findall(WHITE, r.text or ""))
    names = sorted(size, key=lambda s: (s is None, s or ""))
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    total, target, free = sum(size.values()), {}, set(names)
    while free:
        left, w = total - sum(target.values()), sum(weight[s] for s in free)
        over = {s for s in free if left * weight[s] / w > 3 * size[s]}
        if not over:
            target |= {s: left * weight[s] / w for s in free}
            break
        target |= {s: 3.0 * size[s] for s in over}
        free -= over
    got = mixing.mix(docs).collect()
    assert len(got) == len(data) and sorted(map(str, got)) == sorted(map(str, mixing.mix(docs.repartition(5)).collect()))
    took = Counter()
    for r in got:
        assert abs(r.target - target[r.source]) < 1e-6 * total and 0 <= r.taken <= 3 * r["size"] and r.source_size == size[r.source] and 0 <= r.position <= 1
        took[r.source] += r.taken
    assert all(abs(took[s] - target[s]) <= 0.51 for s in names)
    assert mixing.schedule(docs).columns == docs.columns


def test_mix_follows_its_schedule(docs):
    """Words taken come phase by phase from the sources' integrated schedules; a word by word walk over each stream finds the same."""
    rows = defaultdict(list)
    for r in mixing.mix(docs).collect():
        rows[r.source].append(r)
    assert len(rows) > 1
    half_up = lambda x: int(x + 0.5)
    for part in rows.values():
        b, target, took = 0.8 * (part[0].weight - 2), part[0].target, Counter()
        stream = [i for i, r in sorted(enumerate(part), key=lambda x: x[1].offset) for _ in range(r["size"])]
        ends = [half_up(target * ((1 - b) * (p / 8) + b * (p / 8) ** 2)) for p in range(8)] + [half_up(target)]
        for p in range(8):
            for w in range(ends[p], ends[p + 1]):
                took[stream[w % len(stream)], p] += 1
        for i, r in enumerate(part):
            assert r.phases == [took[i, p] for p in range(8)] and r.taken == sum(r.phases)


@pytest.mark.parametrize("shards", [1, 7, 40])
def test_shards(docs, shards):
    data = docs.select("doc_id", "text").collect()
    got = kd_shards.kd_shards(docs, shards).collect()
    assert sorted((r.doc_id, r["size"], r.text_crc32) for r in got) == sorted((r.doc_id, len((r.text or "").encode()) + 16, zlib.crc32((r.text or "").encode())) for r in data)
    slots, weight = defaultdict(list), Counter()
    for r in got:
        slots[r.shard].append(r.slot)
        weight[r.shard] += r["size"]
    assert all(sorted(v) == list(range(len(v))) for v in slots.values()) and set(slots) <= set(range(shards))
    largest = max(r["size"] for r in got)
    assert all(abs(w - sum(weight.values()) / shards) <= 3 * largest for w in weight.values())


def test_shards_keep_small_groups_and_cut_a_hot_one(spark):
    data = [(i, f"text {i // 3} " + "pad " * (i // 3 % 40), f"s{i % 5}") for i in range(6000)] + [(10_000 + i, "the same", f"s{i % 5}") for i in range(9000)]
    docs = spark.createDataFrame(data, "doc_id long, text string, source string")
    got = kd_shards.kd_shards(docs, 10).collect()
    where, weight = defaultdict(set), Counter()
    for r in got:
        where[r.text_crc32, r["size"]].add(r.shard)
        weight[r.shard] += r["size"]
    assert sum(len(v) > 1 for v in where.values()) == 1
    share = sum(weight.values()) / 10
    assert len(weight) == 10 and all(abs(w - share) <= 0.05 * share for w in weight.values())


def test_empty(spark):
    for f in (exact_dedup.exact_groups, exact_dedup.drop_copies, mixing.mix, mixing.schedule, kd_shards.kd_shards, license_scan.scan, quality_rules.statistics):
        assert f(empty(spark)).count() == 0


def test_components(spark):
    links = [(i, i + 1) for i in range(100, 160)] + [(3, 7), (7, 3), (9, 3), (5, 5), (None, 1)]
    got = dict(map(tuple, components(spark.createDataFrame(links, "a long, b long")).collect()))
    assert got == {i: 100 for i in range(100, 161)} | {3: 3, 7: 3, 9: 3}


def test_rows_are_judged_by_their_own_text(spark):
    """Null and reused ids, rows that differ in case, and columns with the names that the operators use."""
    names = "doc_id long, text string, source string, epoch int, h string, salt int, row string, position double, size long, id long, sha string"
    data = [(None, "A b", "s"), (None, "a B", "s"), (None, "c d", "s"), (1, "x y", "s"), (1, "other text", "s"), (2, "X Y", "s"), (3, None, "s"), (3, None, "s"), (4, "", None)]
    docs = spark.createDataFrame([(*r, 1, "h", 2, "r", 0.5, 3, 4, "z") for r in data], names)
    out = exact_dedup.drop_copies(docs, largest=True)
    assert out.columns == docs.columns
    assert sorted(((r.text or "").lower(), r.doc_id) for r in out.collect()) == [("", 4), ("a b", None), ("c d", None), ("other text", 1), ("x y", 2)]
    back = mixing.schedule(docs)
    assert back.columns == docs.columns
    assert {r.text for r in back.collect()} <= {t for _, t, _ in data} and back.where("doc_id is null").select("text").distinct().count() == 3


def tree_by_sorting(rows, shards, whole=0.01):
    """Shard of each row of measured(), by sorting each node's rows: what kd_shards finds with histograms."""
    out, total = {}, sum(r["size"] for r in rows)

    def cut(part, n, first):
        if n == 1 or not part:
            out.update({(r.doc_id, r.text_crc32): first for r in part})
            return
        dims = list(kd_shards.DIMENSIONS)
        dim = max(dims, key=lambda c: (max(r[c] for r in part) - min(r[c] for r in part), -dims.index(c)))
        weight, want = {}, sum(r["size"] for r in part) * (n // 2) / n
        for r in part:
            weight[r[dim], r.y] = weight.get((r[dim], r.y), 0) + r["size"]
        below = 0
        for cell in sorted(weight):
            if below + weight[cell] >= want:
                break
            below += weight[cell]
        rest, z = want - below, -1
        if weight[cell] > whole * total / shards:
            upto = 0
            for r in sorted((r for r in part if (r[dim], r.y) == cell), key=lambda r: r.tie >> 24):
                upto, z = upto + r["size"], r.tie >> 24
                if upto >= rest:
                    break
        elif 2 * rest >= weight[cell]:
            z = 1 << 16
        low = lambda r: (r[dim], r.y) < cell or ((r[dim], r.y) == cell and r.tie >> 24 <= z)
        cut([r for r in part if low(r)], n // 2, first)
        cut([r for r in part if not low(r)], n - n // 2, first + n // 2)

    cut(rows, shards, 0)
    return out


@pytest.mark.parametrize("shards, whole", [(7, 0.01), (7, 2.0), (16, 0.5)])
def test_shards_by_sorting(spark, shards, whole):
    docs = table(spark, SF, "documents")
    want = tree_by_sorting(kd_shards.measured(docs).collect(), shards, whole)
    assert {(r.doc_id, r.text_crc32): r.shard for r in kd_shards.kd_shards(docs, shards, whole=whole).collect()} == want
    assert len(set(want.values())) == shards


def statistics_rows(spark, bad):
    """400 rows of two statistics on a grid, the others constant; bad(a, b, n) labels them."""
    rest = [c for c in quality_rules.TESTED if c not in ("mean_word", "symbol_share")]
    rows = [(n, float(n % 20 + 1), float(n // 20 + 1) / 20, *[1.0] * len(rest), bad(n % 20 + 1, n // 20 + 1, n)) for n in range(400)]
    return spark.createDataFrame(rows, ", ".join(["doc_id long", "mean_word double", "symbol_share double", *[f"{c} double" for c in rest], "bad boolean"]))


def test_rules_grow_a_conjunction(spark):
    rows = statistics_rows(spark, lambda a, b, n: a >= 13 and b >= 11)
    rules = quality_rules.learn(rows)
    assert rules and {x.name for x in rules[0]} == {"mean_word", "symbol_share"} and all(x.at_least for x in rules[0])
    hit = {r.doc_id for r in rows.withColumn("f", quality_rules.verdict(rules)).where("f is not null").select("doc_id").collect()}
    bad = {r.doc_id for r in rows.where("bad").collect()}
    assert len(hit & bad) >= 0.8 * len(bad) and len(hit - bad) <= 0.03 * len(hit)


def test_rules_are_pruned_and_ordered(spark):
    # One row in 40 above the cut is good, on the rows to grow on only: a second literal would fit them and not pay on the others.
    crc = {r.doc_id: r.c for r in spark.range(400).select(F.col("id").alias("doc_id"), (F.crc32(F.col("id").cast("string").cast("binary")) % 3).alias("c")).collect()}
    rows = statistics_rows(spark, lambda a, b, n: a >= 13 and not (crc[n] and n % 40 == 13))
    rules = quality_rules.learn(rows, precision=0.95)
    assert rules and [x.name for x in rules[0]] == ["mean_word"]
    two = [(quality_rules.Literal("mean_word", True, 13.0),), (quality_rules.Literal("symbol_share", False, 0.5),)]
    for r in rows.withColumn("f", quality_rules.verdict(two)).collect():
        assert r.f == (1 if r.mean_word >= 13 else 2 if r.symbol_share < 0.5 else None)


def test_rules_need_labels_and_evidence(spark):
    none = statistics_rows(spark, lambda a, b, n: None)
    assert quality_rules.learn(none) == [] and quality_rules.learn(none.limit(0)) == []
    assert quality_rules.learn(statistics_rows(spark, lambda a, b, n: False)) == []
    few = statistics_rows(spark, lambda a, b, n: a >= 4).where("doc_id < 10")  # seven bad rows
    assert quality_rules.learn(few, least=8) == [] and len(quality_rules.learn(few, least=5)) == 1


def test_mix_places_repeats(docs):
    """Each epoch that takes words of a document has a training position of its own: the one at which the source's schedule reaches that place."""
    repeats = 0
    for r in mixing.mix(docs).collect():
        b, goal = 0.8 * (r.weight - 2), int(r.target + 0.5)
        starts = [r.offset + k * r.source_size for k in range(3) if r["size"] and r.offset + k * r.source_size < goal]
        assert [p.copy for p in r.places] == list(range(len(starts))) and bool(r.places) == (r.taken > 0)
        for p, start in zip(r.places, starts):
            assert abs((1 - b) * p.position + b * p.position**2 - min(1, start / r.target)) < 1e-9
        repeats += len(starts) > 1
        assert not r.places or r.places[0].position == r.position
    assert repeats
