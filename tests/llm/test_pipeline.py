"""The stages of corpus_pipeline.py on a small table: each stage's decisions against brute force on its own input."""

import re
import time
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from cases import empty, frame
from lamina.llm import jaccard_join, mixing, queries, toxicity_fm
from lamina.llm.common import CLEAN, keep, scratch, table
from test_text_models import groups

SF = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = table(spark, SF, "documents")
    kept = {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs.collect()
        out = stage(spark, docs, SF)
        out.write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        after = kept[name] = docs.collect()
        if name != "sentencepiece":
            assert docs.columns == table(spark, SF, "documents").columns
        if name == "toxicity":
            machine = queries.toxicity_machine(table(spark, SF, "documents"), table(spark, SF, "labels"))
            low = {r.doc_id for r in toxicity_fm.score(table(spark, SF, "documents"), machine).where("score < 0.7").collect()}
            assert {r.doc_id for r in after} == low
        if name == "exact_dedup":
            best = {}
            for r in before:
                key = re.sub("[A-Z]", lambda m: m[0].lower(), r.text or "")
                best[key] = max(best.get(key, -1), r.doc_id)
            assert sorted(r.doc_id for r in after) == sorted(best.values())
        if name == "ngram_jaccard":
            assert sorted(r.doc_id for r in after) == sorted(i for i, _, g in groups([(r.doc_id, r.text) for r in before]) if i == g)
        if name == "mixing":
            copies = {r.doc_id: (round(r.taken / r["size"]) if r["size"] else 1) for r in mixing.mix(spark.read.parquet(f"{tmp_path}/{k - 1}")).collect()}
            got = Counter(r.doc_id for r in after)
            assert all(abs(got[i] - n) <= 1 for i, n in copies.items()) and all(n <= 3 for n in got.values())
            assert {r for r in after} <= set(before)
        if name == "sentencepiece":
            assert len(after) == len(before) and all(r.round_trip for r in after)


def drop_similar_rows(spark, rows, schema="doc_id long, text string, text_hash long, key string, row long, m string"):
    df = spark.createDataFrame([(*r, 1, "k", 2, "m") for r in rows], schema)
    out = jaccard_join.drop_similar(df)
    assert out.columns == df.columns
    return sorted(((r.doc_id, r.text) for r in out.collect()), key=str)


def test_drop_similar_judges_rows(spark):
    """Reused and null ids, repeated rows, clashing names: texts go or stay by themselves."""
    base = " ".join(f"w{i}" for i in range(60))
    near, other, third = base + " end", " ".join(f"x{i}" for i in range(40)), " ".join(f"y{i}" for i in range(40))
    rows = [(1, base), (5, near), (5, other), (7, None), (7, None), (8, ""), (None, third), (None, third), (None, third + " z"), (None, None), (3, third + " t"), (9, "short text"), (9, "short text")]
    want = [(1, base), (5, other), (7, None), (8, ""), (None, None), (3, third + " t"), (9, "short text")]
    assert drop_similar_rows(spark, rows) == sorted(want, key=str)
    assert drop_similar_rows(spark, []) == []
    assert drop_similar_rows(spark, [(None, base), (None, near)]) in ([(None, base)], [(None, near)])


def test_order_of_training_survives_storage(spark, tmp_path):
    docs = table(spark, "/root/testdata/sf0.01", "documents").repartition(12, "text")
    mixed = mixing.schedule(docs)
    mixed.write.parquet(f"{tmp_path}/mixed")
    read = spark.read.parquet(f"{tmp_path}/mixed")
    out = [(p.position, r.row.doc_id, p.copy) for r in mixing.in_order(read).collect() for p in r.places]
    assert [i for _, i, _ in sorted(out)] == [r.doc_id for r in mixed.collect()]
    encoded = corpus_pipeline.encode_pieces(spark, read, "").select("doc_id", "position", "copy").collect()
    assert sorted((r.position, r.doc_id, r.copy) for r in encoded) == sorted(out)


def test_disk_of_a_stage(spark):
    """Shuffle files go with the table that they were for; the mix sends texts once to be told apart and joined, once to be ordered."""
    files = lambda: {f for f in spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString(" ").split() if "shuffle_" in f}
    before = files()
    kept = keep(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count())
    for _ in range(20):  # files go in the background
        time.sleep(0.1 * bool(files() - before))
    assert not files() - before and kept.count() == 7 and spark.conf.get(CLEAN) == "false"
    docs = table(spark, SF, "documents")
    exchanges = lambda df: df._jdf.queryExecution().executedPlan().toString().count("Exchange ")
    mixed = mixing.schedule(docs)
    assert exchanges(mixed) == 3 and exchanges(mixing.in_order(docs)) == 2  # rows, their places, the order


@pytest.mark.parametrize("buckets", [1, 5, 400])
def test_shared_counts_by_brute_force(spark, buckets):
    """Small blocks, many and few buckets, reused ids: each row's shingles that another row has too."""
    rows = [(i % 50, f"{' '.join(f'w{(i * i + k) % 97}' for k in range(5 + i % 9))} u{i}") for i in range(60)] + [(3, "w1 w2 w3 w4 w5 w6"), (9, None)]
    sets = [(i, set(zip(*[(w := (t or "").split())[k:] for k in range(5)]))) for i, t in rows]
    seen, want = Counter(x for _, s in sets for x in s), Counter()
    for i, s in sets:
        want[i] += sum(seen[x] > 1 for x in s)
    got = jaccard_join.shared_counts(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), 5, buckets, 200)
    assert dict(map(tuple, got.collect())) == {i: n for i, n in want.items() if n}


@pytest.mark.parametrize("rows", ["hard", "none"])
def test_run_on_hard_rows(spark, tmp_path, rows):
    """Null, empty and very long texts, ties, repeated rows, null and reused ids, extra columns of clashing names, an empty table."""
    docs = empty(spark) if rows == "none" else frame(spark)
    if rows == "hard":
        more = [(None, "no id", None, None, None, "h", 1, 9), (4, "another text of a reused id", "en", "src1", 3, "h", 1, 9), (900, "so it goes on " * 750_000, "en", "src1", 9, "h", 1, 9)]
        docs = docs.unionByName(spark.createDataFrame(more, docs.schema))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{SF}/labels.parquet").write.parquet(f"{tmp_path}/labels.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path)).select("doc_id", "n_ids", "round_trip", "position", "copy").collect()
    if rows == "none":
        assert out == []
        return
    assert all(r.round_trip in (True, None) for r in out)
    ids = {r.doc_id for r in out}
    assert {None, 4} <= ids and (900 in ids)
    assert len({(r.position, r.doc_id, r.copy, r.n_ids) for r in out}) == len(out)


@pytest.mark.parametrize("passes", [2, 5])
def test_shared_counts_in_turns(spark, passes):
    """Turns over the buckets add up to the counts of one turn."""
    rows = [(i % 50, f"{' '.join(f'w{(i * i + k) % 97}' for k in range(5 + i % 9))} u{i}") for i in range(60)] + [(3, "w1 w2 w3 w4 w5 w6"), (9, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = dict(map(tuple, jaccard_join.shared_counts(docs, 5, 7, 200).collect()))
    assert want and dict(map(tuple, jaccard_join.shared_counts(docs, 5, 7, 200, passes=passes).collect())) == want


def test_near_copies_leave_no_tables(spark, monkeypatch):
    """Texts and hashes are exchanged in turns with the same groups, and tables kept on the way to the groups go."""
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    path = spark._jvm.org.apache.hadoop.fs.Path(scratch(spark))
    disk = lambda: path.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(path).getLength()
    want = sorted(r.doc_id for r in jaccard_join.drop_similar(docs).collect())
    monkeypatch.setattr(jaccard_join, "PASS", 1000)
    before, sent = disk(), []
    turn = jaccard_join._shared_in_turn
    monkeypatch.setattr(jaccard_join, "_shared_in_turn", lambda *a: sent.append(a[-1]) or turn(*a))
    assert sorted(r.doc_id for r in jaccard_join.drop_similar(docs).collect()) == want
    assert sent[:4] == [0, 1, 2, 3] and disk() - before < 150 * docs.count()  # ids, hashes and groups
