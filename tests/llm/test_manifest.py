"""The manifest against a loop over dictionaries of lists."""

import hashlib
import zlib

import duckdb

from cases import SCHEMA, empty, frame
from lamina.llm import merkle_manifest, queries


def sha(s: str) -> str:
    return hashlib.sha256(s.encode()).hexdigest()


def leaf(values) -> str:
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def tree(nodes: list[str]) -> tuple[str, list[list[tuple[str, str]]]]:
    """Root, and for each node its left and right siblings from the leaves upwards."""
    where, paths = list(range(len(nodes))), [[] for _ in nodes]
    while len(nodes) > 1:
        for k, at in enumerate(where):
            first = at - at % 3
            paths[k].append(("".join(nodes[first:at]), "".join(nodes[at + 1 : first + 3])))
            where[k] = at // 3
        nodes = [sha("".join(nodes[i : i + 3])) for i in range(0, len(nodes), 3)]
    return nodes[0], paths


def expected(rows) -> list[tuple]:
    """(id, leaf, subroot, root, proof_sha256, folded_root) of rows (doc_id, text, lang, source, n_chars, ...)."""
    groups = {}
    for i, text, lang, source, n, *_ in rows:
        even = i is not None and zlib.crc32(str(i).encode()) % 2 == 0
        cut = text.replace("\n", "") if text is not None and even else text
        groups.setdefault(source, []).append(((i is not None, i or 0), leaf((i, source, lang, n, text)), leaf((i, source, lang, n, cut)), i))
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: tree([x[1] for x in sorted(groups[s])]) for s in names}
    root, tops = tree([trees[s][0] for s in names])
    out = []
    for s, top in zip(names, tops):
        for (_, node, seen, i), path in zip(sorted(groups[s]), trees[s][1]):
            folded = seen
            for left, right in path + top:
                folded = sha(left + folded + right)
            out.append((i, node, trees[s][0], root, sha("".join(a + b for a, b in path + top)), folded))
    return sorted(out, key=str)


def manifest(spark, docs, tmp_path):
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    rows = queries.op11_merkle_manifest(spark, str(tmp_path)).collect()
    assert all(r.verified == (r.folded_root == r.root) for r in rows)
    return sorted(((r.doc_id, r.leaf, r.subroot, r.root, r.proof_sha256, r.folded_root) for r in rows), key=str)


def test_hard_cases(spark, tmp_path):
    docs = frame(spark).unionByName(spark.createDataFrame([(None, "no id\n", "en", "src1", None, None, None, None), (None, None, None, None, None, None, None, None)], SCHEMA))
    assert manifest(spark, docs, tmp_path) == expected([tuple(r) for r in docs.collect()])


def test_several_rounds_and_a_hot_group(spark, tmp_path):
    rows = [(i * 7 % 2003, f"text {i}\nmore", "en", "hot" if i % 3 else f"s{i % 40}", i, "h", 1, 2) for i in range(2003)]
    got = manifest(spark, spark.createDataFrame(rows, SCHEMA), tmp_path)
    assert got == expected(rows)
    assert {r[5] == r[3] for r in got} == {True, False}


def test_every_height(spark, tmp_path):
    for n in (1, 2, 3, 4, 9, 10, 243, 244, 730):
        rows = [(i, f"t{i}\n", None, "one", i, "h", 1, 2) for i in range(n)]
        (tmp_path / str(n)).mkdir()
        assert manifest(spark, spark.createDataFrame(rows, SCHEMA), tmp_path / str(n)) == expected(rows)


def test_many_groups(spark, tmp_path):
    rows = [(i, "t", None, f"g{i}", i, "h", 1, 2) for i in range(300)]
    assert manifest(spark, spark.createDataFrame(rows, SCHEMA), tmp_path) == expected(rows)


def test_empty(spark, tmp_path):
    assert manifest(spark, empty(spark), tmp_path) == []


def test_proof_and_unchanged(spark):
    rows = merkle_manifest.manifest(frame(spark)).collect()
    assert all(r.verified and sha(r.proof) == r.proof_sha256 for r in rows)


def test_sql(spark):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{sf}/documents.parquet'")
    rel = con.sql(queries.ORACLE["op11_merkle_manifest"])
    df = queries.op11_merkle_manifest(spark, sf).select(*rel.columns)
    assert sorted(tuple(r) for r in df.collect()) == sorted(rel.fetchall())
