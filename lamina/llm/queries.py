"""The thin queries of the text operators over the table `documents`, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import adaptive_neighbours, context_mixing, embedding_whitening, exact_dedup, jaccard_join, kd_shards, license_scan, merkle_manifest, mixing, ppm_language, quality_rules, toxicity_fm, unigram_pieces
from .common import crc_mod, table


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = kd_shards.kd_shards(table(spark, sf_dir, "documents"), 40)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int").alias("shard"), "slot", F.lit(None).cast("int").alias("grown_shard"))


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents")).drop("detections")


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return unigram_pieces.encode(table(spark, sf_dir, "documents"))


def op4_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = crc_mod(F.col("doc_id"), 10) == 0
    out = context_mixing.score(docs, ~held)
    return out.select("doc_id", held.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", "bits_per_byte")


def op5_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.similar_groups(table(spark, sf_dir, "documents"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", F.round("target", 6).alias("target"), "taken", F.round("position", 9).alias("position"))


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"), largest=True)


def toxicity_machine(docs: DataFrame, labels: DataFrame) -> toxicity_fm.Machine:
    """The machine learned from labelled documents with crc32(id) mod 3 other than 1."""
    return toxicity_fm.fit(docs.where(crc_mod(F.col("doc_id"), 3) != 1), labels)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = toxicity_fm.score(docs, toxicity_machine(docs, table(spark, sf_dir, "labels")))
    return out.select("doc_id", (crc_mod(F.col("doc_id"), 3) == 1).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = ppm_language.identify(docs, docs.where(crc_mod(F.col("doc_id"), 4) != 2))
    return out.select("doc_id", (crc_mod(F.col("doc_id"), 4) == 2).alias("held_out"), "lang_pred", "score", "bits_per_byte")


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_rules.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule")


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    text = F.when(crc_mod(F.col("doc_id"), 2) == 0, F.replace(F.col("text"), F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    return merkle_manifest.manifest(docs, changed={"text": text}).drop("proof")


def op12_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return adaptive_neighbours.nearest(table(spark, sf_dir, "embeddings"), lambda vec_id: vec_id % 20 == 0, 20)


def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_whitening.whitened(table(spark, sf_dir, "embeddings"))


QUERIES = {
    f.__name__: f
    for f in (op1_sharding, op2_license_scan, op3_sentencepiece, op4_lm_score, op5_ngram_jaccard, op6_mixing, op7_exact_dedup, op8_toxicity, op9_language, op10_quality_rules, op11_merkle_manifest, op12_nearest_neighbours, op13_embedding_whitening)
}

ORACLE: dict[str, str] = {
    "op6_mixing": r"""
        with z as (select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint size, md5(coalesce(doc_id::varchar, '')) k from documents),
        s as (select source, sum(size)::bigint source_size, (row_number() over (order by source nulls last) - 1) % 3 + 1 as w from z group by source),
        c as (select *, sum(source_size) over () total, source_size * 3 / w ratio,
            coalesce(sum(3 * source_size) over (order by source_size * 3 / w, source nulls last rows between unbounded preceding and 1 preceding), 0) before,
            sum(w) over (order by source_size * 3 / w, source nulls last rows between current row and unbounded following) rest from s),
        f as (select (total - before) / rest as level from c where ratio >= (total - before) / rest order by ratio, source nulls last limit 1),
        t as (select source, source_size, w, least((3 * source_size)::double, level * w) target from s, f),
        o as (select z.doc_id, z.size, t.source_size, t.w, t.target, coalesce(sum(size) over (partition by z.source order by k, z.doc_id, size rows between unbounded preceding and 1 preceding), 0) as off
            from z join t on z.source is not distinct from t.source),
        p as (select *, (w - 2) * 0.8::double b, case when target > 0 then least(1.0, off / target) else 0.0 end share, case when source_size > 0 then round(target)::bigint // source_size else 0 end epochs from o)
        select doc_id, size, source_size, round(target, 6) target, (epochs * size + greatest(0, least(size, round(target)::bigint - epochs * source_size - off)))::bigint taken,
            round(case when b = 0 then share else (b - 1 + sqrt((1 - b) * (1 - b) + 4 * b * share)) / (2 * b) end, 9) as position from p
    """,
    "op7_exact_dedup": """
        with n as (select doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') t from documents),
        g as (select t, max(doc_id) keep_id, count(*) group_size from n group by t)
        select doc_id, keep_id, group_size, doc_id = keep_id as kept, sha256(n.t) as text_sha256 from n join g on n.t = g.t
    """,
    "op11_merkle_manifest": r"""
        with recursive crc(i, k, v) as (select i, 0, i from range(256) r(i) union all select i, k + 1, case when v & 1 = 1 then xor(3988292384, v >> 1) else v >> 1 end from crc where k < 8),
        tab as (select list(v order by i) l from crc where k = 8),
        c as (select *, list_reduce(list_prepend(4294967295::bigint, list_transform(string_split(doc_id::varchar, ''), lambda x: ascii(x)::bigint)), lambda a, b: xor(a >> 8, l[(xor(a, b) & 255) + 1])) % 2 = 1 as even from documents, tab),
        f as (select *, coalesce(strlen(doc_id::varchar) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(n_chars::varchar) || ':' || n_chars, '-') p,
            case when even then replace(text, chr(10), '') else text end as cut from c),
        h as (select doc_id, source, sha256(p || coalesce(strlen(text) || ':' || text, '-')) leaf, sha256(p || coalesce(strlen(cut) || ':' || cut, '-')) seen from f),
        pos as (select *, row_number() over (partition by source order by doc_id nulls first, leaf) - 1 as p from h),
        lv(source, k, nodes) as (select source, 0, list(leaf order by p) from pos group by source
            union all select source, k + 1, list_transform(range((len(nodes) + 2) // 3), lambda i: sha256(array_to_string(nodes[i * 3 + 1:i * 3 + 3], ''))) from lv where len(nodes) > 1),
        sub as (select source, nodes[1] subroot, row_number() over (order by source nulls first) - 1 as s from lv where len(nodes) = 1),
        tv(k, nodes) as (select 0, list(subroot order by s) from sub
            union all select k + 1, list_transform(range((len(nodes) + 2) // 3), lambda i: sha256(array_to_string(nodes[i * 3 + 1:i * 3 + 3], ''))) from tv where len(nodes) > 1),
        walk as (select pos.source, p, 0 tree, k, nodes, p // (3 ** k)::bigint as b from pos join lv on pos.source is not distinct from lv.source where len(nodes) > 1
            union all select pos.source, p, 1, k, nodes, s // (3 ** k)::bigint from pos join sub on pos.source is not distinct from sub.source, tv where len(nodes) > 1),
        side as (select source, p, tree, k, array_to_string(nodes[b - b % 3 + 1:b], '') l, array_to_string(nodes[b + 2:b - b % 3 + 3], '') r from walk),
        path as (select source, p, list({'l': l, 'r': r} order by tree, k) steps, string_agg(l || r, '' order by tree, k) proof from side group by source, p),
        o as (select doc_id, leaf, sub.subroot, (select nodes[1] from tv where len(nodes) = 1) root, sha256(coalesce(proof, '')) proof_sha256,
            list_reduce(list_prepend({'l': seen, 'r': ''}, coalesce(steps, [])), lambda a, x: {'l': sha256(x.l || a.l || x.r), 'r': ''}).l folded_root
            from pos join sub on pos.source is not distinct from sub.source left join path on pos.source is not distinct from path.source and pos.p = path.p)
        select *, folded_root = root as verified from o
    """,
}
