"""Exact deduplication: group by a 128-bit content hash, keep one stable id, compare bytes inside groups.

Rows are first reduced to (id, hash, digest); only texts of hashes that occur more than once are read again, and are
compared through min(text) = max(text), first per hash and salt of the id, then per hash, so that a hash held by a third
of all rows is spread over SALTS tasks. Rows of a hash whose texts differ (a collision) are grouped by the text itself.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import keep, lower_ascii


SALTS = 32


def normal(text: Column) -> Column:
    """Texts are equal when identical after lower-casing A-Z; null counts as empty."""
    return lower_ascii(F.coalesce(text, F.lit("")))


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", largest: bool = False, content_hash: Callable[[Column], Column] = F.md5) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256.

    keep_id is the group's smallest id (largest=True: largest). Null text equals empty text. A repeated row counts in
    group_size and comes back as often as it was given; each copy that carries keep_id is kept. A null id is
    never preferred (all-null groups keep null ids). An empty table gives an empty table. Other columns are not read.
    """
    norm = docs.select(F.col(id_col).alias("id"), normal(F.col(text_col)).alias("norm"))
    marks = keep(norm.select("id", content_hash(F.col("norm")).alias("h"), F.sha2("norm", 256).alias("text_sha256")))
    best = F.max("id") if largest else F.min("id")
    many = keep(marks.groupBy("h").agg(F.count(F.lit(1)).alias("group_size"), best.alias("keep_id")).where("group_size > 1"))
    salted = norm.select("id", content_hash(F.col("norm")).alias("h"), "norm", F.pmod(F.xxhash64("id"), F.lit(SALTS)).alias("salt"))
    often = many.select("h", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)).cast("array<bigint>")).alias("salt"))
    again = salted.join(often.hint("merge"), ["h", "salt"], "left_semi")  # the same plan at every size
    ends = again.groupBy("h", "salt").agg(F.min("norm").alias("lo"), F.max("norm").alias("hi"))
    differ = keep(ends.groupBy("h").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).where("lo <> hi").select("h"))
    groups = marks.join(many, "h", "left").select(
        "id", "h", F.coalesce("keep_id", "id").alias("keep_id"), F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"), "text_sha256"
    )
    if differ.limit(1).count():
        torn = again.join(differ, "h", "left_semi").select("id", "norm")
        sizes = torn.groupBy("norm").agg(F.count(F.lit(1)).alias("group_size"), best.alias("keep_id"))
        mended = torn.join(sizes, "norm").select("id", F.lit(None).cast("string").alias("h"), "keep_id", "group_size", F.sha2("norm", 256).alias("text_sha256"))
        groups = groups.join(differ, "h", "left_anti").unionByName(mended)
    return groups.select(F.col("id").alias(id_col), "keep_id", "group_size", F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", largest: bool = False) -> DataFrame:
    """The rows of docs that stay, with all their columns whatever their names: one for each distinct text.

    Of rows that share the text and the id that stays (repeated rows, null ids) the one of the smallest original text is
    taken. Rows that share an id but not the text are judged each by its own text.
    """
    groups = keep(exact_groups(docs, id_col, text_col, largest))
    stay = groups.where("kept").groupBy(F.col(id_col).alias("stay_id"), F.col("text_sha256").alias("stay_text")).agg(F.count(F.lit(1)).alias("n"))
    stay = keep(stay)
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), docs[id_col].alias("id"), docs[text_col].alias("text"), F.sha2(normal(docs[text_col]), 256).alias("sha"))
    rows = rows.join(stay.hint("merge"), rows["id"].eqNullSafe(stay["stay_id"]) & (rows["sha"] == stay["stay_text"]), "left_semi")
    if stay.where("n > 1").limit(1).count():
        rows = rows.groupBy("id", "sha").agg(F.min_by("row", F.struct(F.col("text").isNull(), "text")).alias("row"))
    return rows.select("row.*")
