"""Mixing sources to target weights along a time-varying curriculum, in DataFrame functions only.

Each source has a target number of words. Its documents form a stream in a fixed pseudo-random order (md5 of the id),
repeated in epochs. A source's weight schedule over training time 0..1 is integrated in closed form: its cumulative
demand, in words, at any time. The words of the stream between the demands at two times are what training takes in between;
added up over all phases they are the words taken. Inverted, the demand turns a word's place in its source's stream into a
training position; range-sorting by position gives the order of training.

Running sums never run over a whole source in one task: sums of 4096 hash buckets per source are added up first, and
each bucket then starts from its own offset.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import keep

PHASES = 8  # equal stretches of training time in which a mix says what it takes
MOST = 3  # times its size that a source, and so a document, may be taken


def sizes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """id, source, size: number of runs other than \\x20 and \\x09-\\x0D in the text (null: 0), the order key, and a hash of the text."""
    size = F.coalesce(F.regexp_count(F.col(text_col), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")
    key = F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit("")))
    return docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), size.alias("size"), key.alias("key"), F.xxhash64(text_col).alias("text_hash"))


def targets(per_source: DataFrame) -> DataFrame:
    """source, source_size, weight, target from (source, source_size).

    Sources by code point (null last) weigh 1, 2, 3, repeating, and share the sum of all sizes; a target stops at MOST
    times its source's size, the excess reshared by weight. With caps sorted by cap/weight, the level at which the
    first k are capped is (total - their caps) / (weights of the others): the first k whose next cap is not below it.
    One row per source: the only windows over all rows here. A total of 0 gives targets of 0.
    """
    order = Window.orderBy(F.col("source").isNull(), "source")
    s = per_source.select("source", "source_size", (F.pmod(F.row_number().over(order) - 1, F.lit(3)) + 1).alias("weight"))
    s = s.select("*", (F.lit(MOST) * F.col("source_size")).alias("cap"))
    by = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").isNull(), "source")
    all_rows = Window.partitionBy(F.lit(0))
    s = s.select(
        "*",
        F.sum("source_size").over(all_rows).alias("total"),
        F.coalesce(F.sum("cap").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("capped_before"),
        F.sum("weight").over(by.rowsBetween(0, Window.unboundedFollowing)).alias("weight_from"),
    )
    level = (F.col("total") - F.col("capped_before")) / F.col("weight_from")
    ratio = F.col("cap") / F.col("weight")
    first = F.min(F.when(ratio >= level, F.struct(ratio.alias("r"), F.col("source").isNull().alias("none"), "source", level.alias("level"))))
    s = s.select("*", first.over(all_rows)["level"].alias("level"))
    return s.select("source", "source_size", "weight", F.least(F.col("cap").cast("double"), F.col("level") * F.col("weight")).alias("target"))


def slope(rank: Column) -> Column:
    """b of a source's schedule w(t) = 1 + b (2t - 1): from -0.8 (early sources) over 0 to 0.8 (late ones) with the source's weight."""
    return (rank - 2) * F.lit(0.8)


def demand(target: Column, rank: Column, phases: int = PHASES) -> Column:
    """Words that a source has given at the end of each phase: its target times the integrated schedule (1 - b) t + b t^2, rounded."""
    b = slope(rank)
    share = [(1 - b) * F.lit(p / phases) + b * F.lit((p / phases) ** 2) for p in range(1, phases)]
    return F.array(*[F.round(target * s).cast("long") for s in share], F.round(target).cast("long"))


def position(share: Column, rank: Column) -> Column:
    """Training time at which a source has given `share` of its target: the inverse of its integrated schedule, in closed form."""
    b = slope(rank)
    root = (b - 1 + F.sqrt((1 - b) * (1 - b) + 4 * b * share)) / F.when(b == 0, F.lit(1.0)).otherwise(2 * b)
    return F.when(b == 0, share).otherwise(root)


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """doc_id, source, size, source_size, target, offset (words of its source's stream before it), taken, position, phases, places.

    phases has the words that each phase of training takes of the document: those of its places in the stream, one an
    epoch, that lie between the source's demands at the phase's start and end. taken is their sum, repeats included; a document
    at a phase's end is taken in part. The sum over a source is its target rounded to a whole number. position is that of the
    document's first place in the stream, taken or not; places has (copy, position) of each epoch that takes words of it. Null text and null
    sources are allowed (null is a source of its own, last). Rows with equal id and source follow one another.
    An empty table gives an empty table.
    """
    d = keep(sizes(docs, id_col, text_col, source_col)).withColumn("bucket", F.substring("key", 1, 3))
    d = d.withColumn("src", F.struct(F.col("source").isNull().alias("none"), F.coalesce("source", F.lit("")).alias("name")))
    sums = keep(d.groupBy("src", "bucket").agg(F.sum("size").alias("words"), F.max("source").alias("source")))
    before = F.coalesce(F.sum("words").over(Window.partitionBy("src").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sums.select("src", "bucket", before.alias("before"))
    goal = targets(sums.groupBy("src").agg(F.sum("words").alias("source_size"), F.max("source").alias("source")).drop("src"))
    goal = goal.select(F.struct(F.col("source").isNull().alias("none"), F.coalesce("source", F.lit("")).alias("name")).alias("src"), "source_size", "weight", "target", demand(F.col("target"), F.col("weight")).alias("demand"))
    inside = Window.partitionBy("src", "bucket").orderBy("key", "doc_id", "size", "text_hash").rowsBetween(Window.unboundedPreceding, -1)
    d = d.withColumn("inner", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    d = d.join(starts, ["src", "bucket"]).join(goal, "src")
    d = d.withColumn("offset", F.col("before") + F.col("inner"))
    epoch = F.greatest(F.col("source_size"), F.lit(1))

    def given(words: Column) -> Column:  # words of the document among the stream's first ones: whole epochs, then the last one's
        rest = words % epoch
        return (words - rest) / epoch * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), rest - F.col("offset")))

    until = F.transform("demand", lambda w: given(w).cast("long"))
    d = d.withColumn("until", until).withColumn("phases", F.zip_with("until", F.concat(F.array(F.lit(0).cast("long")), F.slice("until", 1, PHASES - 1)), lambda a, b: a - b))
    taken = F.aggregate("phases", F.lit(0).cast("long"), lambda s, x: s + x)
    share = F.when(F.col("target") > 0, F.least(F.lit(1.0), F.col("offset") / F.col("target"))).otherwise(F.lit(0.0))

    def place(copy: int) -> Column:
        start = F.col("offset") + copy * F.col("source_size")
        at = position(F.least(F.lit(1.0), start / F.col("target")), F.col("weight"))
        return F.when((F.col("size") > 0) & (start < F.round("target")), F.struct(F.lit(copy).alias("copy"), at.alias("position")))

    places = F.array_compact(F.array(*[place(copy) for copy in range(MOST)]))
    return d.select("doc_id", "source", "size", "source_size", "target", "offset", taken.cast("long").alias("taken"), position(share, F.col("weight")).alias("position"), "phases", places.alias("places"), "weight", "text_hash")


def positions(rows: DataFrame) -> DataFrame:
    """doc_id, source, text_hash, copy, position of each row that training reads, from rows(doc_id, source, size, key, text_hash, copies).

    A source's stream are its documents' first copies in order of key, then their second ones, and so on; the share of the
    stream's words that stand before a copy gives its position by the source's schedule. A source's weight is its rank, as
    in targets(). Positions follow from the set of copies alone, so they can be found again from the rows of a mix.
    """
    d = rows.withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("copies").cast("int") - 1))).withColumn("bucket", F.substring("key", 1, 3))
    d = d.withColumn("src", F.struct(F.col("source").isNull().alias("none"), F.coalesce("source", F.lit("")).alias("name")))
    d = keep(d.select("doc_id", "source", "src", "size", "key", "text_hash", "copy", "bucket"))
    sums = keep(d.groupBy("src", "copy", "bucket").agg(F.sum("size").alias("words")))
    stream = Window.partitionBy("src").orderBy("copy", "bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("src", "copy", "bucket", F.coalesce(F.sum("words").over(stream), F.lit(0)).alias("before"))
    order = F.row_number().over(Window.orderBy("src")) - 1  # one row a source
    whole = sums.groupBy("src").agg(F.sum("words").alias("whole")).withColumn("weight", F.pmod(order, F.lit(3)) + 1)
    inside = Window.partitionBy("src", "copy", "bucket").orderBy("key", "doc_id", "size", "text_hash").rowsBetween(Window.unboundedPreceding, -1)
    d = d.withColumn("inner", F.coalesce(F.sum("size").over(inside), F.lit(0))).join(starts, ["src", "copy", "bucket"]).join(whole, "src")
    share = F.when(F.col("whole") > 0, (F.col("before") + F.col("inner")) / F.col("whole")).otherwise(F.lit(0.0))
    return d.select("doc_id", "source", "text_hash", "copy", position(share, F.col("weight")).alias("position"))


def row_key(doc_id: Column, source: Column, text_hash: Column) -> Column:
    """One key of a row's id, source and text, never null: rows are told apart and joined by it with one exchange of their texts."""
    part = lambda c: F.coalesce(F.concat(F.length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string")), F.lit("-"))
    return F.md5(F.concat(part(doc_id), part(source), part(text_hash)))


def placed(docs: DataFrame, at: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """row (a struct of docs' columns) and at's other columns: rows of docs, equal ones once, joined with their places."""
    d = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), row_key(docs[id_col], docs[source_col], F.xxhash64(docs[text_col])).alias("k"))
    at = at.withColumn("k", row_key(at["doc_id"], at["source"], at["text_hash"]))
    return d.dropDuplicates(["k"]).join(at.hint("merge"), "k").select("row", *[c for c in at.columns if c not in ("source", "text_hash", "k")])


def schedule(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The rows of docs as training reads them: one row per copy that the mix takes, range-sorted by training position.

    A document is taken whole in each epoch in which at least half of its words fall before the stream's end. Documents
    without words are taken once. Rows equal in id, source and text are read from one of them, as often as the mix takes all
    of them. Columns of docs may have any names; all of them come back. in_order() finds the same positions again.
    """
    m = mix(docs, id_col, text_col, source_col)
    copies = F.when(F.col("size") > 0, F.round(F.col("taken") / F.col("size")).cast("int")).otherwise(F.lit(1))
    m = m.groupBy("doc_id", "source", "size", "text_hash").agg(F.sum(copies).alias("copies")).where("copies > 0")
    at = keep(positions(m.withColumn("key", F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))))
    return placed(docs, at, id_col, text_col, source_col).orderBy("position", "doc_id", "copy").select("row.*")


def in_order(mixed: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """row (a struct of the columns) and places (position, copy) of each different row of a mix, however it is stored: schedule()'s order as a column."""
    m = sizes(mixed, id_col, text_col, source_col).groupBy("doc_id", "source", "size", "key", "text_hash").agg(F.count(F.lit(1)).alias("copies"))
    at = positions(m).groupBy("doc_id", "source", "text_hash").agg(F.sort_array(F.collect_list(F.struct("position", "copy"))).alias("places"))
    return placed(mixed, keep(at), id_col, text_col, source_col).select("row", "places")
