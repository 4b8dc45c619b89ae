"""Helpers that the text operators share: reading, shared scratch tables, ASCII lower case, components of a link table."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Spark removes a query's shuffle files when it ends, instead of when the driver happens to collect its garbage.
CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Tables that are kept while settled() makes a table; they go when it is written.
_PASSING: list[list[str]] = []
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession) -> str:
    """The shared folder for tables that cut lineage: spark.checkpoint.dir; where that is unset, a local one for a local master only."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not base:
        os.makedirs("/tmp/checkpoints", exist_ok=True)
        base = tempfile.mkdtemp(prefix="lamina-", dir="/tmp/checkpoints")
        spark.sparkContext.setCheckpointDir(base)
    return base


def keep(df: DataFrame, rows: int | None = None, per_file: int = 200_000) -> DataFrame:
    """Write a table to the shared scratch folder and read it back: lineage ends here and survives lost executors.

    With rows, a bound of the table's rows, it gets a file for each `per_file` of them at most, so that small tables
    cost few tasks. The shuffle files behind the table go as soon as it is written: nothing reads them again.
    """
    spark = df.sparkSession
    path = f"{scratch(spark)}/lamina-{uuid.uuid4().hex}"
    was = spark.conf.get(CLEAN, None)
    spark.conf.set(CLEAN, "true")
    try:
        (df if rows is None else df.coalesce(rows // per_file + 1)).write.parquet(path)
    finally:
        spark.conf.unset(CLEAN) if was is None else spark.conf.set(CLEAN, was)
    if _PASSING:
        _PASSING[-1].append(path)
    return spark.read.schema(df.schema).parquet(path)


def settled(spark: SparkSession, make: Callable[[], DataFrame]) -> DataFrame:
    """Keep the table that make() gives, then remove the tables that were kept on the way to it: nothing else may read those."""
    _PASSING.append([])
    try:
        made = make()
    finally:
        passing = _PASSING.pop()
    try:
        return keep(made)
    finally:
        for path in map(spark._jvm.org.apache.hadoop.fs.Path, passing):
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def lower_ascii(c: Column) -> Column:
    """Lower-case A-Z only. All-ASCII text takes the JVM's fast path; other text must not have its other letters touched."""
    return F.when(F.octet_length(c) == F.char_length(c), F.lower(c)).otherwise(F.translate(c, UPPER, LOWER))


def crc_mod(doc_id: Column, m: int) -> Column:
    """crc32 of the id written in decimal, modulo m: the fixed split into training and held-out rows."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(m))


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """Smallest id reachable from each id of links(a, b): columns id, component.

    Every round each id takes the smallest label among itself and its neighbours, then the label of its label (pointer
    jumping), so long chains halve each round. Messages are pre-aggregated before each shuffle; each round's labels
    are written to the shared folder. Ids without a link are not in the result; null ends are dropped.
    """
    ends = links.where("a is not null and b is not null and a <> b").select("a", "b")
    ends = keep(ends.distinct())
    n = 2 * ends.count()
    both = keep(ends.unionByName(ends.select(F.col("b").alias("a"), F.col("a").alias("b"))), n)
    label = keep(both.groupBy(F.col("a").alias("id")).agg(F.least(F.col("a"), F.min("b")).alias("component")), n)
    for _ in range(rounds):
        near = (
            both.join(label.withColumnRenamed("id", "b"), "b")
            .groupBy(F.col("a").alias("id"))
            .agg(F.min("component").alias("seen"))
        )
        lower = keep(label.join(near, "id").select("id", F.col("component").alias("was"), F.least("component", "seen").alias("to")), n)
        jump = lower.join(lower.select(F.col("id").alias("to"), F.col("to").alias("to2")), "to", "left")
        new = keep(jump.select("id", "was", F.least("to", F.coalesce("to2", "to")).alias("component")), n)
        label = new.select("id", "component")
        if not new.where("was <> component").limit(1).count():
            break
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return label
