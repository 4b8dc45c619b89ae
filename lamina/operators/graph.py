"""Connectivity graphs as edge lists (src, dst, pos, neg)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def degree(edges: DataFrame) -> DataFrame:
    """node, pos, neg, total, difference of absolute weights."""
    p, n = F.sum(F.abs("pos")), F.sum(F.abs("neg"))
    return edges.groupBy(F.col("src").alias("node")).agg(p.alias("pos"), n.alias("neg"), (p + n).alias("total"), (p - n).alias("difference"))


def flags(edges: DataFrame, least: float) -> DataFrame:
    """node, flag: 2 for nodes of total degree `least` or more, 1 for their neighbours, 0 for others."""
    d = degree(edges)
    core = d.where(F.col("total") >= least).select("node")
    near = edges.where("pos <> 0 or neg <> 0").join(core.withColumnRenamed("node", "src"), "src", "left_semi").select(F.col("dst").alias("node")).distinct()
    marked = d.select("node").join(core.withColumn("c", F.lit(2)), "node", "left").join(near.withColumn("x", F.lit(1)), "node", "left")
    return marked.select("node", F.coalesce("c", "x", F.lit(0)).alias("flag"))


def line_pairs(edges: DataFrame, flag: DataFrame, least: float) -> DataFrame:
    """Edges src < dst whose ends' flags add up to more than 2 and whose positive weight reaches `least`."""
    a, b = flag.select(F.col("node").alias("src"), F.col("flag").alias("fa")), flag.select(F.col("node").alias("dst"), F.col("flag").alias("fb"))
    return edges.where("src < dst").where(F.abs("pos") >= least).join(a, "src").join(b, "dst").where("fa + fb > 2").select("src", "dst", "pos")


def leading_eigenvector(edges: DataFrame, rounds: int = 30) -> DataFrame:
    """node, x: the leading eigenvector of the symmetric matrix (src, dst, w), by power iteration: each round one join and one aggregate."""
    from ..sources.scratch import keep

    x = edges.select(F.col("src").alias("node")).distinct().withColumn("x", F.lit(1.0))
    e = keep(edges.select("src", "dst", "w"))
    for _ in range(rounds):
        y = keep(e.join(x.withColumnRenamed("node", "dst"), "dst").groupBy(F.col("src").alias("node")).agg(F.sum(F.col("w") * F.col("x")).alias("x")))
        norm = y.agg(F.sqrt(F.sum(F.col("x") ** 2)).alias("n")).first()["n"]
        x = y.select("node", (F.col("x") / F.lit(float(norm or 1.0))).alias("x"))
    return x


def maximum_node(degrees: DataFrame) -> DataFrame:
    """node, total of the largest total degree, the smallest node of ties: one row."""
    m = F.max(F.struct("total", (-F.col("node")).alias("o")))
    return degrees.agg(m.alias("m")).select((-F.col("m.o")).alias("node"), F.col("m.total").alias("total"))
