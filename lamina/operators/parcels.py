"""Parcellations: runs of equal regions, centroids."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def runs(nodes: DataFrame) -> DataFrame:
    """lobe, first, last, n: contiguous runs of equal lobe in order of node, of nodes(part, node, lobe); parts are independent."""
    w = Window.partitionBy("part").orderBy("node")
    new = F.when(F.col("lobe") == F.lag("lobe").over(w), 0).otherwise(1)
    return nodes.withColumn("new", new).withColumn("run", F.sum("new").over(w)).groupBy("part", "run", "lobe").agg(F.min("node").alias("first"), F.max("node").alias("last"), F.count(F.lit(1)).alias("n")).drop("run")


def centroids(img: DataFrame) -> DataFrame:
    """label, x, y, z, n of each label above 0."""
    return img.where("label > 0").groupBy("label").agg(*[F.avg(a).alias(n) for a, n in zip("ijk", "xyz")], F.count(F.lit(1)).alias("n"))



def sort_parcels(nodes: DataFrame) -> DataFrame:
    """nodes(index, attr ARRAY of whole numbers, ...) with place from 1: by the first attribute, then the second, third and fourth, then the index.

    Attributes are compared one by one, whatever their size and the index's; a node with fewer than four lacks the first ones, which
    count as 0 (as in a sum of attributes times falling powers of a thousand). A range sort, no window over all rows.
    """
    from .statistics import global_rank

    n = F.least(F.size("attr"), F.lit(4))
    key = [F.coalesce(F.when(n >= k, F.get("attr", n - k)), F.lit(0)).alias(f"k{k}") for k in (4, 3, 2, 1)]
    return global_rank(nodes.withColumn("_key", F.struct(*key, F.col("index").alias("i"))), "_key").drop("_key").withColumnRenamed("rank", "place")


def sort_task_ranges(ranges: DataFrame) -> DataFrame:
    """run, ranges: an array of (lo, hi, task) of each run of ranges(run, task, lo, hi), by onset, then end, then task."""
    return ranges.groupBy("run").agg(F.sort_array(F.collect_list(F.struct("lo", "hi", "task"))).alias("ranges"))


def repair_lobes(nodes: DataFrame, size: float = 10.0) -> DataFrame:
    """nodes(id, x, y, z, lobe) in which a node outside all lobes (0) takes the lobe of the nearest node inside one; the smaller id of ties."""
    from .joins import nearest

    bad, good = nodes.where("lobe = 0"), nodes.where("lobe <> 0")
    near = nearest(bad, good.select("id", "x", "y", "z"), size).select(F.col("q").alias("id"), "p")
    fixed = near.join(good.select(F.col("id").alias("p"), F.col("lobe").alias("new")).hint("merge"), "p").select("id", "new")
    return nodes.join(fixed.hint("merge"), "id", "left").select("id", "x", "y", "z", F.coalesce("new", "lobe").alias("lobe"))
