"""Relations that the operators take, made from the benchmark tables, and the same relations as SQL.

volume: voxel, i, j, k, label, v (a 10 x 10 x n grid from part). series: voxel, t, v (daily sums of events per user, missing
days 0). cells: row, col, v (matrix: ship month by supplier group). edges: src, dst, pos, neg. points: id, x, y, z.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def volume(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = read(spark, sf_dir, "part")
    k = F.col("p_partkey")
    return p.select(k.alias("voxel"), (k % 10).cast("int").alias("i"), F.floor(k / 10 % 10).cast("int").alias("j"), F.floor(k / 100).cast("int").alias("k"), F.col("p_size").alias("label"), F.col("p_retailprice").alias("v"))


VOLUME = "vol as (select p_partkey voxel, (p_partkey % 10)::int i, ((p_partkey // 10) % 10)::int j, (p_partkey // 100)::int k, p_size as label, p_retailprice v from part)"


def series(spark: SparkSession, sf_dir: str, frames: int = 30) -> DataFrame:
    e = read(spark, sf_dir, "events")
    t = F.datediff(F.col("ts").cast("date"), F.lit("2024-01-01").cast("date"))
    have = e.groupBy(F.col("user_id").alias("voxel"), t.alias("t")).agg(F.round(F.sum("value"), 6).alias("v"))
    grid = have.select("voxel").distinct().select("voxel", F.explode(F.sequence(F.lit(0), F.lit(frames - 1))).alias("t"))
    return grid.join(have, ["voxel", "t"], "left").select("voxel", "t", F.coalesce("v", F.lit(0.0)).alias("v"))


SERIES = """have as (select user_id voxel, date_diff('day', date '2024-01-01', ts::date)::int t, round(sum(value), 6) v from events group by 1, 2),
 ser as (select g.voxel, g.t::int t, coalesce(h.v, 0.0) v from (select voxel, unnest(range(30)) t from (select distinct voxel from have)) g left join have h on g.voxel = h.voxel and g.t = h.t)"""


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = read(spark, sf_dir, "lineitem")  # noqa: E741
    row = (F.year("l_shipdate") * 12 + F.month("l_shipdate")).alias("row")
    return l.groupBy(row, (F.col("l_suppkey") % 5).cast("int").alias("col")).agg(F.round(F.avg("l_quantity"), 6).alias("v"))


CELLS = "cells as (select (year(l_shipdate) * 12 + month(l_shipdate))::int as row, (l_suppkey % 5)::int as col, round(avg(l_quantity), 6) v from lineitem group by 1, 2)"


def edges(spark: SparkSession, sf_dir: str, nodes: int = 20) -> DataFrame:
    """Signed connections of part groups bought in one order: pos is high quantities in common, neg low ones."""
    l = read(spark, sf_dir, "lineitem").select("l_orderkey", (F.col("l_partkey") % nodes).alias("node"), "l_quantity").repartition("l_orderkey")  # noqa: E741
    q = l.groupBy("l_orderkey", "node").agg(F.sum("l_quantity").alias("q"))
    g = q.groupBy("l_orderkey").agg(F.collect_list(F.struct("node", "q")).alias("g"))  # an order has few lines: pairs are formed inside its row
    pair = g.select(F.explode("g").alias("a"), "g").select("a", F.explode("g").alias("b")).where("a.node <> b.node")
    pair = pair.select(F.col("a.node").alias("src"), F.col("b.node").alias("dst"), F.col("a.q").alias("qa"), F.col("b.q").alias("qb"))
    return pair.groupBy("src", "dst").agg(F.sum(F.when(F.col("qa") + F.col("qb") >= 50, 1.0).otherwise(0.0)).alias("pos"), (-F.sum(F.when(F.col("qa") + F.col("qb") < 25, 1.0).otherwise(0.0))).alias("neg"))


EDGES = """lq as (select l_orderkey, l_partkey % 20 node, sum(l_quantity) q from lineitem group by 1, 2),
 edges as (select a.node src, b.node dst, sum(case when a.q + b.q >= 50 then 1.0::double else 0.0::double end) pos, -sum(case when a.q + b.q < 25 then 1.0::double else 0.0::double end) neg
 from lq a join lq b on a.l_orderkey = b.l_orderkey and a.node <> b.node group by 1, 2)"""
