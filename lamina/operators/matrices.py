"""Matrices as (row, col, v): columns taken out, matrices set side by side, triangles, transposes, products."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def remove_columns(m: DataFrame, gone: list[int]) -> DataFrame:
    """Columns in `gone` are taken out; those after them move up."""
    shift = sum((F.when(F.col("col") > c, 1).otherwise(0) for c in sorted(set(gone))), F.lit(0))
    return m.where(~F.col("col").isin(gone)).select("row", (F.col("col") - shift).cast("int").alias("col"), "v")


def join_columns(a: DataFrame, b: DataFrame, width: int) -> DataFrame:
    """b to the right of a, which has `width` columns."""
    return a.select("row", "col", "v").unionByName(b.select("row", (F.col("col") + width).cast("int").alias("col"), "v"))


def join_rows(a: DataFrame, b: DataFrame, height: int) -> DataFrame:
    """b below a, which has `height` rows."""
    return a.select("row", "col", "v").unionByName(b.select((F.col("row") + height).cast("int").alias("row"), "col", "v"))


def lower_triangle(m: DataFrame) -> DataFrame:
    """place, v: a symmetric matrix as a vector of what lies below its diagonal, row by row."""
    return m.where("col < row").select((F.col("row") * (F.col("row") - 1) / 2 + F.col("col")).cast("long").alias("place"), "v")


def product(a: DataFrame, b: DataFrame) -> DataFrame:
    """a times b: one equi-join on the inner index and one aggregate."""
    right = b.select(F.col("row").alias("inner"), F.col("col").alias("c"), F.col("v").alias("w"))
    return a.withColumnRenamed("col", "inner").join(right, "inner").groupBy("row", F.col("c").alias("col")).agg(F.sum(F.col("v") * F.col("w")).alias("v"))


def transpose(m: DataFrame) -> DataFrame:
    return m.select(F.col("col").alias("row"), F.col("row").alias("col"), "v")
