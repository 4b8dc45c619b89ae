"""Joins by distance, by rank and by interval: range joins become equi-joins on grid cells. Points are never broadcast: both sides grow."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import keep


def cell(c: Column, size: float) -> Column:
    return F.floor(c / size).cast("long")


def radius_pairs(points: DataFrame, radius: float, by: str | None = None, value: str | None = None) -> DataFrame:
    """a < b, d2 of points(id, x, y, z[, by][, value]) with 0 < d2 <= radius squared (and equal `by`); value adds f2, its squared difference.

    Points meet in cells of side `radius`, of one `by`: one side goes to its own cell, the other to its own and to the 13 of the 26
    around it that come after it, so that two cells meet once.
    """
    own, around = (
        points.select(F.col("id").alias(s), *([F.col(by).alias("g")] if by else []), *([F.col(value).alias(f"f{s}")] if value else []), *[F.col(c).alias(f"{c}{s}") for c in "xyz"], *[cell(F.col(c), radius).alias(f"c{c}") for c in "xyz"])
        for s in "ab"
    )
    after = [(x, y, z) for x in (-1, 0, 1) for y in (-1, 0, 1) for z in (-1, 0, 1) if (x, y, z) >= (0, 0, 0)]
    around = around.withColumn("_d", F.explode(F.array(*[F.struct(*[F.lit(v).alias(c) for c, v in zip("xyz", d)], F.lit(d == (0, 0, 0)).alias("same")) for d in after])))
    for c in "xyz":
        around = around.withColumn(f"c{c}", F.col(f"c{c}") - F.col(f"_d.{c}"))
    around = around.withColumn("same", F.col("_d.same")).drop("_d")
    d2 = sum(((F.col(f"{c}a") - F.col(f"{c}b")) ** 2 for c in "xyz"), F.lit(0.0))
    j = own.join(around.hint("merge"), ["cx", "cy", "cz", *(["g"] if by else [])]).where("(same and a < b) or (not same and a <> b)").withColumn("d2", d2).where((F.col("d2") > 0) & (F.col("d2") <= radius * radius))
    return j.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "d2", *([((F.col("fa") - F.col("fb")) ** 2).alias("f2")] if value else []))


def nearest_within(queries: DataFrame, points: DataFrame, radius: float, itself: bool = True) -> DataFrame:
    """For each query (id, x, y, z) the nearest point within radius and its squared distance; the smallest id of ties; queries without one are left out. itself: whether a point may answer a query of its own id."""
    q = queries.select(F.col("id").alias("q"), *[F.col(c).alias(f"{c}a") for c in "xyz"], *[cell(F.col(c), radius).alias(f"c{c}") for c in "xyz"])
    d = F.array(F.lit(-1), F.lit(0), F.lit(1))
    for c in "xyz":
        q = q.select("*", F.explode(d).alias("_d")).withColumn(f"c{c}", F.col(f"c{c}") + F.col("_d")).drop("_d")
    p = points.select(F.col("id").alias("p"), *[F.col(c).alias(f"{c}b") for c in "xyz"], *[cell(F.col(c), radius).alias(f"c{c}") for c in "xyz"])
    d2 = sum(((F.col(f"{c}a") - F.col(f"{c}b")) ** 2 for c in "xyz"), F.lit(0.0))
    j = q.join(p.hint("merge"), ["cx", "cy", "cz"]).withColumn("d2", d2).where((F.col("d2") <= radius * radius) & (F.lit(itself) | (F.col("q") != F.col("p"))))
    return j.groupBy("q").agg(F.min(F.struct("d2", "p")).alias("m")).select("q", F.col("m.p").alias("p"), F.col("m.d2").alias("d2"))


def in_interval(frames: DataFrame, intervals: DataFrame, width: int) -> DataFrame:
    """frames(t, ...) with the intervals [lo, hi) that hold t: intervals are exploded to buckets of `width`, which makes it an equi-join."""
    b = intervals.where("lo < hi").select("*", F.explode(F.sequence(F.floor(F.col("lo") / width), F.floor((F.col("hi") - 1) / width))).alias("_b"))
    return frames.withColumn("_b", F.floor(F.col("t") / width)).join(b, "_b").where("t >= lo and t < hi").drop("_b")


def nearest(queries: DataFrame, points: DataFrame, size: float = 2.0) -> DataFrame:
    """For each query (id, x, y, z) the nearest point other than itself, at any distance: q, p, d2; ties by id.

    Queries look in cells of side `size` around them; those that find nothing look in cells of twice the side, until all
    are answered or the cells hold the whole space, so that each point is compared with few others.
    """
    left, out = keep(queries.select("id", "x", "y", "z")), None
    span = points.unionByName(queries.select(*points.columns), allowMissingColumns=True) if set(points.columns) <= set(queries.columns) else points
    ends = span.agg(*[F.min(c).alias(f"lo_{c}") for c in "xyz"], *[F.max(c).alias(f"hi_{c}") for c in "xyz"]).first()
    whole = max([(ends[f"hi_{c}"] or 0.0) - (ends[f"lo_{c}"] or 0.0) for c in "xyz"])
    while True:
        found = keep(nearest_within(left, points, size, itself=False))
        out = found if out is None else out.unionByName(found)
        left = keep(left.join(found.select(F.col("q").alias("id")).hint("merge"), "id", "left_anti"))
        if size > 2 * whole or not left.limit(1).count():
            return out
        size *= 2


def as_of(left: DataFrame, right: DataFrame, by: str, at: str, value: str) -> DataFrame:
    """left(by, at, ...) with the last value of right(by, at, value) at or before it: one union and one window, no range join."""
    cols = [c for c in left.columns if c not in (by, at)]
    r = right.select(by, at, *[F.lit(None).cast(dict(left.dtypes)[c]).alias(c) for c in cols], F.col(value).alias("as_of"), F.lit(0).alias("side"))
    l = left.select(by, at, *cols, F.lit(None).cast(dict(right.dtypes)[value]).alias("as_of"), F.lit(1).alias("side"))  # noqa: E741
    w = Window.partitionBy(by).orderBy(at, "side").rowsBetween(Window.unboundedPreceding, 0)
    return r.unionByName(l).withColumn("as_of", F.last("as_of", ignorenulls=True).over(w)).where("side = 1").select(by, at, *cols, "as_of")
