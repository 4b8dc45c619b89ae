"""Joint histograms with partial volumes, and the six similarity measures read off a joint histogram."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PARTS = 100  # a fixed value: a sample of weight 1 is dealt out as a hundred parts


def joint_histogram(pairs: DataFrame, bins: tuple[int, int], weight: Column | None = None) -> DataFrame:
    """a, b, count of pairs(x, y), whole numbers from 0; values outside the bins are left out, weights (whole numbers) are summed."""
    inside = F.col("x").between(0, bins[0] - 1) & F.col("y").between(0, bins[1] - 1)
    return pairs.where(inside).groupBy(F.col("x").cast("int").alias("a"), F.col("y").cast("int").alias("b")).agg(F.sum(F.lit(1) if weight is None else weight).cast("long").alias("count"))


def joint_histogram_pv(pairs: DataFrame, scale: int, bins: tuple[int, int], weight: Column | None = None) -> DataFrame:
    """a, b, count: each pair(x, y) of whole numbers is a point (x / scale, y / scale) and is dealt to the four bins around it.

    A bin gets PARTS times the weight times its share of the area, rounded to a whole number. Points below 0 or above
    the bins' last place less a thousandth are left out. The sum is taken in the tasks first, so bins are all that is shuffled.
    """
    w = (F.lit(1) if weight is None else weight) * PARTS
    x, y = F.col("x"), F.col("y")
    inside = (x >= 0) & (y >= 0) & (x / scale <= bins[0] - 1.001) & (y / scale <= bins[1] - 1.001)
    a, b = F.floor(x / scale).cast("int"), F.floor(y / scale).cast("int")
    fx, fy = (x % scale) / scale, (y % scale) / scale
    part = lambda i, j: F.struct((a + i).alias("a"), (b + j).alias("b"), (w * (fx if i else 1 - fx) * (fy if j else 1 - fy) + 0.5).cast("long").alias("n"))
    parts = pairs.where(inside).select(F.explode(F.array(*[part(i, j) for i in (0, 1) for j in (0, 1)])).alias("p"))
    return parts.groupBy("p.a", "p.b").agg(F.sum("p.n").alias("count")).where("count <> 0")


def measures(histogram: DataFrame) -> DataFrame:
    """One row of (a, b, count): n, ssd, cc (squared correlation), hx, hy, hxy (entropies), mi, nmi. Without samples ssd is 0 and the rest null."""
    n = F.sum("count").alias("n")
    h = histogram.where("count <> 0")
    log = lambda by: h.groupBy(*by).agg(F.sum("count").alias("c")).where("c > 0").agg(F.sum(F.col("c") * F.log(F.col("c").cast("double"))).alias("s"))
    mean = lambda e: F.sum(F.col("count") * e) / F.sum("count")
    a, b = F.col("a").cast("double"), F.col("b").cast("double")
    floor = lambda v: F.greatest(v, F.lit(0.00001))
    one = h.agg(n, mean((a - b) * (a - b)).alias("ssd"), mean(a * b).alias("ab"), mean(a).alias("ma"), mean(b).alias("mb"), mean(a * a).alias("aa"), mean(b * b).alias("bb"))
    for name, by in (("hx", ["a"]), ("hy", ["b"]), ("hxy", ["a", "b"])):
        one = one.crossJoin(F.broadcast(log(by).withColumnRenamed("s", f"s_{name}")))  # one row
        one = one.withColumn(name, F.log(F.col("n").cast("double")) - F.col(f"s_{name}") / F.col("n"))
    cc = (F.col("ab") - F.col("ma") * F.col("mb")) ** 2 / (floor(F.col("aa") - F.col("ma") ** 2) * floor(F.col("bb") - F.col("mb") ** 2))
    return one.select(F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("ssd", F.lit(0.0)).alias("ssd"), cc.alias("cc"), "hx", "hy", "hxy", (F.col("hx") + F.col("hy") - F.col("hxy")).alias("mi"), (F.try_divide(F.col("hx") + F.col("hy"), F.col("hxy")) - 1).alias("nmi"))
