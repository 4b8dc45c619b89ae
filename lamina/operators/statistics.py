"""Aggregations: regions, volumes, time statistics, ranges, histograms and their information measures, correlation, regression."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import keep


def roi_mean(ser: DataFrame, roi: Column) -> DataFrame:
    """Mean over the voxels of a region for each frame; regions of 0 or less are left out."""
    return ser.withColumn("roi", roi).where("roi > 0").groupBy("t", "roi").agg(F.avg("v").alias("v"))


def roi_volume(img: DataFrame) -> DataFrame:
    return img.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.avg("i").alias("ci"), F.avg("j").alias("cj"), F.avg("k").alias("ck"))


def time_stats(ser: DataFrame) -> DataFrame:
    """Mean, mean plus sample sigma, rms, maximum and minimum of each voxel over time."""
    s = ser.groupBy("voxel").agg(F.avg("v").alias("mean"), F.stddev_samp("v").alias("s"), F.sqrt(F.avg(F.col("v") ** 2)).alias("rms"), F.max("v").alias("max"), F.min("v").alias("min"))
    return s.select("voxel", "mean", (F.col("mean") + F.col("s")).alias("mean_sigma"), "rms", "max", "min")


def normalize_series(ser: DataFrame) -> DataFrame:
    """(v - mean) / population sigma for each voxel; sigma 0 gives 0."""
    w = Window.partitionBy("voxel")
    m, s = F.avg("v").over(w), F.stddev_pop("v").over(w)
    return ser.select("voxel", "t", F.when(s > 0, (F.col("v") - m) / s).otherwise(0.0).alias("v"))


def robust_range(img: DataFrame, low: float, high: float, bins: int = 256) -> DataFrame:
    """Lower edges of the first bins whose cumulative share exceeds low and high: one row lo, hi, vmin, vmax."""
    r = img.agg(F.min("v").alias("vmin"), F.max("v").alias("vmax"), F.count(F.lit(1)).alias("n"))
    b = F.floor((bins - 1) / (F.col("vmax") - F.col("vmin")) * (F.col("v") - F.col("vmin")))
    hist = img.crossJoin(F.broadcast(r)).groupBy("vmin", "vmax", "n", b.alias("bin")).agg(F.count(F.lit(1)).alias("c"))
    run = hist.withColumn("cum", F.sum("c").over(Window.partitionBy("n").orderBy("bin")) / F.col("n"))  # at most `bins` rows
    edge = lambda p: F.min(F.when(F.col("cum") > p, F.col("bin")))
    out = run.groupBy("vmin", "vmax").agg(edge(low).alias("bl"), edge(high).alias("bh"))
    step = (F.col("vmax") - F.col("vmin")) / (bins - 1)
    return out.select((F.col("vmin") + F.col("bl") * step).alias("lo"), (F.col("vmin") + F.col("bh") * step).alias("hi"), "vmin", "vmax")


def normalize_image(img: DataFrame, low: float, high: float, most: int = 1024) -> DataFrame:
    r = robust_range(img, low, high)
    c = F.least(F.greatest(F.col("v"), F.col("lo")), F.col("hi"))
    return img.crossJoin(F.broadcast(r)).select("voxel", F.floor((c - F.col("lo")) * most / (F.col("hi") - F.col("lo")) + 0.5).cast("int").alias("v"))


def order_statistics(img: DataFrame, ranks: list[Column], buckets: int = 4096) -> DataFrame:
    """Exact values at 0-based ranks (columns of n), one row r0, r1, ...

    A histogram of bounded size finds the bucket that holds each rank; only those buckets' distinct values are ordered.
    """
    r = img.agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.count(F.lit(1)).alias("n"))
    b = F.least(F.lit(buckets - 1), F.floor((F.col("v") - F.col("lo")) / F.greatest(F.col("hi") - F.col("lo"), F.lit(1e-300)) * buckets)).cast("int")
    x = img.crossJoin(F.broadcast(r)).select("v", "n", b.alias("b"))
    h = x.groupBy("n", "b").agg(F.count(F.lit(1)).alias("c"))
    h = h.withColumn("before", F.sum("c").over(Window.partitionBy("n").orderBy("b")) - F.col("c"))
    wanted = F.array(*[k.cast("long") for k in ranks])
    h = h.where(F.exists(wanted, lambda k: (k >= F.col("before")) & (k < F.col("before") + F.col("c"))))
    y = x.join(F.broadcast(h.select("b", "before")), "b").groupBy("b", "before", "n", "v").agg(F.count(F.lit(1)).alias("c"))  # equal values are one row
    y = y.withColumn("upto", F.col("before") + F.sum("c").over(Window.partitionBy("b").orderBy("v")))
    at = lambda k: (k.cast("long") < F.col("upto")) & (k.cast("long") >= F.col("upto") - F.col("c"))
    return y.groupBy().agg(*[F.max(F.when(at(k), F.col("v"))).alias(f"r{i}") for i, k in enumerate(ranks)])


def quantile_normalize(img: DataFrame) -> DataFrame:
    """(v - median) / IQR with order statistics at n/4, n/2 and 3n/4 (not interpolated); IQR is 0.001 at least."""
    q = order_statistics(img, [F.floor(F.col("n") / 4), F.floor(F.col("n") / 2), F.floor(3 * F.col("n") / 4)])
    return img.crossJoin(F.broadcast(q)).select("voxel", ((F.col("v") - F.col("r1")) / F.greatest(F.col("r2") - F.col("r0"), F.lit(0.001))).alias("v"))


def histogram(img: DataFrame, origin: float, scale: float, bins: int) -> DataFrame:
    b = F.floor((F.col("v") - origin) / scale + 0.5)
    return img.select(b.cast("int").alias("bin")).where(F.col("bin").between(0, bins - 1)).groupBy("bin").count()


def entropy(hist: DataFrame) -> DataFrame:
    """Entropy in nats of (count); a pass for the total, a pass for the sum."""
    total = hist.agg(F.sum("count").alias("n"))
    p = F.col("count") / F.col("n")
    return hist.crossJoin(F.broadcast(total)).agg((-F.sum(p * F.log(p))).alias("entropy"))


def joint_measures(pairs: DataFrame, x: Column, y: Column) -> DataFrame:
    """H(X), H(Y), H(X,Y), mutual information and NMI = (Hx + Hy) / Hxy - 1 of two binned columns."""
    joint = pairs.groupBy(x.alias("x"), y.alias("y")).count()
    e = lambda h, name: entropy(h).withColumnRenamed("entropy", name)
    hx = e(joint.groupBy("x").agg(F.sum("count").alias("count")), "hx")
    hy = e(joint.groupBy("y").agg(F.sum("count").alias("count")), "hy")
    out = hx.crossJoin(hy).crossJoin(e(joint, "hxy"))
    return out.select("hx", "hy", "hxy", (F.col("hx") + F.col("hy") - F.col("hxy")).alias("mi"), ((F.col("hx") + F.col("hy")) / F.col("hxy") - 1).alias("nmi"))


def correlation(cells: DataFrame) -> DataFrame:
    """a <= b, r: correlation of the columns of (row, col, v) over rows that both have; 0 where a column does not vary, its diagonal included."""
    x, y = cells.select("row", F.col("col").alias("a"), F.col("v").alias("x")), cells.select("row", F.col("col").alias("b"), F.col("v").alias("y"))
    vary = (F.stddev_pop("x") > 0) & (F.stddev_pop("y") > 0)
    return x.join(y, "row").where("a <= b").groupBy("a", "b").agg(F.when(vary, F.corr("x", "y")).otherwise(0.0).alias("r"))


def fisher_z(r: Column) -> Column:
    """0.5 ln((1 + r) / (1 - r)), and 6.103 with r's sign from |r| = 0.99999 on."""
    return F.when(F.abs(r) < 0.99999, 0.5 * F.log((1 + r) / (1 - r))).when(r > 0, F.lit(6.103)).otherwise(F.lit(-6.103))


def seed_correlation(ser: DataFrame, seeds: DataFrame) -> DataFrame:
    """voxel, seed, r from voxel series and seeds(seed, t, s)."""
    j = ser.join(seeds, "t")
    return j.groupBy("voxel", "seed").agg(F.when((F.stddev_pop("v") > 0) & (F.stddev_pop("s") > 0), F.corr("v", "s")).otherwise(0.0).alias("r"))


def glm_slope(ser: DataFrame) -> DataFrame:
    """Slope, intercept and r squared of each voxel's series on time: the general linear model with one task and a constant."""
    n, mx, my = F.count(F.lit(1)), F.avg("t"), F.avg("v")
    return ser.groupBy("voxel").agg(F.regr_slope("v", "t").alias("beta"), F.regr_intercept("v", "t").alias("constant"), F.regr_r2("v", "t").alias("r2"))


def mode_by_label(img: DataFrame, value: Column) -> DataFrame:
    """The most frequent value of each label; of equally frequent ones the smallest."""
    c = img.groupBy("label", value.alias("x")).count()
    return c.groupBy("label").agg(F.max_by("x", F.struct("count", -F.col("x"))).alias("mode"), F.max("count").alias("n"))


def edge_prediction(edges: DataFrame, folds: int = 3, least: float = 0.2) -> DataFrame:
    """Connectome prediction from (subject, edge, x, y): per fold, edges correlated with y outside the fold are kept; a subject's score is the sum of its
    positive edges minus that of its negative ones; a line fitted outside the fold predicts y inside."""
    d = edges.withColumn("fold", (F.col("subject") % folds).cast("int"))
    fold = F.explode(F.sequence(F.lit(0), F.lit(folds - 1))).alias("test")
    split = d.select("*", fold)
    kept = split.where("fold <> test").groupBy("test", "edge").agg(F.corr("x", "y").alias("r")).where(F.abs("r") >= least)
    score = split.join(kept, ["test", "edge"]).groupBy("test", "subject", "fold", "y").agg(F.sum(F.signum("r") * F.col("x")).alias("s"))
    line = score.where("fold <> test").groupBy("test").agg(F.regr_slope("y", "s").alias("b"), F.regr_intercept("y", "s").alias("a"))
    out = score.where("fold = test").join(F.broadcast(line), "test")  # one row per fold
    return out.select("subject", "y", (F.col("a") + F.col("b") * F.col("s")).alias("predicted"))


def global_rank(df: DataFrame, by: str) -> DataFrame:
    """df with rank from 1 in order of a column, without a window over all rows: a range sort, then each partition's offset."""
    at = keep(df.orderBy(by).select("*", F.spark_partition_id().alias("_p"), F.monotonically_increasing_id().alias("_m")))
    parts = at.groupBy("_p").agg(F.min("_m").alias("_first"), F.count(F.lit(1)).alias("_n"))  # a row for each partition
    parts = parts.select("_p", "_first", (F.sum("_n").over(Window.orderBy("_p")) - F.col("_n")).alias("_before"))
    return at.join(F.broadcast(parts), "_p").withColumn("rank", F.col("_before") + F.col("_m") - F.col("_first") + 1).drop("_p", "_m", "_first", "_before", "_n")


def weighted_correlation(pairs: DataFrame) -> DataFrame:
    """r of (x, y, w), one row: weighted means, variances and covariance from six sums."""
    w = F.col("w")
    s = pairs.agg(F.sum(w).alias("s"), *[F.sum(w * e).alias(n) for n, e in (("x", F.col("x")), ("y", F.col("y")), ("xx", F.col("x") ** 2), ("yy", F.col("y") ** 2), ("xy", F.col("x") * F.col("y")))])
    vx, vy = F.col("xx") / F.col("s") - (F.col("x") / F.col("s")) ** 2, F.col("yy") / F.col("s") - (F.col("y") / F.col("s")) ** 2
    return s.select(F.when((vx > 0) & (vy > 0), (F.col("xy") / F.col("s") - F.col("x") * F.col("y") / F.col("s") ** 2) / F.sqrt(vx * vy)).otherwise(0.0).alias("r"))


def image_similarity(pairs: DataFrame) -> DataFrame:
    """Sum of squared differences, their mean, and the squared correlation of (x, y): one row ssd, mse, cc2."""
    d = (F.col("x") - F.col("y")) ** 2
    return pairs.agg(F.sum(d).alias("ssd"), F.avg(d).alias("mse"), (F.corr("x", "y") ** 2).alias("cc2"))


def spearman(pairs: DataFrame) -> DataFrame:
    """Rank correlation of (x, y), equal values with their mean rank; ranks come from counts of distinct values."""
    out = pairs
    for c in "xy":
        n = pairs.groupBy(c).agg(F.count(F.lit(1)).alias("n"))
        ranked = global_total(n, c)
        out = out.join(ranked.select(c, (F.col("before") + (F.col("n") + 1) / 2).alias(f"r{c}")), c)
    return out.agg(F.corr("rx", "ry").alias("rho"))


def global_total(df: DataFrame, by: str) -> DataFrame:
    """df(by, n) with the sum of n over all smaller values of `by`: range sort, sums of partitions, then windows inside them."""
    at = keep(df.orderBy(by).select("*", F.spark_partition_id().alias("_p")))
    parts = at.groupBy("_p").agg(F.sum("n").alias("_n"))
    parts = parts.select("_p", (F.sum("_n").over(Window.orderBy("_p")) - F.col("_n")).alias("_before"))  # a row for each partition
    inside = F.sum("n").over(Window.partitionBy("_p").orderBy(by)) - F.col("n")
    return at.join(F.broadcast(parts), "_p").withColumn("before", F.col("_before") + inside).drop("_p", "_before")


def histogram_measures(hist: DataFrame, origin: float, scale: float) -> DataFrame:
    """n, mean, variance and entropy (nats) of a histogram (bin, count): one row."""
    x, c = F.lit(origin) + F.col("bin") * scale, F.col("count")
    s = hist.agg(F.sum(c).alias("n"), F.sum(c * x).alias("s1"), F.sum(c * x * x).alias("s2"), F.sum(c * F.log(c)).alias("sl"))
    mean = F.col("s1") / F.col("n")
    return s.select("n", mean.alias("mean"), (F.col("s2") / F.col("n") - mean * mean).alias("variance"), (F.log("n") - F.col("sl") / F.col("n")).alias("entropy"))


def roi_mean_full(ser: DataFrame, roi: Column, regions: int) -> DataFrame:
    """roi_mean with a row for each frame and region 1..regions; regions without voxels have 0."""
    have = roi_mean(ser, roi)
    grid = ser.select("t").distinct().select("t", F.explode(F.sequence(F.lit(1), F.lit(regions))).alias("roi"))
    return grid.join(have, ["t", "roi"], "left").select("t", "roi", F.coalesce("v", F.lit(0.0)).alias("v"))


def squared_correlation(pairs: DataFrame, least: float = 0.00001) -> DataFrame:
    """Squared covariance of (x, y) over the product of their variances, each `least` at least: one row cc."""
    return pairs.agg((F.covar_pop("x", "y") ** 2 / (F.greatest(F.var_pop("x"), F.lit(least)) * F.greatest(F.var_pop("y"), F.lit(least)))).alias("cc"))


def project_on_vectors(ser: DataFrame, vectors: DataFrame, scale: float = 1.0) -> DataFrame:
    """voxel, t, v: each frame rebuilt from vectors(voxel, c, e), its coefficient on c being sum(v e) / scale squared.

    Coefficients (frames times vectors) combine before their shuffle; every voxel of the vectors is rebuilt.
    """
    a = ser.join(vectors, "voxel").groupBy("t", "c").agg((F.sum(F.col("v") * F.col("e")) / (scale * scale)).alias("a"))
    return vectors.join(a, "c").groupBy("voxel", "t").agg(F.sum(F.col("a") * F.col("e")).alias("v"))


def mean_squared_error(rows: DataFrame, truth: str, predicted: str, *by: str) -> DataFrame:
    """mse of each group (of all rows without groups)."""
    return rows.groupBy(*by).agg(F.avg((F.col(truth) - F.col(predicted)) ** 2).alias("mse"))


def weighted_correlation_matrix(cells: DataFrame, weights: DataFrame, binary: bool = True, to_z: bool = False) -> DataFrame:
    """a <= b, r: correlation of all columns of (row, col, v) with one weight for each of weights(row, w); 0 where a column does not vary.

    binary: a weight above 0 counts as 1, any other as 0; else weights above 0 count as they are. Rows without a weight do not
    count. Six sums for each pair of columns in one aggregate. to_z: Fisher's z instead of r.
    """
    w = weights.where("w > 0").select("row", (F.lit(1.0) if binary else F.col("w").cast("double")).alias("w"))
    c = cells.join(w, "row")
    x, y = c.select("row", "w", F.col("col").alias("a"), F.col("v").alias("x")), c.select("row", F.col("col").alias("b"), F.col("v").alias("y"))
    part = lambda e: F.sum(F.col("w") * e)
    x_, y_ = F.col("x"), F.col("y")
    s = x.join(y, "row").where("a <= b").groupBy("a", "b").agg(F.sum("w").alias("n"), part(x_).alias("sx"), part(y_).alias("sy"), part(x_ * x_).alias("sxx"), part(y_ * y_).alias("syy"), part(x_ * y_).alias("sxy"))
    mean = lambda k: F.col(k) / F.col("n")
    vx, vy = mean("sxx") - mean("sx") ** 2, mean("syy") - mean("sy") ** 2
    flat = (vx <= 1e-12 * mean("sxx")) | (vy <= 1e-12 * mean("syy"))
    r = F.when(flat, 0.0).otherwise((mean("sxy") - mean("sx") * mean("sy")) / F.sqrt(vx * vy))
    return s.select("a", "b", (fisher_z(r) if to_z else r).alias("r"))


def roi_table(ser: DataFrame, places: DataFrame, regions: int) -> DataFrame:
    """row, roi, v for regions 1..regions: a row for each frame with the mean of the region of ser(voxel, t, v), then -1, the
    number of voxels, and the means of i, j and k of places(voxel, i, j, k, label). A region without voxels has 0, and -1 in its marker row.

    Means combine in the tasks; a region, however large, is a few sums.
    """
    p = places.where(F.col("label").between(1, regions)).select("voxel", F.col("label").cast("int").alias("roi"), "i", "j", "k")
    frames = ser.agg((F.max("t") + 1).alias("n")).select("n")  # one row
    means = ser.join(p.select("voxel", "roi"), "voxel").groupBy("roi", "t").agg(F.avg("v").alias("v")).select(F.col("t").cast("long").alias("row"), "roi", "v")
    shape = p.groupBy("roi").agg(F.count(F.lit(1)).cast("double").alias("n1"), *[F.avg(a).alias(f"c{a}") for a in "ijk"])
    every = ser.sparkSession.range(1, regions + 1).select(F.col("id").cast("int").alias("roi"))
    shape = every.join(shape, "roi", "left").crossJoin(F.broadcast(frames.withColumnRenamed("n", "frames")))
    extra = F.array(F.lit(-1.0), *[F.coalesce(c, F.lit(0.0)) for c in ("n1", "ci", "cj", "ck")])
    extra = shape.select("roi", "frames", F.posexplode(extra).alias("k", "v")).select((F.col("frames") + F.col("k")).cast("long").alias("row"), "roi", "v")
    grid = every.crossJoin(F.broadcast(frames)).select("roi", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n").cast("long") - 1)).alias("row"))
    return grid.join(means, ["row", "roi"], "left").select("row", "roi", F.coalesce("v", F.lit(0.0)).alias("v")).unionByName(extra)


def quantile_normalize_frames(ser: DataFrame) -> DataFrame:
    """voxel, t, v: quantile_normalize() of all frames of ser(voxel, t, v) with the order statistics of frame 0."""
    first = ser.where("t = 0").select("voxel", "v")
    q = order_statistics(first, [F.floor(F.col("n") / 4), F.floor(F.col("n") / 2), F.floor(3 * F.col("n") / 4)])
    return ser.crossJoin(F.broadcast(q)).select("voxel", "t", ((F.col("v") - F.col("r1")) / F.greatest(F.col("r2") - F.col("r0"), F.lit(0.001))).alias("v"))


def predict_from_edges(edges: DataFrame, traits: DataFrame, folds: DataFrame, least: float) -> DataFrame:
    """subject, fold, truth, predicted: connectome prediction with the subjects of one fold left out at a time.

    edges(subject, edge, v), traits(subject, y), folds(subject, fold). In each fold, edges whose correlation with the trait over the other
    folds' subjects is at least `least` in size are added up by sign for every subject; the trait is fitted on the two sums over
    the other folds and predicted for the fold left out. Folds are a key: all are worked out in one pass. A fold without any edge, or whose sums do not
    vary, predicts the others' mean.
    """
    e = edges.join(traits, "subject").join(folds, "subject")
    each = folds.select(F.col("fold").alias("out")).distinct()
    train = e.join(F.broadcast(each), F.col("fold") != F.col("out"))  # folds are few: the number of them is the caller's
    r = train.groupBy("out", "edge").agg(F.corr("v", "y").alias("r")).where(F.abs("r") >= least).select("out", "edge", F.signum("r").alias("sign"))
    sums = e.join(r, "edge").groupBy("out", "subject", "fold", "y").agg(F.sum(F.when(F.col("sign") > 0, F.col("v")).otherwise(0.0)).alias("p"), F.sum(F.when(F.col("sign") < 0, F.col("v")).otherwise(0.0)).alias("n"))
    every = traits.join(folds, "subject").join(F.broadcast(each), how="cross").select(F.col("out"), "subject", "fold", "y")
    s = every.join(sums.select("out", "subject", "p", "n"), ["out", "subject"], "left").fillna(0.0, ["p", "n"])
    m = s.where("fold <> out").groupBy("out").agg(F.avg("y").alias("my"), F.avg("p").alias("mp"), F.avg("n").alias("mn"), *[F.covar_pop(a, b).alias(f"c{a}{b}") for a, b in (("p", "p"), ("n", "n"), ("p", "n"), ("p", "y"), ("n", "y"))])
    det = F.col("cpp") * F.col("cnn") - F.col("cpn") ** 2
    both = det > 1e-12 * F.col("cpp") * F.col("cnn")
    bp = F.when(both, (F.col("cpy") * F.col("cnn") - F.col("cny") * F.col("cpn")) / det).when(F.col("cpp") > 0, F.col("cpy") / F.col("cpp")).otherwise(0.0)
    bn = F.when(both, (F.col("cny") * F.col("cpp") - F.col("cpy") * F.col("cpn")) / det).when(F.col("cpp") > 0, F.lit(0.0)).when(F.col("cnn") > 0, F.col("cny") / F.col("cnn")).otherwise(0.0)
    model = m.select("out", "my", "mp", "mn", bp.alias("bp"), bn.alias("bn"))
    test = s.where("fold = out").join(model, "out")
    return test.select("subject", "fold", F.col("y").alias("truth"), (F.col("my") + F.col("bp") * (F.col("p") - F.col("mp")) + F.col("bn") * (F.col("n") - F.col("mn"))).alias("predicted"))


def assign_folds(subjects: DataFrame, k: int) -> DataFrame:
    """subject, fold (0 to k - 1): subjects in a fixed pseudo-random order, dealt in turn, so folds differ by one subject at most."""
    ranked = global_rank(subjects.select("subject").withColumn("_key", F.struct(F.xxhash64("subject").alias("h"), "subject")), "_key")
    return ranked.select("subject", F.pmod(F.col("rank") - 1, F.lit(k)).cast("int").alias("fold"))
