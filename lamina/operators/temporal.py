"""Operators on ordered series. A series is kept as one array per row, so recurrences and regressions run without a shuffle."""

from __future__ import annotations

from math import ceil, pi, sqrt, tan, tanh

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def wide(ser: DataFrame, key: str = "voxel") -> DataFrame:
    """voxel, ts: one row per series, in order of t."""
    ordered = F.array_sort(F.collect_list(F.struct("t", "v")))
    return ser.groupBy(key).agg(F.transform(ordered, lambda x: x["v"]).alias("ts"))


def long(ser: DataFrame, key: str = "voxel") -> DataFrame:
    return ser.select(key, F.posexplode("ts").alias("t", "v"))


def coefficients(cut: float, rate: float, high: bool) -> tuple[float, float, float, float, float]:
    """b0, b1, b2, a1, a2 of a second-order Butterworth filter."""
    eta, q = 1 / tan(pi * cut / rate), sqrt(2)
    b0 = 1 / (1 + q * eta + eta * eta)
    b1, b2, a1, a2 = 2 * b0, b0, -2 * (eta * eta - 1) * b0, (1 - q * eta + eta * eta) * b0
    return (b0 * eta * eta, -b1 * eta * eta, b2 * eta * eta, a1, a2) if high else (b0, b1, b2, a1, a2)


def recur(ts: Column, c: tuple[float, float, float, float, float]) -> Column:
    """y[n] = b0 x[n] + b1 x[n-1] + b2 x[n-2] - a1 y[n-1] - a2 y[n-2] from rest, folded over the array in the JVM."""
    b0, b1, b2, a1, a2 = (F.lit(x) for x in c)
    zero = F.lit(0.0)
    start = F.struct(zero.alias("x1"), zero.alias("x2"), zero.alias("y1"), zero.alias("y2"), F.array().cast("array<double>").alias("out"))

    def step(s: Column, x: Column) -> Column:
        y = b0 * x + b1 * s["x1"] + b2 * s["x2"] - a1 * s["y1"] - a2 * s["y2"]
        return F.struct(x.alias("x1"), s["x1"].alias("x2"), y.alias("y1"), s["y1"].alias("y2"), F.array_append(s["out"], y).alias("out"))

    return F.aggregate(ts, start, step, lambda s: s["out"])


def butterworth(ser: DataFrame, low: float | None = None, high: float | None = None, rate: float = 1.0) -> DataFrame:
    """Low-pass at `high`, then high-pass at `low`, of wide series; either may be None."""
    for cut, is_high in ((high, False), (low, True)):
        if cut is not None:
            ser = ser.withColumn("ts", recur(F.col("ts"), coefficients(cut, rate, is_high)))
    return ser


def backfill(ser: DataFrame, good: Column) -> DataFrame:
    """The next good value replaces a bad one; bad values at the end are null."""
    w = Window.partitionBy("voxel").orderBy("t").rowsBetween(0, Window.unboundedFollowing)
    return ser.select("voxel", "t", F.first(F.when(good, F.col("v")), ignorenulls=True).over(w).alias("v"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def legendre(n: int, degree: int) -> list[list[float]]:
    """Legendre polynomials 0..degree at n points of [-1, 1]."""
    t = [-1 + 2 * i / (n - 1) for i in range(n)] if n > 1 else [0.0]
    out = [[1.0] * n, t]
    for k in range(1, degree):
        out.append([((2 * k + 1) * x * a - k * b) / (k + 1) for x, a, b in zip(t, out[k], out[k - 1])])
    return out[: degree + 1]


def regress_out(ser: DataFrame, basis: list[list[float]]) -> DataFrame:
    """Residual of wide series against a basis, made orthonormal once here; rows are projected in the JVM without a shuffle."""
    import numpy as np

    q, r = np.linalg.qr(np.array(basis, float).T)
    for k in range(q.shape[1]):
        if abs(r[k, k]) < 1e-12:
            continue
        e = F.array(*[F.lit(float(x)) for x in q[:, k]])
        # The product is an element of an array, so that it is worked out once a series and not in each step of zip_with.
        ser = ser.withColumn("ts", F.element_at(F.transform(F.array(dot(F.col("ts"), e)), lambda c: F.zip_with("ts", e, lambda x, b: x - c * b)), 1))  # noqa: B023
    return ser


def drift_correct(ser: DataFrame, frames: int, degree: int = 2) -> DataFrame:
    return regress_out(ser, legendre(frames, degree))


def global_regress(ser: DataFrame) -> DataFrame:
    """Residual of each voxel against the unit global signal (the mean over voxels of each frame, divided by its norm)."""
    g = ser.groupBy("t").agg(F.avg("v").alias("g"))
    norm = g.agg(F.sqrt(F.sum(F.col("g") ** 2)).alias("norm"))
    u = g.crossJoin(F.broadcast(norm)).select("t", F.when(F.col("norm") > 0, F.col("g") / F.col("norm")).otherwise(0.0).alias("u"))
    j = ser.join(u, "t")
    c = F.sum(F.col("v") * F.col("u")).over(Window.partitionBy("voxel"))
    return j.select("voxel", "t", (F.col("v") - c * F.col("u")).alias("v"))


def dual_regress(ser: DataFrame) -> DataFrame:
    """v - a u with a = <u,v> / <u,u> for each voxel of (voxel, t, v, u); 0 where u is."""
    w = Window.partitionBy("voxel")
    uu = F.sum(F.col("u") ** 2).over(w)
    a = F.when(uu > 0, F.sum(F.col("u") * F.col("v")).over(w) / uu).otherwise(0.0)
    return ser.select("voxel", "t", (F.col("v") - a * F.col("u")).alias("v"))


def top_hat(ser: DataFrame, radius: int) -> DataFrame:
    """v minus its opening: the running maximum of the running minimum over 2 radius + 1 frames, cut at the ends."""
    w = Window.partitionBy("voxel").orderBy("t").rowsBetween(-radius, radius)
    low = ser.withColumn("lo", F.min("v").over(w))
    return low.select("voxel", "t", (F.col("v") - F.max("lo").over(w)).alias("v"))


def df_over_f(ser: DataFrame) -> DataFrame:
    m = F.avg("v").over(Window.partitionBy("voxel"))
    return ser.select("voxel", "t", F.when(m != 0, F.col("v") / m).otherwise(0.0).alias("v"))


def intervals_to_frames(intervals: DataFrame) -> DataFrame:
    """Frames of half-open ranges (run, task, lo, hi), each once."""
    return intervals.where("lo < hi").select("run", "task", F.explode(F.sequence("lo", F.col("hi") - 1)).alias("frame")).distinct()


def ztone(x: Column) -> Column:
    """The haemodynamic tone curve on 0..1."""
    return 0.50212657 * (F.tanh(F.tan(0.5 * pi * (1.6 * x - 0.8))) + 0.99576486)


def hrf_design(intervals: DataFrame, frames: int, length: int) -> DataFrame:
    """run, frame, task, v: task frames of each run convolved with the tone curve over `length` frames, cut at the run's end."""
    on = intervals_to_frames(intervals)
    lagged = on.select("run", "task", "frame", F.explode(F.sequence(F.lit(0), F.lit(length - 1))).alias("d"))
    lagged = lagged.select("run", "task", (F.col("frame") + F.col("d")).alias("frame"), ztone(F.col("d") / float(length)).alias("h"))
    return lagged.where(F.col("frame") < frames).groupBy("run", "frame", "task").agg(F.sum("h").alias("v"))


def glm(ser: DataFrame, design: list[list[float]], weights: list[float] | None = None) -> DataFrame:
    """voxel, regressor, beta of wide series on any number of regressors (rows of design over frames), weighted by frame.

    The pseudo-inverse of the small design is worked out here once; each series is projected in the JVM without a shuffle.
    """
    import numpy as np

    x = np.array(design, float).T
    w = np.sqrt(np.ones(len(x)) if weights is None else np.array(weights, float))
    inverse = np.linalg.pinv(x * w[:, None]) * w
    betas = [F.struct(F.lit(k).alias("regressor"), dot(F.col("ts"), F.array(*[F.lit(float(a)) for a in row])).alias("beta")) for k, row in enumerate(inverse)]
    return ser.select("voxel", F.inline(F.array(*betas)))


def regress_weighted(ser: DataFrame, design: list[list[float]], weights: list[float]) -> DataFrame:
    """Residual of wide series after the weighted fit of glm()."""
    import numpy as np

    x = np.array(design, float).T
    w = np.sqrt(np.array(weights, float))
    inverse = np.linalg.pinv(x * w[:, None]) * w
    for row, column in zip(inverse, x.T):
        ser = ser.withColumn("fit", F.array_append(F.coalesce(F.col("fit") if "fit" in ser.columns else F.lit(None).cast("array<double>"), F.array().cast("array<double>")), dot(F.col("ts"), F.array(*[F.lit(float(a)) for a in row]))))
    fitted = [F.array(*[F.lit(float(a)) for a in column]) for column in x.T]
    out = F.transform("ts", lambda v, t: v - sum((F.get("fit", F.lit(k)) * F.get(c, t) for k, c in enumerate(fitted)), F.lit(0.0)))
    return ser.withColumn("ts", out).drop("fit")


def frame_neighbours(ser: DataFrame, k: int) -> DataFrame:
    """t, other, d2, rank: for each frame the k frames whose values over all voxels are nearest; ties by frame. Sums over voxels combine before the shuffle."""
    a, b = ser.select("voxel", "t", "v"), ser.select("voxel", F.col("t").alias("other"), F.col("v").alias("w"))
    d2 = a.join(b, "voxel").where("t <> other").groupBy("t", "other").agg(F.round(F.sum((F.col("v") - F.col("w")) ** 2), 4).alias("d2"))
    return d2.withColumn("rank", F.row_number().over(Window.partitionBy("t").orderBy("d2", "other"))).where(F.col("rank") <= k)


def top_hat_padded(ser: DataFrame, width: int) -> DataFrame:
    """v minus its opening over windows of `width` frames (even widths too), the series being mirrored before its first frame.

    The opening is the largest of the least values of the windows that hold a frame; windows may end beyond the last frame. The mirror
    holds 2 v(0) - v(t) at -t for t up to `width`, which keeps the level at the start.
    """
    first = ser.where("t = 0").select("voxel", F.col("v").alias("v0"))
    mirror = ser.where(F.col("t").between(1, width)).join(first, "voxel").select("voxel", (-F.col("t")).alias("t"), (2 * F.col("v0") - F.col("v")).alias("v"))
    whole = ser.select("voxel", "t", "v").unionByName(mirror)
    w = Window.partitionBy("voxel").orderBy("t")
    low = whole.withColumn("lo", F.min("v").over(w.rowsBetween(0, width - 1)))
    return low.withColumn("v", F.col("v") - F.max("lo").over(w.rowsBetween(1 - width, 0))).where("t >= 0").select("voxel", "t", "v")


#: Fixed values of the response: seconds of delay, rise, fall and restoring, and depth of the undershoot.
DELAY, RISE, FALL, RESTORE, UNDERSHOOT = 2.0, 4.0, 6.0, 2.0, 0.2


def response(period: float) -> list[float]:
    """The haemodynamic response at multiples of `period` seconds, from 0 to its end."""

    def tone(x: float) -> float:
        return min(1.0, 0.50212657 * (tanh(tan(0.5 * pi * (1.6 * x - 0.8))) + 0.99576486)) if 0 < x < 1 else float(x >= 1)

    def at(t: float) -> float:
        t -= DELAY
        if t < RISE:
            return tone(t / RISE)
        if t < RISE + FALL:
            return (1 + UNDERSHOOT) * tone((RISE + FALL - t) / FALL) - UNDERSHOOT
        return -UNDERSHOOT * tone((RISE + FALL + RESTORE - t) / RESTORE)

    return [at(k * period) for k in range(1 + ceil((DELAY + RISE + FALL + RESTORE) / period))]


def stacked_waveform(tasks: DataFrame, frames: int, period: float, order: int = -1, shifted: bool = False) -> DataFrame:
    """run, frame, col, v: the design of tasks(run, frame, col, v): each column convolved with the response within its run of `frames` frames, then drift.

    A value is joined with the response's few points and summed, so a run's frames spread over tasks. order 0 to 3 adds columns of
    Legendre polynomials over -1..1, which are 0 outside their own run; they are numbered after the tasks' columns, run by run. shifted: the
    polynomial of second order less 1 / frames, and -1..1 without its end, as some programs have them.
    """
    h = F.array(*[F.struct(F.lit(d).alias("d"), F.lit(x).alias("h")) for d, x in enumerate(response(period)) if x != 0])
    out = tasks.where("v <> 0").select("run", "frame", "col", "v", F.explode(h).alias("p")).select("run", (F.col("frame") + F.col("p.d")).alias("frame"), "col", (F.col("v") * F.col("p.h")).alias("v"))
    out = out.where(F.col("frame") < frames).groupBy("run", "frame", "col").agg(F.sum("v").alias("v"))
    runs, cols = tasks.select("run").distinct(), tasks.select("col").distinct()
    grid = runs.crossJoin(F.broadcast(cols)).withColumn("frame", F.explode(F.sequence(F.lit(0), F.lit(frames - 1))))  # columns of a design are few
    out = grid.join(out, ["run", "frame", "col"], "left").select("run", "frame", F.col("col").cast("int").alias("col"), F.coalesce("v", F.lit(0.0)).alias("v"))
    if order < 0:
        return out
    order = min(order, 3)
    place = F.row_number().over(Window.orderBy("run")) - 1  # one row a run
    numbered = runs.select("run", place.alias("r")).crossJoin(F.broadcast(tasks.agg((F.max("col") + 1).alias("width"), F.countDistinct("run").alias("runs"))))
    t = 2 * F.col("frame") / float(frames if shifted else max(1, frames - 1)) - 1
    poly = [F.lit(1.0), t, 1.5 * t * t - 0.5 - (1.0 / frames if shifted else 0.0), 2.5 * t * t * t - 1.5 * t][: order + 1]
    rows = numbered.withColumn("frame", F.explode(F.sequence(F.lit(0), F.lit(frames - 1)))).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("runs") - 1)))
    drift = rows.select("run", "frame", "r", "other", "width", F.posexplode(F.array(*[p.cast("double") for p in poly])).alias("k", "p"))
    drift = drift.select("run", "frame", (F.col("width") + F.col("other") * (order + 1) + F.col("k")).cast("int").alias("col"), F.when(F.col("r") == F.col("other"), F.col("p")).otherwise(0.0).alias("v"))
    return out.unionByName(drift)


def frame_matrix(ser: DataFrame, sparsity: float | None = None, best: int | None = None) -> DataFrame:
    """t, other, d2: for each frame of ser(voxel, t, v) the frames whose squared distance over all voxels lies strictly below the one at
    rank `best`, counted from 0 among all frames, the frame itself (at 0) among them. sparsity: best is this share of the frames, rounded down, plus 1.

    Voxels become rows with their series; a task adds up one matrix of frames by frames, so what is shuffled is a matrix a task and not a row for
    each voxel and pair. A frame that a voxel lacks counts as 0.
    """
    import numpy as np
    import pyarrow as pa

    n = (ser.agg(F.max("t")).first()[0] or 0) + 1
    best = int(sparsity * n) + 1 if best is None else best

    def add(batches):
        total = np.zeros((n, n))
        for batch in batches:
            flat, t, v = batch.column(0), batch.column(0).flatten().field("t"), batch.column(0).flatten().field("v")
            rows = np.repeat(np.arange(len(flat)), np.diff(flat.offsets.to_numpy()))
            x = np.zeros((len(flat), n))
            x[rows, t.to_numpy()] = v.to_numpy()
            for a in range(n):
                total[a] += ((x - x[:, a : a + 1]) ** 2).sum(0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(n, dtype=np.int32)), pa.array(list(total), pa.list_(pa.float64()))], ["t", "d"])

    wide = ser.groupBy("voxel").agg(F.collect_list(F.struct(F.col("t").cast("int").alias("t"), F.col("v").cast("double").alias("v"))).alias("x")).select("x")
    d2 = wide.mapInArrow(add, "t int, d array<double>").select("t", F.posexplode("d").alias("other", "d2")).groupBy("t", "other").agg(F.sum("d2").alias("d2"))
    w = Window.partitionBy("t")
    rank = F.row_number().over(w.orderBy("d2", "other")) - 1
    cut = F.max(F.when(F.col("rank") == best, F.col("d2"))).over(w)
    return d2.withColumn("rank", rank).withColumn("cut", cut).where("cut is null or d2 < cut").select("t", "other", "d2")


def global_signal(ser: DataFrame, weights: DataFrame | None = None) -> DataFrame:
    """t, u, on: the mean over voxels of each frame, scaled to length 1 over the frames in use (0 elsewhere); weights(t, w) above 0.5 are in use, all without weights."""
    g = ser.groupBy("t").agg(F.avg("v").alias("g"))
    g = g.withColumn("on", F.lit(True)) if weights is None else g.join(weights.select("t", (F.col("w") > 0.5).alias("on")), "t", "left").withColumn("on", F.coalesce("on", F.lit(False)))
    norm = g.where("on").agg(F.sqrt(F.sum(F.col("g") ** 2)).alias("norm"))  # one row
    return g.crossJoin(F.broadcast(norm)).select("t", F.when(F.col("on") & (F.col("norm") > 0), F.col("g") / F.col("norm")).otherwise(0.0).alias("u"), "on")


def global_regress_weighted(ser: DataFrame, weights: DataFrame) -> DataFrame:
    """Residual of each voxel against the global signal over the frames in use; frames out of use are 0."""
    j = ser.join(global_signal(ser, weights), "t")
    c = F.sum(F.col("v") * F.col("u")).over(Window.partitionBy("voxel"))
    return j.select("voxel", "t", F.when(F.col("on"), F.col("v") - c * F.col("u")).otherwise(0.0).alias("v"))
