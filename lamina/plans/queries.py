"""One query for each family of operators on the benchmark tables, with its SQL twin. Floats are rounded on both sides."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scalar as S
from ..operators import chains as H
from ..operators import elementwise as E
from ..operators import geometry as M
from ..operators import graph as G
from ..operators import joins as J
from ..operators import matrices as X
from ..operators import neighbours as N
from ..operators import perfusion as U
from ..operators import spatial as P
from ..operators import statistics as A
from ..operators import temporal as T
from ..sources.adapters import CELLS, EDGES, SERIES, VOLUME, cells, edges, read, series, volume

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def rounded(df: DataFrame, digits: int = 4) -> DataFrame:
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def with_(*parts: str) -> str:
    return "with recursive " + ", ".join(parts) + " "


# --- element-wise -------------------------------------------------------------------------------------------------


@query(with_(VOLUME) + "select voxel, case when v between 1000 and 1500 then v when v > 1500 then 1500.0 else 0.0 end v from vol")
def threshold_saturate(spark, d):
    return volume(spark, d).select("voxel", E.threshold(F.col("v"), 1000, 1500, saturate=True).alias("v"))


@query(with_(VOLUME) + "select voxel, case when v between 1000 and 1500 then 1.0::double else 0.0::double end v from vol")
def threshold_binary(spark, d):
    return volume(spark, d).select("voxel", E.threshold(F.col("v"), 1000, 1500, 1, 0).alias("v"))


@query("select l_orderkey, l_linenumber, l_partkey, round((l_extendedprice - 100.0) * 0.25, 4) v from lineitem")
def shift_scale(spark, d):
    return read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.round(E.shift_scale(F.col("l_extendedprice"), -100.0, 0.25), 4).alias("v"))


@query(with_(VOLUME, "r as (select min(v) lo, max(v) hi from vol)") + "select voxel, case when v >= lo + 0.4 * (hi - lo) then 1 else 0 end::int mask from vol, r")
def create_mask(spark, d):
    return E.create_mask(volume(spark, d), 0.4)


@query(with_(VOLUME) + "select voxel, i, j, k, label, case when label >= 20 then v else 0.0 end v from vol")
def mask_keep(spark, d):
    v = volume(spark, d)
    return E.apply_mask(v, v.select("voxel", F.col("label").alias("mask")), 20)


@query(with_(VOLUME) + "select voxel, i, j, k, label, case when label < 20 then v else -1.0 end v from vol")
def mask_inverse(spark, d):
    v = volume(spark, d)
    return E.apply_mask(v, v.select("voxel", F.col("label").alias("mask")), 20, True, -1.0)


def _combine(how: str, expr: str):
    def f(spark, d):
        v = volume(spark, d)
        return rounded(E.combine(v, v.select("voxel", F.col("label").cast("double").alias("v")), how, 1.0, 0.5))

    f.__name__ = f"combine_{how}"
    return query(with_(VOLUME) + f"select voxel, round({expr}, 4) v from vol")(f)


for _how, _expr in (("add", "v + 0.5 * label"), ("subtract", "v - 0.5 * label"), ("multiply", "v * (0.5 * label)"), ("divide", "case when abs(0.5 * label) > 0.001 then v / (0.5 * label) else 0.0 end")):
    _combine(_how, _expr)


@query(with_(VOLUME) + "select voxel, ((i - 2) // 2)::int i, ((j - 0) // 3)::int j, k, label, v from vol where i between 2 and 8 and (i - 2) % 2 = 0 and j between 0 and 9 and j % 3 = 0")
def crop_stride(spark, d):
    return E.crop(volume(spark, d), {"i": (2, 8, 2), "j": (0, 9, 3)})


@query(with_(VOLUME) + "select voxel, i, j, k, label, case when i between 2 and 7 and k between 1 and 12 then v else 0.0 end v from vol")
def blank_box(spark, d):
    return E.blank(volume(spark, d), {"i": (2, 7), "k": (1, 12)})


@query(with_(VOLUME) + "select voxel, i, j, k, label, case when (i - 4.5) * (i - 4.5) + (j - 4.5) * (j - 4.5) <= 9 then v else 0.0 end v from vol")
def circle_blank(spark, d):
    return E.circle_blank(volume(spark, d), 4.5, 4.5, 3.0)


@query(with_(VOLUME) + "select voxel, (9 - i)::int i, j, k, label, v from vol")
def flip_axis(spark, d):
    return E.flip(volume(spark, d), "i", 10)


@query(with_(VOLUME) + "select voxel, k as i, i as j, j as k, label, v from vol")
def permute_axes(spark, d):
    return E.permute(volume(spark, d), "kij")


@query(with_(VOLUME) + "select voxel, i, j, k, label, case when i % 4 = 0 or j % 4 = 0 then 5000.0 else v end v from vol")
def add_grid(spark, d):
    return E.add_grid(volume(spark, d), 4, 5000)


@query(with_(VOLUME) + "select voxel, i, k, v from vol where j = 5")
def extract_slice(spark, d):
    return E.extract_slice(volume(spark, d), "j", -1, 10)


@query(with_(SERIES) + "select voxel, v from ser where t = 7")
def extract_frame(spark, d):
    return series(spark, d).where("t = 7").select("voxel", "v")


@query(with_(SERIES) + "select voxel, ((t - 2) // 5)::int t, v from ser where t between 2 and 27 and (t - 2) % 5 = 0")
def frames_stride(spark, d):
    return E.crop(series(spark, d), {"t": (2, 27, 5)})


@query(with_(SERIES) + "select voxel, t, v from ser union all select voxel, (t + 30)::int, v * 2 from ser")
def append_frames(spark, d):
    s = series(spark, d)
    return E.append([(s, 30), (s.withColumn("v", F.col("v") * 2), 30)])


@query(with_(VOLUME) + "select voxel, i, j, k, label, v from vol union all select voxel, i, j, (k + 20)::int, label, v from vol")
def stack_slices(spark, d):
    v = volume(spark, d)
    return E.append([(v, 20), (v, 20)], "k")


@query(with_(VOLUME) + "select i, j, max(v) v from vol group by i, j")
def project_max(spark, d):
    return E.project(volume(spark, d), "k")


@query(with_(VOLUME) + "select i, k, round(avg(v), 4) v from vol where label > 10 group by i, k")
def project_average(spark, d):
    return rounded(E.project(volume(spark, d).where("label > 10"), "j", "avg"))


@query(with_(VOLUME) + "select i, j, min(k)::int depth, arg_min(label::double, k) v from vol where label > 20 group by i, j")
def project_first_hit(spark, d):
    return E.first_hit(volume(spark, d).withColumn("v", F.col("label").cast("double")), "k", 20)


# --- statistics ---------------------------------------------------------------------------------------------------

ROI = "roi as (select t, (voxel % 8 + 1)::int roi, avg(v) v from ser group by 1, 2)"


def _roi(spark, d):
    return A.roi_mean(series(spark, d), (F.col("voxel") % 8 + 1).cast("int"))


@query(with_(SERIES, ROI) + "select t, roi, round(v, 4) v from roi")
def roi_mean(spark, d):
    return rounded(_roi(spark, d))


@query(with_(VOLUME) + "select label, count(*) n, round(avg(i), 4) ci, round(avg(j), 4) cj, round(avg(k), 4) ck from vol group by label")
def roi_volume(spark, d):
    return rounded(A.roi_volume(volume(spark, d)))


@query(with_(SERIES) + "select voxel, round(avg(v), 4) mean, round(avg(v) + stddev_samp(v), 4) mean_sigma, round(sqrt(avg(v * v)), 4) rms, max(v) max, min(v) min from ser group by voxel")
def time_stats(spark, d):
    return A.time_stats(series(spark, d)).select("voxel", *[F.round(c, 4).alias(c) for c in ("mean", "mean_sigma", "rms")], "max", "min")


@query(with_(SERIES) + "select voxel, t, round(case when stddev_pop(v) over w > 0 then (v - avg(v) over w) / stddev_pop(v) over w else 0.0 end, 4) v from ser window w as (partition by voxel)")
def timeseries_normalize(spark, d):
    return rounded(A.normalize_series(series(spark, d)))


RANGE = """r as (select min(v) vmin, max(v) vmax, count(*) n from vol),
 h as (select floor(255 / (vmax - vmin) * (v - vmin)) bin, count(*) c from vol, r group by 1),
 cum as (select bin, sum(c) over (order by bin) / (select n from r) p from h),
 rr as (select vmin + (select min(bin) from cum where p > 0.02) * ((vmax - vmin) / 255) lo, vmin + (select min(bin) from cum where p > 0.98) * ((vmax - vmin) / 255) hi, vmin, vmax from r)"""


@query(with_(VOLUME, RANGE) + "select round(lo, 4) lo, round(hi, 4) hi, vmin, vmax from rr")
def robust_range(spark, d):
    return A.robust_range(volume(spark, d), 0.02, 0.98).select(F.round("lo", 4).alias("lo"), F.round("hi", 4).alias("hi"), "vmin", "vmax")


@query(with_(VOLUME, RANGE) + "select voxel, floor((least(greatest(v, lo), hi) - lo) * 1024 / (hi - lo) + 0.5)::int v from vol, rr")
def normalize_short(spark, d):
    return A.normalize_image(volume(spark, d), 0.02, 0.98)


@query(with_(VOLUME, "o as (select v, row_number() over (order by v) - 1 as rk, count(*) over () n from vol)", "q as (select max(case when rk = n // 4 then v end) a, max(case when rk = n // 2 then v end) b, max(case when rk = 3 * n // 4 then v end) c from o)") + "select voxel, round((v - b) / greatest(c - a, 0.001), 4) v from vol, q")
def quantile_normalize(spark, d):
    return rounded(A.quantile_normalize(volume(spark, d)))


@query(with_(VOLUME, "h as (select floor((v - 900) / 25 + 0.5)::int bin, count(*) count from vol group by 1)") + "select bin, count from h where bin between 0 and 63")
def histogram_counts(spark, d):
    return A.histogram(volume(spark, d), 900, 25, 64)


ENTROPY = "(select -sum(c / n * ln(c / n)) from (select {g}, count(*)::double c, (select count(*) from b)::double n from b group by {g}))"


@query("with b as (select floor(l_quantity / 5) x, floor(l_discount * 50) y from lineitem), e as (select " + ", ".join(ENTROPY.format(g=g) + f" h{g.replace(', ', '')}" for g in ("x", "y", "x, y")) + ") select round(hx, 5) hx, round(hy, 5) hy, round(hxy, 5) hxy, round(hx + hy - hxy, 5) mi, round((hx + hy) / hxy - 1, 5) nmi from e")
def joint_histogram_mi(spark, d):
    l = read(spark, d, "lineitem")  # noqa: E741
    return rounded(A.joint_measures(l, F.floor(F.col("l_quantity") / 5), F.floor(F.col("l_discount") * 50)), 5)


CORR = "cor as (select a.c a, b.c b, case when stddev_pop(a.v) > 0 and stddev_pop(b.v) > 0 then corr(a.v, b.v) else 0.0 end r from (select t rw, roi c, v from roi) a join (select t rw, roi c, v from roi) b on a.rw = b.rw and a.c <= b.c group by 1, 2)"


def _corr(spark, d):
    return A.correlation(_roi(spark, d).select(F.col("t").alias("row"), F.col("roi").alias("col"), "v"))


@query(with_(SERIES, ROI, CORR) + "select a, b, round(r, 4) r from cor")
def corr_matrix(spark, d):
    return rounded(_corr(spark, d))


@query(with_(SERIES, ROI, CORR) + "select a, b, round(case when abs(r) < 0.99999 then 0.5 * ln((1 + r) / (1 - r)) when r > 0 then 6.103 else -6.103 end, 4) z from cor")
def corr_fisher_z(spark, d):
    return _corr(spark, d).select("a", "b", F.round(A.fisher_z(F.col("r")), 4).alias("z"))


@query(with_(SERIES) + "select s.voxel, m.voxel as seed, round(case when stddev_pop(s.v) > 0 and stddev_pop(m.v) > 0 then corr(s.v, m.v) else 0.0 end, 4) r from ser s join ser m on s.t = m.t and m.voxel < 3 group by 1, 2")
def seed_corr(spark, d):
    s = series(spark, d)
    return rounded(A.seed_correlation(s, s.where("voxel < 3").select(F.col("voxel").alias("seed"), "t", F.col("v").alias("s"))))


@query(with_(SERIES) + "select voxel, round(regr_slope(v, t), 4) beta, round(regr_intercept(v, t), 4) constant, round(regr_r2(v, t), 4) r2 from ser group by voxel")
def glm_slope(spark, d):
    return rounded(A.glm_slope(series(spark, d)))


@query(with_(VOLUME, "c as (select label, floor(v / 50)::bigint x, count(*) n from vol group by 1, 2)") + "select label, x as mode, n from c qualify row_number() over (partition by label order by n desc, x) = 1")
def mode_by_label(spark, d):
    return A.mode_by_label(volume(spark, d), F.floor(F.col("v") / 50))


@query(CELLS.join(["with ", " "]) + "select a.col a, b.col b, round(case when stddev_pop(a.v) > 0 and stddev_pop(b.v) > 0 then corr(a.v, b.v) else 0.0 end, 4) r from cells a join cells b on a.row = b.row and a.col <= b.col group by 1, 2")
def matrix_correlation(spark, d):
    return rounded(A.correlation(cells(spark, d)))


@query("select p_brand, p_size, count(*) n, round(avg(p_retailprice), 4) v from part group by cube (p_brand, p_size)")
def cube_mean(spark, d):
    return rounded(read(spark, d, "part").cube("p_brand", "p_size").agg(F.count(F.lit(1)).alias("n"), F.avg("p_retailprice").alias("v")))


CPM_SQL = """
with d as (select vec_id subject, label::double y, e.edge, embedding[e.edge + 1]::double x, (vec_id % 3)::int fold from embeddings, (select unnest(range(64)) edge) e),
 s as (select d.*, f.test from d, (select unnest(range(3)) test) f),
 k as (select test, edge, corr(x, y) r from s where fold <> test group by 1, 2 having abs(corr(x, y)) >= 0.05),
 c as (select s.test, subject, fold, y, sum(sign(r) * x) sc from s join k on s.test = k.test and s.edge = k.edge group by 1, 2, 3, 4),
 l as (select test, regr_slope(y, sc) b, regr_intercept(y, sc) a from c where fold <> test group by 1)
select subject, y, round(a + b * sc, 3) predicted from c join l on c.test = l.test where fold = c.test
"""


@query(CPM_SQL)
def cpm_fold_predict(spark, d):
    e = read(spark, d, "embeddings").select(F.col("vec_id").alias("subject"), F.col("label").cast("double").alias("y"), F.posexplode("embedding").alias("edge", "x")).withColumn("x", F.col("x").cast("double"))
    return rounded(A.edge_prediction(e, least=0.05), 3)


# --- time ---------------------------------------------------------------------------------------------------------


def _butter_sql(cut: float, high: bool, source: str, out: str) -> str:
    b0, b1, b2, a1, a2 = T.coefficients(cut, 1.0, high)
    return f"""{out} as (select voxel, t, v as x, lag(v, 1, 0.0::double) over w x1, lag(v, 2, 0.0::double) over w x2 from {source} window w as (partition by voxel order by t)),
 {out}_r as (select voxel, t, {b0!r}::double * x y, 0.0::double y1 from {out} where t = 0
 union all select n.voxel, n.t, {b0!r}::double * n.x + {b1!r}::double * n.x1 + {b2!r}::double * n.x2 - {a1!r}::double * p.y - {a2!r}::double * p.y1, p.y from {out}_r p join {out} n on n.voxel = p.voxel and n.t = p.t + 1),
 {out}_y as (select voxel, t, y as v from {out}_r)"""


@query(with_(SERIES, _butter_sql(0.15, False, "ser", "lo")) + "select voxel, t, round(v, 3) v from lo_y")
def butterworth_low(spark, d):
    return rounded(T.long(T.butterworth(T.wide(series(spark, d)), high=0.15)), 3)


@query(with_(SERIES, _butter_sql(0.03, True, "ser", "hi")) + "select voxel, t, round(v, 3) v from hi_y")
def butterworth_high(spark, d):
    return rounded(T.long(T.butterworth(T.wide(series(spark, d)), low=0.03)), 3)


@query(with_(SERIES, _butter_sql(0.15, False, "ser", "lo"), _butter_sql(0.03, True, "lo_y", "hi")) + "select voxel, t, round(v, 3) v from hi_y")
def butterworth_band(spark, d):
    return rounded(T.long(T.butterworth(T.wide(series(spark, d)), low=0.03, high=0.15)), 3)


@query(with_(SERIES) + "select voxel, t, first_value(case when v > 50 then v end ignore nulls) over (partition by voxel order by t rows between current row and unbounded following) v from ser")
def backfill(spark, d):
    return T.backfill(series(spark, d), F.col("v") > 50)


DRIFT = """b as (select t, x, x0, y1 from (select i::int t, 1 / sqrt(30.0::double) x0, (-1 + 2 * i / 29.0::double) x, 0 y1 from (select unnest(range(30)) i))),
 c as (select voxel, sum(v * x0) c0, sum(v * x) / (select sum(x * x) from b) c1 from ser join b using (t) group by voxel)"""


@query(with_(SERIES, DRIFT) + "select s.voxel, s.t, round(v - c0 * x0 - c1 * x, 3) v from ser s join b on s.t = b.t join c on s.voxel = c.voxel")
def drift_regress(spark, d):
    return rounded(T.long(T.drift_correct(T.wide(series(spark, d)), 30, 1)), 3)


GLOBAL = "g as (select t, avg(v) g from ser group by t), u as (select t, g / (select sqrt(sum(g * g)) from g) u from g)"


@query(with_(SERIES, GLOBAL) + "select voxel, s.t, round(v - u * sum(v * u) over (partition by voxel), 3) v from ser s join u on s.t = u.t")
def global_regress(spark, d):
    return rounded(T.global_regress(series(spark, d)), 3)


@query(with_(SERIES, GLOBAL) + "select voxel, s.t, round(v - u * sum(v * u) over w / sum(u * u) over w, 3) v from ser s join u on s.t = u.t window w as (partition by voxel)")
def dual_regress(spark, d):
    s = series(spark, d)
    g = s.groupBy("t").agg(F.avg("v").alias("u"))
    return rounded(T.dual_regress(s.join(g, "t")), 3)


@query(with_(SERIES, "lo as (select voxel, t, v, min(v) over (partition by voxel order by t rows between 2 preceding and 2 following) m from ser)") + "select voxel, t, round(v - max(m) over (partition by voxel order by t rows between 2 preceding and 2 following), 4) v from lo")
def top_hat(spark, d):
    return rounded(T.top_hat(series(spark, d), 2))


@query(with_(SERIES) + "select voxel, t, round(case when avg(v) over w <> 0 then v / avg(v) over w else 0.0 end, 4) v from ser window w as (partition by voxel)")
def df_over_f(spark, d):
    return rounded(T.df_over_f(series(spark, d)))


INTERVALS = "iv as (select (user_id % 5)::varchar run, event_type task, date_diff('hour', timestamp '2024-01-01', ts)::int lo, (date_diff('hour', timestamp '2024-01-01', ts) + 3)::int hi from events)"


def _intervals(spark, d):
    lo = F.floor((F.unix_micros(F.date_trunc("hour", F.col("ts").cast("timestamp"))) - F.unix_micros(F.lit("2024-01-01 00:00:00").cast("timestamp"))) / 3_600_000_000).cast("int")
    return read(spark, d, "events").select((F.col("user_id") % 5).cast("string").alias("run"), F.col("event_type").alias("task"), lo.alias("lo"), (lo + 3).alias("hi"))


@query("with " + INTERVALS + " select distinct run, task, f::int frame from (select run, task, unnest(range(lo, hi)) f from iv)")
def interval_to_frames(spark, d):
    return T.intervals_to_frames(_intervals(spark, d))


@query("with " + INTERVALS + " select t::int t, count(*) n from (select unnest(range(0, 720)) t) f join iv on t >= lo and t < hi group by 1")
def interval_join(spark, d):
    f = spark.range(0, 720).select(F.col("id").cast("int").alias("t"))
    return J.in_interval(f, _intervals(spark, d), 24).groupBy("t").agg(F.count(F.lit(1)).alias("n"))


# --- space --------------------------------------------------------------------------------------------------------


def _clamped(kernel: list[float], axis: str, source: str, out: str) -> str:
    rest = [a for a in "ijk" if a != axis]
    r = len(kernel) // 2
    terms = []
    for x, c in zip(range(-r, r + 1), kernel):
        near = "v" if x == 0 else f"coalesce({'lag' if x < 0 else 'lead'}(v, {abs(x)}) over w, {'first_value' if x < 0 else 'last_value'}(v) over a)"
        terms.append(f"{c!r}::double * {near}")
    part = ", ".join(rest)
    return f"{out} as (select voxel, i, j, k, {' + '.join(terms)} v from {source} window w as (partition by {part} order by {axis}), a as (partition by {part} order by {axis} rows between unbounded preceding and unbounded following))"


_G = P.gaussian_kernel(1.0)


@query(with_(VOLUME, _clamped(_G, "i", "vol", "s1"), _clamped(_G, "j", "s1", "s2"), _clamped(_G, "k", "s2", "s3")) + "select voxel, round(v, 3) v from s3")
def gaussian_smooth(spark, d):
    return rounded(P.smooth(volume(spark, d), 1.0).select("voxel", "v"), 3)


_D = P.gradient_kernel(1.0)


@query(with_(VOLUME, *[_clamped(_D, a, "vol", f"g{a}") for a in "ijk"]) + "select gi.voxel, round(gi.v, 3) gi, round(gj.v, 3) gj, round(gk.v, 3) gk from gi join gj using (voxel) join gk using (voxel)")
def gradient_image(spark, d):
    return rounded(P.gradient(volume(spark, d), 1.0), 3)


BOX = "select a.voxel, {f} v from vol a join vol b on abs(a.i - b.i) <= 1 and abs(a.j - b.j) <= 1 and a.k = b.k group by a.voxel"


@query(with_(VOLUME) + BOX.format(f="list_sort(list(b.v))[count(*) // 2 + 1]"))
def median_filter(spark, d):
    return P.median_filter(volume(spark, d))


def _morph(how: str, expr: str):
    def f(spark, d):
        img = volume(spark, d).withColumn("v", F.when(F.col("label") > 20, 1.0).otherwise(0.0))
        return P.morphology(img, how)

    f.__name__ = f"morph_{how}"
    return query(with_(VOLUME.replace("vol as", "raw as"), "vol as (select voxel, i, j, k, case when label > 20 then 1.0::double else 0.0::double end v from raw)") + BOX.format(f=expr))(f)


for _how, _expr in (("erode", "min(b.v)"), ("dilate", "max(b.v)"), ("median", "case when 2 * sum(b.v) > count(*) then 1.0::double else 0.0::double end")):
    _morph(_how, _expr)


@query(with_(VOLUME, "o as (select j, k, o, o * 1.5 x from (select distinct j, k from vol), (select unnest(range(7)) o))") + "select o::int i, o.j, o.k, round(sum(v * case when i = floor(x) then 1 - (x - floor(x)) else x - floor(x) end), 4) v from o join vol on vol.j = o.j and vol.k = o.k and vol.i in (floor(x), least(floor(x) + 1, 9)) group by 1, 2, 3")
def resample_axis(spark, d):
    return rounded(P.resample(volume(spark, d), 1.5, {"i": 10}))


CC = """ins as (select voxel, i, j, k from vol where label > 30),
 nb as (select a.voxel a, b.voxel b from ins a join ins b on abs(a.i - b.i) + abs(a.j - b.j) + abs(a.k - b.k) = 1),
 reach as (select voxel a, voxel c from ins union select nb.b, reach.c from reach join nb on nb.a = reach.a),
 comp as (select a voxel, min(c) component from reach group by a)"""


@query(with_(VOLUME, CC) + "select voxel, component from comp")
def components_image(spark, d):
    return P.components(volume(spark, d), F.col("label") > 30)


@query(with_(VOLUME, CC) + "select component, count(*) n from comp group by 1 having count(*) >= 3")
def components_size(spark, d):
    return P.components(volume(spark, d), F.col("label") > 30).groupBy("component").agg(F.count(F.lit(1)).alias("n")).where("n >= 3")


@query(with_(VOLUME, CC) + "select voxel from comp where component = (select component from comp where voxel = (select min(voxel) from ins))")
def seed_connected(spark, d):
    c = P.components(volume(spark, d), F.col("label") > 30)
    seed = c.agg(F.min("voxel").alias("voxel")).join(c, "voxel").select("component")
    return c.join(F.broadcast(seed), "component", "left_semi").select("voxel")  # one row


@query(with_(VOLUME) + "select voxel, row_number() over (order by voxel) as id from vol where label > 25")
def index_map(spark, d):
    return volume(spark, d).where("label > 25").select("voxel").transform(lambda x: A.global_rank(x, "voxel")).select("voxel", F.col("rank").alias("id"))


# --- distance joins -----------------------------------------------------------------------------------------------


def _points(spark, d):
    return volume(spark, d).select(F.col("voxel").alias("id"), F.col("i").cast("double").alias("x"), F.col("j").cast("double").alias("y"), F.col("k").cast("double").alias("z"), "label")


@query(with_(VOLUME) + "select a.voxel a, b.voxel b, ((a.i - b.i) * (a.i - b.i) + (a.j - b.j) * (a.j - b.j) + (a.k - b.k) * (a.k - b.k))::double d2 from vol a join vol b on a.voxel < b.voxel and a.label = b.label where (a.i - b.i) * (a.i - b.i) + (a.j - b.j) * (a.j - b.j) + (a.k - b.k) * (a.k - b.k) <= 9")
def radius_pairs(spark, d):
    return J.radius_pairs(_points(spark, d), 3.0, "label")


@query(with_(VOLUME, "x as (select q.voxel q, p.voxel p, ((q.i - p.i) * (q.i - p.i) + (q.j - p.j) * (q.j - p.j) + (q.k - p.k) * (q.k - p.k))::double d2 from vol q, vol p where q.label <= 10 and p.label > 40)") + "select q, p, d2 from x qualify row_number() over (partition by q order by d2, p) = 1")
def nearest_point(spark, d):
    p = _points(spark, d)
    return J.nearest(p.where("label <= 10"), p.where("label > 40"))


@query("with x as (select a.vec_id id, b.vec_id other, round(list_sum(list_transform(range(1, 65), lambda n: (a.embedding[n] - b.embedding[n])::double * (a.embedding[n] - b.embedding[n])::double)), 4) d2 from embeddings a join embeddings b on a.label = b.label and a.vec_id <> b.vec_id) select id, other, d2, row_number() over (partition by id order by d2, other)::int rank from x qualify row_number() over (partition by id order by d2, other) <= 3")
def knn_selfjoin(spark, d):
    return N.knn_pairs(read(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "label", F.col("embedding").alias("x")), 3)


# --- graphs -------------------------------------------------------------------------------------------------------

DEGREE = "deg as (select src node, sum(abs(pos)) pos, sum(abs(neg)) neg, sum(abs(pos)) + sum(abs(neg)) total, sum(abs(pos)) - sum(abs(neg)) difference from edges group by src)"
FLAG = "cut as (select median(total) m from deg), core as (select node from deg, cut where total >= m), fl as (select node, case when node in (select node from core) then 2 when node in (select dst from edges where src in (select node from core) and (pos <> 0 or neg <> 0)) then 1 else 0 end::int flag from deg)"


def _flags(spark, d):
    e = edges(spark, d)
    m = G.degree(e).agg(F.expr("percentile(total, 0.5)").alias("m")).first()["m"]  # one number
    return e, G.flags(e, m)


@query(with_(EDGES, DEGREE) + "select * from deg")
def node_degree(spark, d):
    return G.degree(edges(spark, d))


@query(with_(EDGES, DEGREE, FLAG) + "select node, flag from fl")
def flag_neighbours(spark, d):
    return _flags(spark, d)[1]


@query(with_(EDGES, DEGREE, FLAG) + "select e.src, e.dst, e.pos from edges e join fl a on e.src = a.node join fl b on e.dst = b.node where e.src < e.dst and abs(e.pos) >= 20 and a.flag + b.flag > 2")
def line_pairs(spark, d):
    e, f = _flags(spark, d)
    return G.line_pairs(e, f, 20)


# --- scalars, strings, nested values ------------------------------------------------------------------------------


@query("select p_partkey, least(greatest(p_size, 10), 40)::int clamped, ((p_size - 30) % 7 + 7) % 7 as cyclic, round(p_retailprice * 10) / 10 rounded, round(case when abs(x) < 1 then 2.0 / 3 - x * x + abs(x) * x * x / 2 when abs(x) < 2 then (2 - abs(x)) * (2 - abs(x)) * (2 - abs(x)) / 6 else 0 end, 5) spline, round(p_size * p_size / (p_size * p_size + 25.001), 5) valley from (select *, (p_size / 10.0::double - 2.5) x from part)")
def scalar_functions(spark, d):
    x = F.col("p_size") / 10.0 - 2.5
    return read(spark, d, "part").select(
        "p_partkey", S.clamp(F.col("p_size"), 10, 40).alias("clamped"), S.cyclic(F.col("p_size") - 30, 7).alias("cyclic"), S.scaled_round(F.col("p_retailprice"), 10).alias("rounded"),
        F.round(S.b_spline(x), 5).alias("spline"), F.round(S.valley(F.col("p_size").cast("double"), 5.0), 5).alias("valley"),
    )


@query("select o_orderkey, date_diff('day', o_orderdate::date, date '2000-01-01')::int as days, (date_diff('month', o_orderdate::date, date '2000-01-01') + case when 1 - day(o_orderdate) >= 16 then 1 when 1 - day(o_orderdate) <= -16 then -1 else 0 end)::int as months from orders")
def date_intervals(spark, d):
    a, b = F.col("o_orderdate").cast("date"), F.lit("2000-01-01").cast("date")
    return read(spark, d, "orders").select("o_orderkey", F.datediff(b, a).alias("days"), S.whole_months(a, b).alias("months"))


@query("select page_id, regexp_extract(url, '([^/]*)$', 1) base, regexp_extract(url, '^(.*)/[^/]*$', 1) dir, sha256(html) sha, regexp_replace(url, '[0-9]+', '#', 'g') norm from pages")
def path_parts(spark, d):
    return read(spark, d, "pages").select("page_id", S.base_name(F.col("url")).alias("base"), S.dir_name(F.col("url")).alias("dir"), F.sha2("html", 256).alias("sha"), F.regexp_replace("url", "[0-9]+", "#").alias("norm"))


@query("select event_id, (props ->> '$.k')::int k from events")
def json_props(spark, d):
    return read(spark, d, "events").select("event_id", F.from_json("props", "k int")["k"].alias("k"))


@query("select vec_id, list_max(embedding) hi, len(embedding)::int n, list_position(embedding, list_max(embedding))::bigint as place from embeddings")
def array_functions(spark, d):
    m = F.array_max("embedding")
    return read(spark, d, "embeddings").select("vec_id", m.alias("hi"), F.size("embedding").alias("n"), F.array_position("embedding", m).alias("place"))


# --- relational ---------------------------------------------------------------------------------------------------


@query("select c_custkey, c_name from customer where exists (select 1 from orders where o_custkey = c_custkey and o_totalprice > 300000)")
def join_semi(spark, d):
    return read(spark, d, "customer").join(read(spark, d, "orders").where("o_totalprice > 300000"), F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey", "c_name")


@query("select c_custkey, c_name from customer where not exists (select 1 from orders where o_custkey = c_custkey and o_totalprice > 300000)")
def join_anti(spark, d):
    return read(spark, d, "customer").join(read(spark, d, "orders").where("o_totalprice > 300000"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey", "c_name")


@query("select r_name, n_name, l_returnflag, count(*) n, round(sum(l_extendedprice), 2) v from lineitem join supplier on l_suppkey = s_suppkey join nation on s_nationkey = n_nationkey join region on n_regionkey = r_regionkey group by rollup (r_name, n_name, l_returnflag)")
def join_rollup(spark, d):
    dim = read(spark, d, "supplier").join(read(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).join(read(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("s_suppkey", "n_name", "r_name")
    j = read(spark, d, "lineitem").join(dim, F.col("l_suppkey") == F.col("s_suppkey"))
    return rounded(j.rollup("r_name", "n_name", "l_returnflag").agg(F.count(F.lit(1)).alias("n"), F.sum("l_extendedprice").alias("v")), 2)


@query("select user_id, event_id, row_number() over w::int rn, rank() over w::int rk, ntile(4) over w::int q, lag(value) over w prev, lead(event_type) over w nxt from events window w as (partition by user_id order by ts, event_id)")
def rank_family(spark, d):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return read(spark, d, "events").select("user_id", "event_id", F.row_number().over(w).alias("rn"), F.rank().over(w).alias("rk"), F.ntile(4).over(w).alias("q"), F.lag("value").over(w).alias("prev"), F.lead("event_type").over(w).alias("nxt"))


@query("(select l_partkey from lineitem where l_quantity > 45 intersect select p_partkey from part where p_size > 10) except select p_partkey from part where p_retailprice > 1500")
def set_operations(spark, d):
    p = read(spark, d, "part")
    a = read(spark, d, "lineitem").where("l_quantity > 45").select("l_partkey")
    return a.intersect(p.where("p_size > 10").select("p_partkey")).exceptAll(p.where("p_retailprice > 1500").select("p_partkey"))


@query("select c_mktsegment, c_custkey, c_acctbal from customer qualify row_number() over (partition by c_mktsegment order by c_acctbal desc, c_custkey) <= 5")
def top_per_group(spark, d):
    w = Window.partitionBy("c_mktsegment").orderBy(F.desc("c_acctbal"), "c_custkey")
    return read(spark, d, "customer").withColumn("rn", F.row_number().over(w)).where("rn <= 5").select("c_mktsegment", "c_custkey", "c_acctbal")


@query("select event_type, time_bucket(interval '1 hour', ts) as start, count(*) n, round(sum(value), 4) v from events group by 1, 2")
def tumbling_window(spark, d):
    e = read(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    g = e.groupBy("event_type", F.window("ts", "1 hour").alias("w")).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("v"))
    return rounded(g.select("event_type", F.col("w.start").cast("timestamp_ntz").alias("start"), "n", "v"))


# --- geometry -----------------------------------------------------------------------------------------------------

MOVE = [[1.0, 0.0, 0.0, 0.25], [0.0, 1.0, 0.0, 0.5], [0.0, 0.0, 1.0, 0.0]]
AFFINE = [[1.1, 0.05, 0.0, 1.0], [-0.05, 0.9, 0.0, -2.0], [0.0, 0.02, 1.2, 0.5]]


@query(with_(VOLUME, "s as (select i, j, k, least(i + 0.25::double, 9) x, least(j + 0.5::double, 9) y from vol)") + "select s.i, s.j, s.k, round(sum(v * case when vol.i = floor(x) then 1 - (x - floor(x)) else x - floor(x) end * case when vol.j = floor(y) then 1 - (y - floor(y)) else y - floor(y) end), 4) v from s join vol on vol.k = s.k and vol.i in (floor(x), floor(x) + 1) and vol.j in (floor(y), floor(y) + 1) group by 1, 2, 3")
def reslice_linear(spark, d):
    v = volume(spark, d)
    top = v.agg(F.max("k").alias("k")).first()["k"]  # one number
    return rounded(M.reslice(v, v.select("i", "j", "k"), MOVE, (10, 10, top + 1)))


@query(with_(VOLUME) + "select voxel, i, j, k, round((1.1 * i + 0.05 * j + 1.0 - i)::double, 5) dx, round((-0.05 * i + 0.9 * j - 2.0 - j)::double, 5) dy, round((0.02 * j + 1.2 * k + 0.5 - k)::double, 5) dz from vol")
def displacement_field(spark, d):
    return rounded(M.displacement(volume(spark, d), AFFINE), 5)


@query(with_(VOLUME) + "select voxel, case when i in (0, 9) or j in (0, 9) or k = 0 or k = (select max(k) from vol) then 0.0 else round(100 * (1.2::double * (1.1 * 0.9 + 0.05 * 0.05) - 1), 3) end::double v from vol")
def jacobian_image(spark, d):
    return rounded(M.jacobian(M.displacement(volume(spark, d), AFFINE)), 3)


@query(with_(VOLUME, "p as (select i x, j y, k z, 0.9 * i - 0.1 * j + 1 + label / 100.0 u, 0.1 * i + 0.9 * j v, k * 1.0 w from vol)") + "select round(avg(sqrt((1.1 * x + 0.05 * y + 1.0 - u) ** 2 + (-0.05 * x + 0.9 * y - 2.0 - v) ** 2 + (0.02 * y + 1.2 * z + 0.5 - w) ** 2)), 4) mean, round(sqrt(avg((1.1 * x + 0.05 * y + 1.0 - u) ** 2 + (-0.05 * x + 0.9 * y - 2.0 - v) ** 2 + (0.02 * y + 1.2 * z + 0.5 - w) ** 2)), 4) rms from p")
def mapping_error(spark, d):
    x, y, z = (F.col(c).cast("double") for c in "ijk")
    p = volume(spark, d).select(x.alias("x"), y.alias("y"), z.alias("z"), (0.9 * x - 0.1 * y + 1 + F.col("label") / 100.0).alias("u"), (0.1 * x + 0.9 * y).alias("v"), z.alias("w"))
    return rounded(M.mapping_error(p, AFFINE))


@query(with_(VOLUME) + "select a.voxel, round(sum(b.v * w) / sum(w), 4) v from (select a.voxel, b.v, exp(-((a.i - b.i) ** 2 + (a.j - b.j) ** 2) / 2.0 - (a.v - b.v) ** 2 / 20000.0) w from vol a join vol b on abs(a.i - b.i) <= 1 and abs(a.j - b.j) <= 1 and a.k = b.k) b(voxel, v, w) join vol a using (voxel) group by 1")
def bilateral_filter(spark, d):
    return rounded(P.bilateral(volume(spark, d), 1, 1.0, 100.0))


@query(with_(VOLUME) + "select p.pi, p.pj, k as pk, list(v order by j, i) vals from (select a::bigint pi, b::bigint pj from (select unnest(range(5)) a), (select unnest(range(5)) b)) p join vol on i between pi * 2 and pi * 2 + 3 and j between pj * 2 and pj * 2 + 3 group by 1, 2, 3 having count(*) = 16")
def image_patches(spark, d):
    return P.patches(volume(spark, d), 4, 2)


SMOOTHED = "(select a.voxel, b.label, count(*) + max(case when a.voxel = b.voxel then 1.5 else 0 end) - max(case when a.voxel = b.voxel then 1 else 0 end) n from {t} a join {t} b on abs(a.i - b.i) + abs(a.j - b.j) + abs(a.k - b.k) <= 1 group by 1, 2)"


@query(with_(VOLUME.replace("vol as", "raw as"), "vol as (select voxel, i, j, k, label // 10 as label from raw)") + f"select voxel, label from {SMOOTHED.format(t='vol')} qualify row_number() over (partition by voxel order by n desc, label) = 1")
def smooth_labels(spark, d):
    return P.smooth_labels(volume(spark, d).withColumn("label", F.floor(F.col("label") / 10).cast("int")), 1.5, 1)


@query("with " + INTERVALS + ", o as (select distinct run, task, unnest(range(lo, hi)) f from iv) select run, (f + dd)::int as frame, task, round(sum(0.50212657 * (tanh(tan(0.5 * pi() * (1.6 * dd / 12.0 - 0.8))) + 0.99576486)), 4) v from o, (select unnest(range(12)) dd) where f + dd < 720 group by 1, 2, 3")
def hrf_design(spark, d):
    return rounded(T.hrf_design(_intervals(spark, d), 720, 12))


# --- clusters, fits, matrices and more ----------------------------------------------------------------------------

LABELS = VOLUME.replace("p_retailprice v", "p_size::double v")
OVER = CC.replace("label > 30", "v > 30")


def _label_image(spark, d):
    return volume(spark, d).withColumn("v", F.col("label").cast("double"))


@query(with_(LABELS, OVER, "big as (select component from comp group by 1 having count(*) >= 4)") + "select voxel, case when voxel in (select voxel from comp where component in (select component from big)) then v else 0.0 end::double v from vol")
def cluster_threshold(spark, d):
    return P.cluster_threshold(_label_image(spark, d), 30, 4)


@query(with_(LABELS, OVER, "top as (select component from comp group by 1 order by count(*) desc, component limit 1)") + "select voxel, case when voxel in (select voxel from comp where component = (select component from top)) then v else 0.0 end::double v from vol")
def components_largest(spark, d):
    return P.cluster_threshold(_label_image(spark, d), 30, 1, largest_only=True)


@query(with_(LABELS, OVER) + "select component, count(*) n, (arg_max(voxel, v * 1000000 - voxel))::bigint peak, max(v) v from comp join vol using (voxel) group by 1")
def cluster_peaks(spark, d):
    return P.cluster_peaks(_label_image(spark, d), 30)


def _open_close(name: str, one: str, two: str):
    def f(spark, d):
        return P.open_close(volume(spark, d).withColumn("v", F.when(F.col("label") > 20, 1.0).otherwise(0.0)), name == "opening")

    f.__name__ = f"morph_{name}"
    raw = VOLUME.replace("vol as", "raw as")
    start = "start as (select voxel, i, j, k, case when label > 20 then 1.0::double else 0.0::double end v from raw)"
    step = "(select a.voxel, a.i, a.j, a.k, {f}(b.v) v from {t} a join {t} b on abs(a.i - b.i) <= 1 and abs(a.j - b.j) <= 1 and a.k = b.k group by all)"
    return query(with_(raw, start, "mid as " + step.format(f=one, t="start"), "done as " + step.format(f=two, t="mid")) + "select voxel, v from done")(f)


_open_close("opening", "min", "max")
_open_close("closing", "max", "min")

_P = T.legendre(30, 2)
_TERMS = "p as (select t, -1 + 2 * t / 29.0::double x, (3 * (-1 + 2 * t / 29.0::double) ** 2 - 1) / 2 y from (select unnest(range(30))::int t)), sums as (select count(*)::double n, sum(y) sy, sum(y * y) syy, sum(x * x) sxx from p)"
_FIT = "m as (select voxel, sum(v) v0, sum(v * x) v1, sum(v * y) v2 from ser join p using (t) group by 1), fit as (select voxel, (v0 * syy - v2 * sy) / (n * syy - sy * sy) b0, v1 / sxx b1, (v2 * n - v0 * sy) / (n * syy - sy * sy) b2 from m, sums)"


@query(with_(SERIES, _TERMS, _FIT) + "select voxel, 0::int regressor, round(b0, 3) beta from fit union all select voxel, 1, round(b1, 3) from fit union all select voxel, 2, round(b2, 3) from fit")
def glm_design(spark, d):
    return rounded(T.glm(T.wide(series(spark, d)), _P), 3)


@query(with_(SERIES, _TERMS, _FIT) + "select voxel, t, round(v - b0 - b1 * x - b2 * y, 3) v from ser join fit using (voxel) join p using (t)")
def drift_quadratic(spark, d):
    return rounded(T.long(T.drift_correct(T.wide(series(spark, d)), 30, 2)), 3)


@query(with_(SERIES, "w as (select t, 1 + t % 3 w from (select unnest(range(30))::int t))", "s as (select voxel, sum(w) n, sum(w * t) st, sum(w * t * t) stt, sum(w * v) sv, sum(w * t * v) stv from ser join w using (t) group by 1)", "f as (select voxel, (n * stv - st * sv) / (n * stt - st * st) b, sv / n - (n * stv - st * sv) / (n * stt - st * st) * st / n a from s)") + "select voxel, t, round(v - a - b * t, 3) v from ser join f using (voxel)")
def regress_weighted(spark, d):
    out = T.regress_weighted(T.wide(series(spark, d)), [[1.0] * 30, [float(t) for t in range(30)]], [1.0 + t % 3 for t in range(30)])
    return rounded(T.long(out), 3)


@query(with_(SERIES, "x as (select a.t, b.t other, round(sum((a.v - b.v) ** 2), 4) d2 from ser a join ser b using (voxel) where a.t <> b.t group by 1, 2)") + "select t, other, d2, row_number() over (partition by t order by d2, other)::int rank from x qualify row_number() over (partition by t order by d2, other) <= 3")
def temporal_knn(spark, d):
    return T.frame_neighbours(series(spark, d), 3)


@query("select round((sum(w * x * y) / sum(w) - sum(w * x) * sum(w * y) / sum(w) ** 2) / sqrt((sum(w * x * x) / sum(w) - (sum(w * x) / sum(w)) ** 2) * (sum(w * y * y) / sum(w) - (sum(w * y) / sum(w)) ** 2)), 5) r from (select l_quantity x, l_extendedprice y, l_discount + 0.01 w from lineitem)")
def weighted_correlation(spark, d):
    return rounded(A.weighted_correlation(read(spark, d, "lineitem").select(F.col("l_quantity").alias("x"), F.col("l_extendedprice").alias("y"), (F.col("l_discount") + 0.01).alias("w"))), 5)


@query(with_(VOLUME) + "select round(sum((v - 20 * label) ** 2), 2) ssd, round(avg((v - 20 * label) ** 2), 2) mse, round(corr(v, label) ** 2, 6) cc2 from vol")
def image_similarity(spark, d):
    out = A.image_similarity(volume(spark, d).select(F.col("v").alias("x"), (F.col("label") * 20.0).alias("y")))
    return out.select(F.round("ssd", 2).alias("ssd"), F.round("mse", 2).alias("mse"), F.round("cc2", 6).alias("cc2"))


@query("with r as (select rank() over (order by l_quantity) + (count(*) over (partition by l_quantity) - 1) / 2.0 rx, rank() over (order by l_discount) + (count(*) over (partition by l_discount) - 1) / 2.0 ry from lineitem) select round(corr(rx, ry), 6) rho from r")
def spearman_rank(spark, d):
    return rounded(A.spearman(read(spark, d, "lineitem").select(F.col("l_quantity").alias("x"), F.col("l_discount").alias("y"))), 6)


@query("with h as (select floor(l_quantity / 5 + 0.5)::int as bin, count(*) c from lineitem group by 1) select sum(c)::bigint n, round(sum(c * bin * 5.0) / sum(c), 4) mean, round(sum(c * bin * bin * 25.0) / sum(c) - (sum(c * bin * 5.0) / sum(c)) ** 2, 4) variance, round(ln(sum(c)) - sum(c * ln(c)) / sum(c), 4) entropy from h")
def histogram_measures(spark, d):
    h = A.histogram(read(spark, d, "lineitem").select(F.col("l_quantity").alias("v")), 0.0, 5.0, 20)
    return rounded(A.histogram_measures(h, 0.0, 5.0))


@query(with_(SERIES) + "select t, roi::int roi, round(coalesce(avg(v), 0.0), 4) v from (select distinct t from ser) g, (select unnest(range(1, 11)) roi) r left join (select t tt, voxel % 8 + 1 x, v from ser) s on s.tt = t and s.x = roi group by 1, 2")
def roi_mean_full(spark, d):
    return rounded(A.roi_mean_full(series(spark, d), (F.col("voxel") % 8 + 1).cast("int"), 10))


@query(with_(CELLS) + "select \"row\", (col - case when col > 1 then 1 else 0 end - case when col > 3 then 1 else 0 end)::int as col, v from cells where col not in (1, 3)")
def matrix_remove_columns(spark, d):
    return X.remove_columns(cells(spark, d), [3, 1])


@query(with_(CELLS) + "select \"row\", col, v from cells union all select \"row\", (col + 5)::int, v * 2 from cells")
def matrix_join_columns(spark, d):
    c = cells(spark, d)
    return X.join_columns(c, c.withColumn("v", F.col("v") * 2), 5)


@query(with_(CELLS) + "select \"row\", col, v from cells union all select (\"row\" + 30000)::int, col, v from cells")
def matrix_join_rows(spark, d):
    c = cells(spark, d)
    return X.join_rows(c, c, 30000)


GRAM = "gram as (select a.col as rw, b.col as cl, sum(a.v * b.v) v from cells a join cells b on a.\"row\" = b.\"row\" group by 1, 2)"


@query(with_(CELLS, GRAM) + "select (rw * (rw - 1) / 2 + cl)::bigint place, round(v, 3) v from gram where cl < rw")
def matrix_lower_triangle(spark, d):
    c = cells(spark, d)
    return rounded(X.lower_triangle(X.product(X.transpose(c), c)), 3)


@query(with_(VOLUME) + "select voxel, k as i, (9 - i)::int as j, j as k, v from vol")
def reorient_image(spark, d):
    return E.reorient(volume(spark, d), "kij", "i", {"i": 10, "j": 10})


@query(with_(VOLUME) + "select voxel, i * 2.0::double - 90 x, j * 2.5::double - 126 y, k * 3.0::double - 72 z from vol")
def image_spacing(spark, d):
    return E.millimetres(volume(spark, d), (2.0, 2.5, 3.0), (-90.0, -126.0, -72.0))


@query("select a.user_id, a.ts, a.event_id, (select b.value from events b where b.user_id = a.user_id and b.event_type = 'purchase' and b.ts <= a.ts order by b.ts desc limit 1) as as_of from events a where event_type <> 'purchase'")
def join_as_of(spark, d):
    e = read(spark, d, "events")
    return J.as_of(e.where("event_type <> 'purchase'").select("user_id", "ts", "event_id"), e.where("event_type = 'purchase'"), "user_id", "ts", "value")


@query("with a as (select o_custkey k, count(*) n from orders where o_totalprice > 300000 group by 1), b as (select c_custkey k, c_acctbal bal from customer where c_acctbal > 5000) select coalesce(a.k, b.k) k, n, bal from a full join b on a.k = b.k")
def join_full(spark, d):
    a = read(spark, d, "orders").where("o_totalprice > 300000").groupBy(F.col("o_custkey").alias("k")).agg(F.count(F.lit(1)).alias("n"))
    return a.join(read(spark, d, "customer").where("c_acctbal > 5000").select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("bal")), "k", "full")


@query("select o_orderkey, round(sum(o_totalprice) over (partition by o_custkey order by o_orderdate::date range between interval 90 days preceding and current row), 2) v, nth_value(o_orderkey, 2) over (partition by o_custkey order by o_orderdate, o_orderkey rows between unbounded preceding and unbounded following) as second from orders")
def range_frame(spark, d):
    day = F.datediff(F.col("o_orderdate").cast("date"), F.lit("1990-01-01").cast("date"))
    w = Window.partitionBy("o_custkey")
    o = read(spark, d, "orders").withColumn("day", day)
    v = F.round(F.sum("o_totalprice").over(w.orderBy("day").rangeBetween(-90, 0)), 2)
    second = F.nth_value("o_orderkey", 2).over(w.orderBy("o_orderdate", "o_orderkey").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return o.select("o_orderkey", v.alias("v"), second.alias("second"))


@query("select l_returnflag, l_linestatus, count(distinct l_suppkey) n, grouping(l_returnflag)::int g from lineitem group by grouping sets ((l_returnflag, l_linestatus), (l_linestatus))")
def grouping_sets(spark, d):
    read(spark, d, "lineitem").createOrReplaceTempView("lamina_lineitem")
    return spark.sql("select l_returnflag, l_linestatus, count(distinct l_suppkey) n, cast(grouping(l_returnflag) as int) g from lamina_lineitem group by grouping sets ((l_returnflag, l_linestatus), (l_linestatus))")


@query("select p_partkey, round(exp(-((p_size - 25.0) ** 2) / 50) / (5 * sqrt(2 * pi())) - exp(-((p_size - 25.0) ** 2) / 200) / (10 * sqrt(2 * pi())), 6) v from part")
def gaussian_difference(spark, d):
    x = F.col("p_size").cast("double")
    return rounded(read(spark, d, "part").select("p_partkey", (S.gaussian(x, 25.0, 5.0) - S.gaussian(x, 25.0, 10.0)).alias("v")), 6)


@query("select c_custkey, replace(trim(regexp_replace(c_name || '  ' || c_mktsegment, '\\s+', ' ', 'g')), ' ', ',') line, 'sub-' || c_custkey || '_' || c_mktsegment as job from customer")
def text_tools(spark, d):
    c = read(spark, d, "customer")
    job = S.fill_in(F.lit("sub-%id%_#seg#"), {"id": F.col("c_custkey").cast("string"), "seg": F.col("c_mktsegment")})
    return c.select("c_custkey", S.separated(F.concat("c_name", F.lit("  "), "c_mktsegment")).alias("line"), job.alias("job"))


@query(with_(EDGES, DEGREE) + "select node, total, row_number() over (order by total, node) as place from deg")
def sort_nodes(spark, d):
    deg = G.degree(edges(spark, d)).select("node", "total").withColumn("key", F.struct("total", "node"))
    return A.global_rank(deg, "key").select("node", "total", F.col("rank").alias("place"))


# --- perfusion, grids, patches, chains ----------------------------------------------------------------------------


def _dims(img):
    return 10, 10, img.agg(F.max("k").alias("k")).first()["k"] + 1  # one number


@query(with_(VOLUME, "c as (select avg(v) / 8 cut from vol)", "m as (select avg(v) mean from vol, c where v > cut)") + "select voxel, round(case when v * (50.0 / mean) > 40 then v * (50.0 / mean) else 0.0 end, 4) v from vol, m")
def spect_normalize(spark, d):
    return rounded(U.normalize(volume(spark, d)))


@query(with_(VOLUME) + "select voxel, round(case when label > 5 then (v - 30.0 * label - 10.0) / (label - 5) else 0.0 end, 4) v from vol")
def spect_tmap(spark, d):
    v = volume(spark, d)
    other = lambda c: v.select("voxel", c.alias("v"))
    return rounded(U.difference_map(v, other(F.col("label") * 30.0), other(F.col("label") - 5.0), other(F.lit(10.0))))


_BOX = [(x, y, z) for z in (0, 1) for y in (0, 1) for x in (0, 1)][1:]
_SIDES = " ".join(f"left join o p{x}{y}{z} on p{x}{y}{z}.i = a.i + {x} and p{x}{y}{z}.j = a.j + {y} and p{x}{y}{z}.k = a.k + {z}" for x, y, z in _BOX)
_FLAGS = ", ".join(f"p{x}{y}{z}.i is not null f{x}{y}{z}" for x, y, z in _BOX)
RESELS = f"""o as (select i, j, k from vol where label > 12), f as (select {_FLAGS} from o a {_SIDES} where a.i < 9 and a.j < 9 and a.k < (select max(k) from vol)),
 g as (select count(*) n, count(*) filter (f100) xe, count(*) filter (f010) ye, count(*) filter (f001) ze, count(*) filter (f100 and f010 and f110) xy, count(*) filter (f100 and f001 and f101) xz,
  count(*) filter (f010 and f001 and f011) yz, count(*) filter (f100 and f010 and f110 and f001 and f101 and f011 and f111) cubes from f),
 rs as (select *, (n - xe - ye - ze + xy + xz + yz - cubes)::double r0, (xe - xy - xz + cubes) * 0.11627907::double + (ye - xy - yz + cubes) * 0.120481928::double + (ze - yz - xz + cubes) * 0.109289617::double r1,
  (xy - cubes) * 0.11627907::double * 0.120481928 + (xz - cubes) * 0.11627907::double * 0.109289617 + (yz - cubes) * 0.120481928::double * 0.109289617 r2, cubes * 0.11627907::double * 0.120481928 * 0.109289617 r3 from g)"""


def _spots(spark, d):
    return _label_image(spark, d).withColumn("v", F.when(F.col("v") > 12, F.col("v")).otherwise(0.0))


@query(with_(VOLUME, RESELS) + "select n, xe, ye, ze, xy, xz, yz, cubes, r0, round(r1, 5) r1, round(r2, 5) r2, round(r3, 5) r3 from rs")
def resel_counts(spark, d):
    v = _spots(spark, d)
    return rounded(U.resel_counts(v, _dims(v)), 5)


_E = U.euler_densities(0.05, U.T_CUTS[0.05])
_EM = " + ".join(f"{e!r}::double * r{k}" for k, e in enumerate(_E))


@query(with_(VOLUME, RESELS, CC.replace("label > 30", "label / 20.0 > 1.76885")) + f"select component, n, peak, t, round(p, 6) p_cluster, round(1 - exp(-em * p), 6) p_corrected from (select *, exp(-((1.3378 / {_E[0] / _E[3]!r}::double * n / {U.SMOOTHNESS!r}::double) ** (2 / 3.0::double))) p from (select component, count(*) n, arg_max(voxel, label * 1000000 - voxel)::bigint peak, max(label / 20.0)::double t from comp join vol using (voxel) group by 1), (select {_EM} em from rs))")
def cluster_probabilities(spark, d):
    v = _spots(spark, d).withColumn("v", F.col("v") / 20)
    return rounded(U.cluster_probabilities(v, _dims(v)), 6)


@query("select round((avg(l_quantity * l_extendedprice) - avg(l_quantity) * avg(l_extendedprice)) ** 2 / (var_pop(l_quantity) * var_pop(l_extendedprice)), 6) cc from lineitem")
def squared_correlation(spark, d):
    return rounded(A.squared_correlation(read(spark, d, "lineitem").select(F.col("l_quantity").alias("x"), F.col("l_extendedprice").alias("y"))), 6)


@query(with_(SERIES, "e as (select voxel, c, ((voxel * (c + 1)) % 7 - 3) / 10.0::double e from (select distinct voxel from ser), (select unnest(range(3)) c))", "a as (select t, c, sum(v * e) / 4 a from ser join e using (voxel) group by 1, 2)") + "select voxel, t, round(sum(a * e), 7) v from e join a using (c) group by 1, 2")
def eigenvector_denoise(spark, d):
    s = series(spark, d)
    c = F.explode(F.sequence(F.lit(0), F.lit(2)))
    e = s.select("voxel").distinct().select("voxel", c.alias("c")).withColumn("e", ((F.col("voxel") * (F.col("c") + 1)) % 7 - 3) / 10.0)
    return rounded(A.project_on_vectors(s, e, 2.0), 7)  # at fewer digits sums of decimals end in ties


@query(with_(EDGES, DEGREE) + "select node, total from deg order by total desc, node limit 1")
def maximum_node(spark, d):
    return G.maximum_node(G.degree(edges(spark, d)))


def _axis_sql(a: str) -> str:
    w = "case o when -1 then (1 - t) ** 3 / 6 when 0 then (3 * t ** 3 - 6 * t ** 2 + 4) / 6 when 1 then (-3 * t ** 3 + 3 * t ** 2 + 3 * t + 1) / 6 else t ** 3 / 6 end"
    return f"w{a} as (select id, least(greatest(b + o, 0), 3) n{a}, {w} w{a} from (select id, trunc({a} / 3.7::double)::int b, {a} / 3.7::double - trunc({a} / 3.7::double) t, unnest([-1, 0, 1, 2]) o from pts))"


@query(with_(VOLUME, "pts as (select voxel id, i::double x, j::double y, k::double z from vol)", *[_axis_sql(a) for a in "xyz"]) + "select id, round(any_value(x) + sum(wx * wy * wz * (0.1 * nx - 0.05 * ny)), 4) x, round(any_value(y) + sum(wx * wy * wz * 0.02 * nz * nx), 4) y, round(any_value(z) + sum(wx * wy * wz * 0.3 * (ny % 2)), 4) z from pts join wx using (id) join wy using (id) join wz using (id) group by id")
def grid_spline(spark, d):
    g = spark.range(64).select((F.col("id") % 4).cast("int").alias("gi"), F.floor(F.col("id") / 4 % 4).cast("int").alias("gj"), F.floor(F.col("id") / 16).cast("int").alias("gk"))
    g = g.select("*", (0.1 * F.col("gi") - 0.05 * F.col("gj")).alias("dx"), (0.02 * F.col("gk") * F.col("gi")).alias("dy"), (0.3 * (F.col("gj") % 2)).alias("dz"))
    return rounded(M.grid_points(_points(spark, d), g, (0.0, 0.0, 0.0), (3.7, 3.7, 3.7), (4, 4, 4)))


@query(with_(VOLUME) + "select a.i, a.j, a.k, round(coalesce(b.v, 0.0), 3) v from vol a left join vol b on b.i = 9 - a.j and b.j = a.i and b.k = a.k")
def rotate_image(spark, d):
    v = volume(spark, d)
    return rounded(M.reslice(v, v.select("i", "j", "k"), M.rotation_scale(90.0, (1.0, 1.0, 1.0), (4.5, 4.5, 0.0)), _dims(v)), 3)


@query(with_(VOLUME, "top as (select max(k) m from vol)", "x as (select a.voxel, c, b, e, least(greatest(a.i + b, 0), 9) i, least(greatest(a.j + c, 0), 9) j, least(greatest(a.k + e, 0), m) k from vol a, top, (select unnest([-1, 0, 1]) b), (select unnest([-1, 0, 1]) c), (select unnest([-1, 0, 1]) e))") + "select x.voxel, list(v order by e, c, b) vals from x join vol using (i, j, k) group by 1")
def patch_vectors(spark, d):
    v = volume(spark, d)
    return P.patch_vectors(v, _dims(v), (1, 1, 1))


@query(with_(SERIES, "b as (select voxel, t, v blue, v * 0.5 + t uv, v - 3 blue_f, v * 0.4 + 1 uv_f from ser)", "r as (select *, blue_f + avg(blue - blue_f) over w bb, uv_f + avg(uv - uv_f) over w uu from b window w as (partition by voxel))") + "select voxel, t, round(blue_f - sum(uu * bb) over w / sum(uu * uu) over w * uv_f, 3) v from r window w as (partition by voxel)")
def two_wavelengths(spark, d):
    v, t = F.col("v"), F.col("t")
    return rounded(H.two_wavelengths(series(spark, d).select("voxel", "t", v.alias("blue"), (v * 0.5 + t).alias("uv"), (v - 3).alias("blue_f"), (v * 0.4 + 1).alias("uv_f"))), 3)


_MOTION = "mo as (select voxel, t, v - (t % 4) * sum(v * (t % 4)) over (partition by voxel) / sum((t % 4) * (t % 4)) over (partition by voxel) v from ser)"
_DRIFTED = DRIFT.replace("from ser join b", "from hi_y join b") + ", cl as (select s.voxel, s.t, case when s.voxel % 3 = 0 then 0.0 else v - c0 * x0 - c1 * x end v from hi_y s join b on s.t = b.t join c on s.voxel = c.voxel)"


@query(with_(SERIES, _MOTION, _butter_sql(0.15, False, "mo", "lo"), _butter_sql(0.03, True, "lo_y", "hi"), _DRIFTED, GLOBAL.replace("from ser", "from cl")) + "select voxel, s.t, round(v - u * sum(v * u) over (partition by voxel), 2) v from cl s join u on s.t = u.t")
def clean_voxels(spark, d):
    out = H.clean_voxels(series(spark, d), 30, [[float(t % 4) for t in range(30)]], 0.03, 0.15, 1.0, 1, F.col("voxel") % 3 != 0)
    return rounded(out, 2)


@query(with_(SERIES, ROI, "rs as (select roi voxel, t, v from roi union all select 0, t, avg(v) from ser group by t)", _butter_sql(0.15, False, "rs", "lo"), _butter_sql(0.03, True, "lo_y", "hi")) + "select s.voxel roi, s.t, round(s.v - g.v * sum(s.v * g.v) over w / sum(g.v * g.v) over w, 3) v from hi_y s join hi_y g on s.t = g.t and g.voxel = 0 where s.voxel > 0 window w as (partition by s.voxel)")
def clean_regions(spark, d):
    s = series(spark, d)
    g = s.groupBy("t").agg(F.avg("v").alias("v")).withColumn("name", F.lit("global"))
    return rounded(H.clean_regions(s, (F.col("voxel") % 8 + 1).cast("int"), g, 0.03, 0.15, 1.0), 3)


def _back(name: str, ray: str, near: str):
    def f(spark, d):
        v = _label_image(spark, d)
        flat = v.select("i", "j").distinct().withColumn("v", F.col("i") * 10.0 + F.col("j") + 1)
        return E.back_project(v, flat, "k", 20, 3, name == "backwards")

    f.__name__ = "back_project" + ("_backwards" if name == "backwards" else "")
    return query(with_(VOLUME, f"h as (select i, j, {ray} hit from vol group by 1, 2)") + f"select voxel, case when {near} then i * 10.0::double + j + 1 else 0.0::double end v from vol join h using (i, j)")(f)


_back("forwards", "max(k) filter (label > 20 and k > 0)", "k between hit - 2 and hit")
_back("backwards", "min(k) filter (label > 20)", "k between hit and hit + 2")
