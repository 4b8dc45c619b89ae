"""Queries of slice bias, label fields, ordered growth and projections with their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalar as S
from ..operators import bias as B
from ..operators import geometry as M
from ..operators import histograms as K
from ..operators import labels as L
from ..operators import parcels as Q
from ..operators import projection as R
from ..operators import spatial as P
from ..operators import statistics as A
from ..operators import surfaces as W
from ..operators import temporal as T
from ..sources.adapters import SERIES, VOLUME, read, series, volume
from .queries import CELLS, INTERVALS, _dims, _intervals, cells, query, rounded, with_
from .space import MESH, _mesh

_SMOOTH = ["kx as (select unnest([-1, 0, 1]) o)", "kw as (select o, exp(-0.5 * o * o)::double / (1 + 2 * exp(-0.5::double)) w from kx)", "tp as (select max(k) m from vol)", *[f"s{a} as (select q.voxel, q.i, q.j, q.k, sum(w * p.v) v from {src} q, kw, tp join {src} p on {on} group by 1, 2, 3, 4)" for a, src, on in (
    ("i", "vol", "p.i = least(greatest(q.i + o, 0), 9) and p.j = q.j and p.k = q.k"),
    ("j", "si", "p.j = least(greatest(q.j + o, 0), 9) and p.i = q.i and p.k = q.k"),
    ("k", "sj", "p.k = least(greatest(q.k + o, 0), m) and p.i = q.i and p.j = q.j"),
)]]
_BIAS = [
    "curve as (select voxel, i, j, k, case when i between 1 and 8 and j between 1 and 8 and k between 1 and m - 1 then sqrt((2 * v - lag(v) over wi - lead(v) over wi) ** 2 + (2 * v - lag(v) over wj - lead(v) over wj) ** 2 + (2 * v - lag(v) over wk - lead(v) over wk) ** 2) else 0 end bend from sk, tp window wi as (partition by j, k order by i), wj as (partition by i, k order by j), wk as (partition by i, j order by k))",
    "sure as (select voxel, 1000 * (1 - bend * bend / (bend * bend + (0.1 * (select max(bend) from curve)) ** 2 + 0.001)) w from curve)",
    "lim as (select 0.05 * max(v) + 0.95 * min(v) above, (max(k) + 1) // 2 mid from vol)", "at as (select vol.*, w from vol join sure using (voxel))",
    "pair as (select y.k, x.v x, y.v y, x.w > 750 and y.w > 750 sure from at y, lim join at x on x.i = y.i and x.j = y.j and x.k = case when y.k > mid then y.k - 1 when y.k < mid then y.k + 1 end where x.v > above and y.v > above)",
    "fit as (select k, case when count(*) filter (sure) > 5 then regr_slope(y, x) filter (sure) else 1.0 end b, case when count(*) filter (sure) > 5 then regr_slope(x, y) filter (sure) else 1.0 end h from pair group by k)",
    "step as (select d.k, coalesce(case when b * h > 0.5 then least(greatest(0.5 * (b + 1 / h), 0.666), 1.5) end, 1.0) s from (select distinct k from vol) d left join fit using (k), lim where d.k <> mid)",
    "scl as (select k, exp(sum(ln(s)) over (partition by k > mid order by abs(k - mid))) b from step, lim)",
    "cor as (select vol.*, case when v > above and b is not null then v / b else v end x, v > above and b is not null moved from vol left join scl using (k), lim)",
    "tot as (select sum(v) filter (moved) / sum(x) filter (moved) s from cor)",
]


@query(with_(VOLUME, *_SMOOTH, *_BIAS).replace("at as (select", "wv as (select").replace("from at y", "from wv y").replace("join at x", "join wv x") + "select voxel, round(x * s, 3) v, round(100 * v / (x * s), 3) bias from cor, tot")
def slice_bias(spark, d):
    v = volume(spark, d)
    return rounded(B.slice_bias(v, "k", _dims(v)).select("voxel", "v", "bias"), 3)


def _sweep(n: int) -> list[str]:
    """SQL of one sweep of the label field: from table f{n-1}(voxel, i, j, k, first, now) to f{n}."""
    p = f"f{n - 1}"
    return [
        f"nb{n} as (select q.voxel, o, w, x.first nf, x.now nn from {p} q, stp, top join {p} x on x.i = q.i + a and x.j = q.j + b and x.k = q.k + c where q.i between 1 and 8 and q.j between 1 and 8 and q.k between 1 and m - 1)",
        f"cd{n} as (select voxel, l, min(o) o from (select voxel, now l, 0 o from {p} union all select voxel, nf, o from nb{n}) group by 1, 2)",
        f"en{n} as (select c.voxel, c.l, c.o, coalesce(4.0 * sum(case when nn <> l then w else 0 end), 0) e from cd{n} c left join nb{n} x on x.voxel = c.voxel group by 1, 2, 3)",
        f"f{n} as (select q.voxel, q.i, q.j, q.k, q.first, l as now from {p} q join en{n} using (voxel) qualify row_number() over (partition by q.voxel order by round(e + case when l <> q.first then 1 else 0 end, 6), o desc) = 1)",
    ]


_STEPS = [
    "top as (select max(k) m from vol)", "ax as (select unnest([-1, 0, 1]) x)", "raw as (select p.x a, q.x b, r.x c, row_number() over (order by r.x, q.x, p.x) o from ax p, ax q, ax r where p.x <> 0 or q.x <> 0 or r.x <> 0)",
    "stp as (select a, b, c, o, (1 / sqrt(a * a + b * b + c * c)) / (select sum(1 / sqrt(a * a + b * b + c * c)) from raw) w from raw)", "f0 as (select voxel, i, j, k, (label // 10)::bigint as first, (label // 10)::bigint as now from vol)",
]


@query(with_(VOLUME, *_STEPS, *_sweep(1), *_sweep(2)) + "select voxel, now as label from f2")
def regularize_labels(spark, d):
    v = volume(spark, d)
    return L.regularize_labels(v.withColumn("label", F.floor(F.col("label") / 10)), _dims(v), iterations=1, converged=1e-9)


# --- growth in order of distance ----------------------------------------------------------------------------------------

_GROW = [
    "pt as (select voxel, (voxel % 10)::int i, (voxel // 10)::int j, list(floor(v / 40)::double order by t) x from ser group by voxel)", "sd as (select row_number() over (order by g) p, voxel from (select voxel % 10 // 4 g, min(voxel) voxel from pt group by 1))",
    "dst as (select v.voxel, p, list_sum(list_transform(range(1, 31), lambda n: (v.x[n] - c.x[n]) * (v.x[n] - c.x[n]))) d from pt v, sd join pt c on c.voxel = sd.voxel)",
    "adj as (select a.voxel a, b.voxel b from pt a join pt b on abs(a.i - b.i) + abs(a.j - b.j) = 1)",
    "lab(step, m) as (select 0, map_from_entries(list(row(voxel, p))) from sd union all select step + 1, map_concat(m, map_from_entries([row(e.voxel, e.p)])) from (select step, m, min({'d': d, 'p': p, 'voxel': voxel}) e from (select lab.step, lab.m, dst.d, dst.p, dst.voxel from lab, adj join dst on dst.voxel = adj.b where lab.m[adj.a] = dst.p and lab.m[adj.b] is null) group by step, m))",
]


@query(with_(SERIES, *_GROW) + "select voxel, coalesce(m[voxel], 0)::bigint as label from pt, (select m from lab order by step desc limit 1)")
def grow_regions(spark, d):
    x = F.transform(F.array_sort(F.collect_list(F.struct("t", "v"))), lambda p: F.floor(p["v"] / 40).cast("double"))
    v = series(spark, d).groupBy("voxel").agg(x.alias("x")).select(F.lit("one").alias("img"), "voxel", (F.col("voxel") % 10).alias("i"), F.floor(F.col("voxel") / 10).alias("j"), F.lit(0).alias("k"), "x")
    group = F.floor(F.col("voxel") % 10 / 4)
    seeds = v.groupBy(group.alias("g")).agg(F.min_by("x", "voxel").alias("x"), F.min("voxel").alias("voxel")).select(F.lit("one").alias("img"), (F.col("g") + 1).alias("label"), "x", "voxel")
    return L.grow_in_order(v, seeds).select("voxel", "label")


# --- projections --------------------------------------------------------------------------------------------------------

_SHADED = [
    "lm as (select voxel, i, j, k, label::double v from vol)", "win as (select i, j, max(k) high, greatest(max(k) - 2, 0) low from lm where v > 30 and k > 0 group by 1, 2)",
    "ok as (select unnest([-2, -1, 0, 1, 2]) o)", "gk as (select o, -o * exp(-o * o / 2.0::double) / (select sum(abs(o) * exp(-o * o / 2.0::double)) from ok) w from ok)", "tp as (select max(k) m from vol)",
    "gr as (select win.i, win.j, sum(w * x.v) gi, sum(w * y.v) gj, sum(w * z.v) g from win, gk, tp join lm x on x.i = least(greatest(win.i + o, 0), 9) and x.j = win.j and x.k = low join lm y on y.i = win.i and y.j = least(greatest(win.j + o, 0), 9) and y.k = low join lm z on z.i = win.i and z.j = win.j and z.k = least(greatest(low + o, 0), m) group by 1, 2)",
    "sh as (select i, j, case when gi * gi + gj * gj + g * g > 0 then greatest(g / sqrt(gi * gi + gj * gj + g * g), 0.1) else 0.1 end light from gr)",
    "pr as (select win.i, win.j, any_value(light) * avg(v) v from win join sh using (i, j) join lm on lm.i = win.i and lm.j = win.j and lm.k between low and high group by 1, 2)",
]


@query(with_(VOLUME, *_SHADED) + "select i as first, j as second, round(coalesce(pr.v, 0.0), 4) v from (select distinct i, j from vol) left join pr using (i, j)")
def project_shaded(spark, d):
    v = volume(spark, d)
    return rounded(R.project_shaded(v.withColumn("v", F.col("label").cast("double")), "k", _dims(v), 30.0, window=3, shade=1.0))


_PAIRS = "hit as (select i, k, max(j) h from vol where label > 30 and j > 0 group by 1, 2), prs as (select i as first, (n - 1 - k)::int as second, (0.9 * i + 0.3)::double x, (12.0 - (1.1 * k + 0.2) + 0.5)::double y from hit, (select max(k) + 1 n from vol) where h - 2 >= 0)"


def _pairs(spark, d):
    v = volume(spark, d)
    there, plane = [[0.9, 0, 0, 0.3], [0, 1, 0, 0], [0, 0, 1.1, 0.2]], [[1, 0, 0, 0], [0, 1, 0, 0.5], [0, 0, 1, 0]]
    return R.point_pairs(v.withColumn("v", F.col("label").cast("double")), "j", _dims(v), 30.0, there, plane, 25, 0.5, depth=-2, second_down=True)


@query(with_(VOLUME, _PAIRS) + "select first, second, round(x, 4) x, round(y, 4) y from prs")
def projection_pairs(spark, d):
    return rounded(_pairs(spark, d))


@query(with_(VOLUME, _PAIRS) + "select first, second, v from (select first, second, (trunc(x / 1.0 + 0.5))::int i, (trunc(y / 1.25 + 0.5))::int j from prs) p join (select i, j, v from vol where k = 0) f using (i, j)")
def project_map(spark, d):
    flat = volume(spark, d).where("k = 0").select("i", "j", "v")
    return R.project_map(_pairs(spark, d), flat, (1.0, 1.25))


# --- joint histograms ---------------------------------------------------------------------------------------------------

_PV = """src as (select l_quantity::int x, (l_discount * 100)::int + l_linenumber * 3 y from lineitem), ins as (select x, y, x // 4 a, y // 4 b, (x % 4) / 4.0::double fx, (y % 4) / 4.0::double fy from src where x >= 0 and y >= 0 and x / 4.0 <= 12.999 and y / 4.0 <= 6.999),
 dep as (select a + i a, b + j b, trunc(100 * (case when i = 1 then fx else 1 - fx end) * (case when j = 1 then fy else 1 - fy end) + 0.5)::bigint n from ins, (select unnest([0, 1]) i), (select unnest([0, 1]) j)), bins as (select a::int a, b::int b, sum(n)::bigint count from dep group by 1, 2 having sum(n) <> 0)"""


def _deposits(spark, d):
    pairs = read(spark, d, "lineitem").select(F.col("l_quantity").cast("int").alias("x"), (F.round(F.col("l_discount") * 100).cast("int") + F.col("l_linenumber") * 3).alias("y"))
    return K.joint_histogram_pv(pairs, 4, (14, 8))


@query(with_(_PV) + "select a, b, count from bins")
def joint_histogram_pv(spark, d):
    return _deposits(spark, d)


@query(with_(_PV) + "select n, round(ssd, 5) ssd, round((ab - ma * mb) ** 2 / (greatest(aa - ma * ma, 1e-5) * greatest(bb - mb * mb, 1e-5)), 5) cc, round(hx, 5) hx, round(hy, 5) hy, round(hxy, 5) hxy, round(hx + hy - hxy, 5) mi, round((hx + hy) / hxy - 1, 5) nmi from "
    "(select sum(count)::bigint n, sum(count * (a - b) * (a - b)) / sum(count)::double ssd, sum(count * a * b) / sum(count)::double ab, sum(count * a) / sum(count)::double ma, sum(count * b) / sum(count)::double mb, sum(count * a * a) / sum(count)::double aa, sum(count * b * b) / sum(count)::double bb from bins), "
    + ", ".join(f"(select -sum(p * ln(p)) {h} from (select sum(count) / (select sum(count) from bins)::double p from bins group by {g}))" for h, g in (("hx", "a"), ("hy", "b"), ("hxy", "a, b"))))
def joint_measures_pv(spark, d):
    return rounded(K.measures(_deposits(spark, d)), 5)


# --- clusters, correlation, regions, designs ------------------------------------------------------------------------------

_SIGNED = VOLUME.replace("p_retailprice v", "(p_size - 25)::double v")
_CORNERS = """ins as (select voxel, i, j, k from vol where abs(v) >= 19), nb as (select a.voxel a, b.voxel b from ins a join ins b on abs(a.i - b.i) <= 1 and abs(a.j - b.j) <= 1 and abs(a.k - b.k) <= 1 and a.voxel <> b.voxel),
 reach as (select voxel a, voxel c from ins union select nb.b, reach.c from reach join nb on nb.a = reach.a), comp as (select a voxel, min(c) component from reach group by a)"""


def _signed(spark, d):
    return volume(spark, d).withColumn("v", (F.col("label") - 25).cast("double"))


@query(with_(_SIGNED, _CORNERS, "big as (select component from comp group by 1 having count(*) >= 5)") + "select voxel, case when voxel in (select voxel from comp where component in (select component from big)) then v else 0.0 end::double v from vol")
def cluster_filter(spark, d):
    return P.cluster_filter(_signed(spark, d), 19, 5)


@query(with_(_SIGNED, _CORNERS.replace("abs(v) >= 19", "v > 12"), "sd as (select i, j, k from vol where v > 12 order by voxel limit 1)") + "select voxel, case when voxel in (select voxel from comp where component = (select component from comp join ins using (voxel) join sd using (i, j, k))) then 1.0 else 0.0 end::double v from vol")
def connect_from_seed(spark, d):
    v = _signed(spark, d).withColumn("v", F.col("v") - 12)
    seed = v.where("v > 0").orderBy("voxel").select("i", "j", "k").first()
    return P.connect(v, tuple(seed))


@query("with " + CELLS + " select a.col a, b.col b, round(case when stddev_pop(a.v) > 0 and stddev_pop(b.v) > 0 then corr(a.v, b.v) else 0.0 end, 4) r from cells a join cells b on a.row = b.row and a.col <= b.col where a.row % 3 > 0 group by 1, 2")
def correlation_binary_weights(spark, d):
    c = cells(spark, d)
    return rounded(A.weighted_correlation_matrix(c, c.select("row").distinct().withColumn("w", (F.col("row") % 3).cast("double"))))


@query("with " + CELLS + ", s as (select a.col a, b.col b, sum(w) n, sum(w * a.v) / sum(w) x, sum(w * b.v) / sum(w) y, sum(w * a.v * a.v) / sum(w) xx, sum(w * b.v * b.v) / sum(w) yy, sum(w * a.v * b.v) / sum(w) xy from (select *, (row % 3)::double w from cells) a join cells b on a.row = b.row and a.col <= b.col where w > 0 group by 1, 2), "
    "r as (select a, b, case when a = b then 1.0::double else (xy - x * y) / sqrt((xx - x * x) * (yy - y * y)) end r from s) select a, b, round(case when abs(r) < 0.99999 then 0.5 * ln((1 + r) / (1 - r)) when r > 0 then 6.103 else -6.103 end, 4) r from r")  # fmt: skip
def correlation_weighted_z(spark, d):
    c = cells(spark, d)
    return rounded(A.weighted_correlation_matrix(c, c.select("row").distinct().withColumn("w", (F.col("row") % 3).cast("double")), binary=False, to_z=True))


_PLACES = "pl as (select voxel, (voxel % 10)::int i, (voxel // 10)::int j, 0::int k, (voxel % 9)::int as label from (select distinct voxel from ser))"


@query(with_(SERIES, _PLACES, "nf as (select max(t) + 1 n from ser)", "rg as (select unnest(range(1, 11))::int roi)", "sh as (select label roi, count(*)::double n, avg(i) ci, avg(j) cj, avg(k) ck from pl where label > 0 group by 1)")
    + "select t::bigint as row, roi, round(coalesce(avg(v), 0.0), 6) v from rg, (select distinct t from ser) f left join (select label, t tt, v from ser join pl using (voxel)) x on label = roi and tt = t group by 1, 2 union all "
    + " union all ".join(f"select (n + {k})::bigint, roi, round({e}, 6)::double from rg, nf left join (select roi r, n c, ci, cj, ck from sh) on r = roi" for k, e in enumerate(("-1.0", "coalesce(c, 0)", "coalesce(ci, 0)", "coalesce(cj, 0)", "coalesce(ck, 0)"))))
def roi_table(spark, d):
    s, v = series(spark, d), F.col("voxel")
    places = s.select("voxel").distinct().select("voxel", (v % 10).cast("int").alias("i"), F.floor(v / 10).cast("int").alias("j"), F.lit(0).alias("k"), (v % 9).cast("int").alias("label"))
    return rounded(A.roi_table(s, places, 10), 6)


def _response_sql(period: float) -> str:
    return ", ".join(f"({d}, {x!r}::double)" for d, x in enumerate(T.response(period)))


@query("with " + INTERVALS + f", hr(d, h) as (values {_response_sql(1.5)}), o as (select distinct run, task, unnest(range(lo, hi)) f from iv), nm as (select task, (row_number() over (order by task) - 1)::int col from (select distinct task from iv)), rn as (select run, row_number() over (order by run) - 1 as r, count(*) over () runs from (select distinct run from iv)), "
    "cv as (select run, (f + d)::int frame, col, sum(h) v from o join nm using (task), hr where f + d < 720 group by 1, 2, 3), gd as (select run, fr::int frame, col from rn, nm, (select unnest(range(720)) fr)), "
    "dr as (select a.run, fr::int frame, ((select count(*) from nm) + b.r * 4 + k)::int col, case when a.r = b.r then case k when 0 then 1.0 when 1 then t when 2 then 1.5 * t * t - 0.5 else 2.5 * t * t * t - 1.5 * t end else 0.0 end v from rn a, rn b, (select unnest(range(720)) fr, 2 * unnest(range(720)) / 719.0::double - 1 t), (select unnest(range(4)) k)) "
    "select run, frame, col, round(coalesce(v, 0.0), 4)::double v from gd left join cv using (run, frame, col) union all select run, frame, col, round(v, 4)::double from dr")  # fmt: skip
def stacked_waveform(spark, d):
    iv = _intervals(spark, d)
    names = A.global_rank(iv.select("task").distinct(), "task").select("task", (F.col("rank") - 1).cast("int").alias("col"))
    tasks = T.intervals_to_frames(iv).join(names, "task").select("run", "frame", "col", F.lit(1.0).alias("v"))
    return rounded(T.stacked_waveform(tasks, 720, 1.5, 3))


@query(with_(SERIES, "pd as (select voxel, t, v from ser union all select a.voxel, -a.t, 2 * b.v - a.v from ser a join ser b on b.voxel = a.voxel and b.t = 0 where a.t between 1 and 6)", "lo as (select voxel, t, v, min(v) over (partition by voxel order by t rows between current row and 5 following) lo from pd)") + "select voxel, t::int t, round(v, 4) v from (select voxel, t, v - max(lo) over (partition by voxel order by t rows between 5 preceding and current row) v from lo) where t >= 0")
def top_hat_padded(spark, d):
    return rounded(T.top_hat_padded(series(spark, d), 6))


@query("select p_partkey as index, [p_size, p_partkey % 7, p_partkey % 3] attr, row_number() over (order by p_size, p_partkey % 7, p_partkey % 3, p_partkey) place from part")
def sort_parcels(spark, d):
    k = F.col("p_partkey")
    return Q.sort_parcels(read(spark, d, "part").select(k.alias("index"), F.array(F.col("p_size").cast("long"), k % 7, k % 3).alias("attr")))


@query("with " + INTERVALS + " select run, list(lo || '-' || hi || ' ' || task order by lo, hi, task) ranges from iv group by run")
def sort_task_ranges(spark, d):
    text = F.transform("ranges", lambda r: F.concat(r["lo"].cast("string"), F.lit("-"), r["hi"].cast("string"), F.lit(" "), r["task"]))
    return Q.sort_task_ranges(_intervals(spark, d)).select("run", text.alias("ranges"))


@query(with_(VOLUME, "nd as (select voxel id, i::double x, j::double y, k::double z, case when label <= 40 then 0 else label end lobe from vol)", "nr as (select a.id, b.lobe, row_number() over (partition by a.id order by (a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.z - b.z) ** 2, b.id) r from nd a, nd b where a.lobe = 0 and b.lobe <> 0)") + "select nd.id, x, y, z, coalesce(nr.lobe, nd.lobe)::int lobe from nd left join nr on nr.id = nd.id and r = 1")
def repair_lobes(spark, d):
    v = volume(spark, d)
    return Q.repair_lobes(v.select(F.col("voxel").alias("id"), *[F.col(a).cast("double").alias(b) for a, b in zip("ijk", "xyz")], F.when(F.col("label") <= 40, 0).otherwise(F.col("label")).alias("lobe")), 2.0)


# --- frames, folds, sketches, maps ----------------------------------------------------------------------------------------


@query(with_(SERIES, "x as (select a.t, b.t other, sum((floor(a.v / 40) - floor(b.v / 40)) ** 2) d2 from ser a join ser b using (voxel) group by 1, 2)", "k as (select t, d2 c from x qualify row_number() over (partition by t order by d2, other) = 5)") + "select x.* from x join k using (t) where d2 < c")
def frame_matrix(spark, d):
    return T.frame_matrix(series(spark, d).withColumn("v", F.floor(F.col("v") / 40).cast("double")), sparsity=0.1)


@query(with_(SERIES, "g as (select t, avg(v) g from ser group by 1)", "u as (select t, case when t % 4 > 0 then g / (select sqrt(sum(g * g)) from g where t % 4 > 0) else 0 end u from g)", "c as (select voxel, sum(v * u) c from ser join u using (t) group by 1)") + "select voxel, t, round(case when t % 4 > 0 then v - c * u else 0.0 end, 3) v from ser join u using (t) join c using (voxel)")
def global_regress_weighted(spark, d):
    s = series(spark, d)
    return rounded(T.global_regress_weighted(s, s.select("t").distinct().withColumn("w", (F.col("t") % 4 > 0).cast("double"))), 3)


@query(with_(SERIES, "o as (select v, row_number() over (order by v) - 1 as rk, count(*) over () n from ser where t = 0)", "q as (select max(case when rk = n // 4 then v end) a, max(case when rk = n // 2 then v end) b, max(case when rk = 3 * n // 4 then v end) c from o)") + "select voxel, t, round((v - b) / greatest(c - a, 0.001), 4) v from ser, q")
def quantile_normalize_frames(spark, d):
    return rounded(A.quantile_normalize_frames(series(spark, d)))


@query(with_(SERIES, "fo as (select distinct voxel subject, (voxel % 5)::int fold from ser)", "tr as (select voxel subject, avg(v) y from ser where t < 10 group by 1)", "ed as (select voxel subject, t edge, v from ser where t >= 5)",
    "rr as (select o.fold out, edge, corr(v, y) r from ed join tr using (subject) join fo using (subject), (select distinct fold from fo) o where fo.fold <> o.fold group by 1, 2 having abs(corr(v, y)) >= 0.2)",
    "sm as (select o.fold out, fo.subject, fo.fold, y, coalesce(sum(v) filter (r > 0), 0) p, coalesce(sum(v) filter (r < 0), 0) n from fo join tr using (subject) join (select distinct fold from fo) o on true left join rr on rr.out = o.fold left join ed on ed.subject = fo.subject and ed.edge = rr.edge group by 1, 2, 3, 4)",
    "md as (select out, avg(y) my, avg(p) mp, avg(n) mn, var_pop(p) pp, var_pop(n) nn, covar_pop(p, n) pn, covar_pop(p, y) py, covar_pop(n, y) ny from sm where fold <> out group by 1)",
    "cf as (select *, pp * nn - pn * pn det from md)", "be as (select *, case when det > 1e-12 * pp * nn then (py * nn - ny * pn) / det when pp > 0 then py / pp else 0 end bp, case when det > 1e-12 * pp * nn then (ny * pp - py * pn) / det when pp > 0 then 0 when nn > 0 then ny / nn else 0 end bn from cf)")
    + "select subject, fold, round(y, 4) truth, round(my + bp * (p - mp) + bn * (n - mn), 3) predicted from sm join be using (out) where fold = out")
def predict_from_edges(spark, d):
    s = series(spark, d).withColumnRenamed("voxel", "subject")
    folds = s.select("subject").distinct().withColumn("fold", (F.col("subject") % 5).cast("int"))
    out = A.predict_from_edges(s.where("t >= 5").select("subject", F.col("t").alias("edge"), "v"), s.where("t < 10").groupBy("subject").agg(F.avg("v").alias("y")), folds, 0.2)
    return out.select("subject", "fold", F.round("truth", 4).alias("truth"), F.round("predicted", 3).alias("predicted"))


@query("select fold, n from (select unnest(range(7))::int fold), (select count(*) c from customer), lateral (select (c - fold + 6) // 7 n)")
def fold_sizes(spark, d):
    folds = A.assign_folds(read(spark, d, "customer").select(F.col("c_custkey").alias("subject")), 7)
    return folds.groupBy("fold").agg(F.count(F.lit(1)).alias("n"))


@query("select l_returnflag, true distinct_near, true median_near, true merged_same from lineitem group by 1")
def sketches(spark, d):
    """HyperLogLog and quantile sketches by flag, against the exact figures, and sketches of parts of the table merged."""
    l = read(spark, d, "lineitem")  # noqa: E741
    by = l.groupBy("l_returnflag").agg(F.hll_sketch_agg("l_partkey", 14).alias("s"), F.countDistinct("l_partkey").alias("n"), F.percentile_approx("l_extendedprice", 0.5, 10_000).alias("q"), F.percentile("l_extendedprice", F.lit(0.5)).alias("m"))
    parts = l.groupBy("l_returnflag", "l_linenumber").agg(F.hll_sketch_agg("l_partkey", 14).alias("s")).groupBy("l_returnflag").agg(F.hll_union_agg("s").alias("u"))
    near = lambda a, b, share: F.abs(a - b) <= share * b
    return by.join(parts, "l_returnflag").select("l_returnflag", near(F.hll_sketch_estimate("s"), F.col("n"), 0.05).alias("distinct_near"), near(F.col("q"), F.col("m"), 0.02).alias("median_near"), near(F.hll_sketch_estimate("u"), F.hll_sketch_estimate("s"), 0.02).alias("merged_same"))


@query("with " + INTERVALS + ", r as (select run, task, list(lo || '-' || hi order by lo, hi) l, count(*) n from iv group by 1, 2) select run, list(task order by task) tasks, list(n order by task) counts, sum(n)::bigint total, list(l order by task)[1] as first, array_to_string(list_transform(range(1, len(list(n)) + 1), lambda k: list_sum(list(n order by task)[1:k])::bigint), ' ') running from r group by run")
def task_dictionary(spark, d):
    """Dictionaries: task to ranges and task to count of each run as maps, and the counts' running sums."""
    text = F.concat(F.col("lo").cast("string"), F.lit("-"), F.col("hi").cast("string"))
    r = _intervals(spark, d).groupBy("run", "task").agg(F.sort_array(F.collect_list(F.struct("lo", "hi", text.alias("x")))).alias("l"), F.count(F.lit(1)).alias("n"))
    entries = lambda c: F.map_from_entries(F.sort_array(F.collect_list(F.struct("task", c))))
    m = r.groupBy("run").agg(entries(F.transform("l", lambda x: x["x"]).alias("v")).alias("ranges"), entries(F.col("n").alias("v")).alias("counts"))
    return m.select("run", F.map_keys("counts").alias("tasks"), F.map_values("counts").alias("counts"), F.aggregate(F.map_values("counts"), F.lit(0).cast("long"), lambda a, x: a + x).alias("total"), F.map_values("ranges")[0].alias("first"), F.array_join(F.transform(S.running_sums(F.map_values("counts")), lambda x: x.cast("string")), " ").alias("running"))


@query(with_(VOLUME, *[f"{b} as (select a.voxel, a.i, a.j, a.k, sum(w * x) / sum(w) v from (select p.voxel, p.i, p.j, p.k, q.v x, exp(-((p.i - q.i) ** 2 + (p.j - q.j) ** 2 + (p.k - q.k) ** 2) / 2.0 - (p.v - q.v) ** 2 / 20000.0) w from {a} p join {a} q on abs(p.i - q.i) <= 1 and abs(p.j - q.j) <= 1 and abs(p.k - q.k) <= 1) a group by 1, 2, 3, 4)" for a, b in (("vol", "b1"), ("b1", "b2"))]) + "select voxel, round(v, 3) v from b2")
def bilateral_twice(spark, d):
    return rounded(P.bilateral(volume(spark, d), 1, 1.0, 100.0, flat=False, iterations=2), 3)


@query(with_(VOLUME, "nb as (select a.voxel, b.v, row_number() over (partition by a.voxel order by b.v) - 1 r, count(*) over (partition by a.voxel) n from vol a join vol b on abs(a.i - b.i) <= 1 and abs(a.j - b.j) <= 1 and abs(a.k - b.k) <= 1)") + "select voxel, v from nb where r = n // 2")
def median_filter_box(spark, d):
    return P.median_filter(volume(spark, d), 1, flat=False)


@query("with x as (select p_partkey, (p_partkey % 41 - 20) / 8.0::double x from part) select p_partkey, round(case when abs(x) < 1 then -2 * x + 1.5 * x * abs(x) when abs(x) < 2 then -sign(x) * (2 - abs(x)) ** 2 / 2 else 0.0 end, 6) d from x")
def b_spline_slope(spark, d):
    x = (F.col("p_partkey") % 41 - 20) / 8.0
    return rounded(read(spark, d, "part").select("p_partkey", S.b_spline_derivative(x).alias("d")), 6)


# --- chains of transformations, curvature ---------------------------------------------------------------------------------

_NODES = "nod as (select gi, gj, gk, 0.1 * gi + 0.02 * gj * gk dx, 0.05 * gj dy, -0.04 * gk + 0.01 * gi * gi dz from (select unnest(range(5)) gi), (select unnest(range(5)) gj), (select unnest(range(12)) gk))"
_CHAIN = [
    _NODES, "pl as (select voxel, i, j, k, i::double x, j::double y, k::double z, least(trunc(i / 2.5)::int, 4) a, least(trunc(j / 2.5)::int, 4) b, least(trunc(k / 2.5)::int, 11) c, i / 2.5::double - trunc(i / 2.5) u, j / 2.5::double - trunc(j / 2.5) v, k / 2.5::double - trunc(k / 2.5) w from vol)",
    "mv as (select voxel, i, j, k, x, y, z, sum(g * dx) mx, sum(g * dy) my, sum(g * dz) mz from (select pl.*, least(a + p, 4) na, least(b + q, 4) nb, least(c + r, 11) nc, (case p when 1 then u else 1 - u end) * (case q when 1 then v else 1 - v end) * (case r when 1 then w else 1 - w end) g from pl, (select unnest([0, 1]) p), (select unnest([0, 1]) q), (select unnest([0, 1]) r)) join nod on gi = na and gj = nb and gk = nc group by 1, 2, 3, 4, 5, 6, 7)",
    "fld as (select voxel, i, j, k, 1.1 * (x + mx) - 0.2 * (y + my) + 3 - x dx, 0.9 * (y + my) - y dy, 1.2 * (z + mz) + 0.1 * (x + mx) - z dz, mx, my, mz from mv)",
]


def _combo(spark, d):
    nodes = volume(spark, d).where("i < 5 and j < 5").select(F.col("i").alias("gi"), F.col("j").alias("gj")).distinct().withColumn("gk", F.explode(F.sequence(F.lit(0), F.lit(11))))
    i, j, k = F.col("gi"), F.col("gj"), F.col("gk")
    nodes = nodes.select("gi", "gj", "gk", (0.1 * i + 0.02 * j * k).alias("dx"), (0.05 * j).alias("dy"), (-0.04 * k + 0.01 * i * i).alias("dz"))
    return M.combo([[1.1, -0.2, 0, 3], [0, 0.9, 0, 0], [0.1, 0, 1.2, 0]], [M.grid_step(nodes, (0, 0, 0), (2.5, 2.5, 2.5), (5, 5, 12), spline=False)])


@query(with_(VOLUME, *_CHAIN) + "select voxel, i, j, k, round(dx, 4)::double dx, round(dy, 4)::double dy, round(dz, 4)::double dz from fld")
def combo_displacement(spark, d):
    return rounded(M.chain_displacement(volume(spark, d), _combo(spark, d)))


_SLOPES = ", ".join(f"(lead({m}) over w{a} - lag({m}) over w{a}) / 2 s{m}{a}" for m in ("mx", "my", "mz") for a in "ijk")


@query(with_(VOLUME, *_CHAIN, f"sl as (select voxel, {_SLOPES} from fld window wi as (partition by j, k order by i), wj as (partition by i, k order by j), wk as (partition by i, j order by k))")
    + "select voxel, round(coalesce(100 * ((1 + smxi) * ((1 + smyj) * (1 + smzk) - smyk * smzj) - smxj * (smyi * (1 + smzk) - smyk * smzi) + smxk * (smyi * smzj - (1 + smyj) * smzi) - 1), 0), 3)::double v from sl")
def jacobian_nonlinear(spark, d):
    return rounded(M.chain_jacobian(volume(spark, d), _combo(spark, d), nonlinear_only=True), 3)


_COT = "cor as (select fac.id f, unnest([v0, v1, v2]) p, unnest([v1, v2, v0]) q, unnest([v2, v0, v1]) r from fac)"
_CURVE = [
    _COT, "crn as (select f, cor.p, cor.q, cor.r, a.x px, a.y py, a.z pz, b.x qx, b.y qy, b.z qz, c.x rx, c.y ry, c.z rz from cor join ver a on cor.p = a.id join ver b on cor.q = b.id join ver c on cor.r = c.id)",
    "ar as (select id f, sqrt(wx * wx + wy * wy + wz * wz) / 2 area from crs)", "ct as (select f, p, ((qx - px) * (rx - px) + (qy - py) * (ry - py) + (qz - pz) * (rz - pz)) dt, ((qx - px) * (rx - px) + (qy - py) * (ry - py) + (qz - pz) * (rz - pz)) / (2 * area) cot from crn join ar using (f))",
    "bl as (select f, bool_or(dt < 0) obtuse from ct group by f)",
    "tm as (select n.p, case when obtuse then case when o.dt < 0 then area / 2 else area / 4 end else (((px - qx) ** 2 + (py - qy) ** 2 + (pz - qz) ** 2) * cr.cot + ((px - rx) ** 2 + (py - ry) ** 2 + (pz - rz) ** 2) * cq.cot) / 8 end s, cr.cot * (px - qx) + cq.cot * (px - rx) x, cr.cot * (py - qy) + cq.cot * (py - ry) y, cr.cot * (pz - qz) + cq.cot * (pz - rz) z from crn n join ar using (f) join bl using (f) join ct o on o.f = n.f and o.p = n.p join ct cq on cq.f = n.f and cq.p = n.q join ct cr on cr.f = n.f and cr.p = n.r)",
    "sm as (select p id, sum(s) area, sqrt(sum(x) ** 2 + sum(y) ** 2 + sum(z) ** 2) / sum(s) / 2 curvature from tm group by p)",
]


@query(with_(MESH, *_CURVE) + "select id, round(area, 4) area, round(curvature, 4) curvature from sm where id not in (select unnest([a, b]) from edg where n = 1)")
def mesh_curvature(spark, d):
    return rounded(W.vertex_curvature(*_mesh(spark, d)))


# --- an image that is written and read by ranges -----------------------------------------------------------------------------


@query(with_(SERIES) + "select t, sum(floor(v))::double v from ser where t between 5 and 9 or t = 20 group by t")
def frames_of_file(spark, d):
    """The series as one NIfTI file in the shared folder; six of its frames are read back by ranges of bytes, the others are not."""
    from ..sources.images import write_nifti
    from ..sources.ranges import read_planes
    from ..sources.scratch import folder

    v = F.col("voxel")
    img = series(spark, d).select(F.lit("series.nii").alias("name"), (v % 10).cast("int").alias("i"), F.floor(v / 10).cast("int").alias("j"), F.lit(0).alias("k"), "t", F.floor("v").cast("double").alias("v"))
    path = folder(spark)
    write_nifti(img, path, compress=False)
    few = read_planes(spark, path, 1 << 14).where("t >= 5 and t <= 9").unionByName(read_planes(spark, path, 1 << 14).where("t = 20"))
    return few.groupBy("t").agg(F.sum("v").alias("v"))
