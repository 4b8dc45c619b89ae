"""Queries of distance matrices, resampling by frame, meshes and parcels, each with its SQL twin."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import distances as D
from ..operators import elementwise as E
from ..operators import geometry as M
from ..operators import neighbours as N
from ..operators import spatial as P
from ..operators import statistics as A
from ..operators import surfaces as W
from ..sources.adapters import SERIES, VOLUME, read, series, volume
from .queries import _dims, _points, query, rounded, with_

# --- voxels ---------------------------------------------------------------------------------------------------------


@query(with_(VOLUME, "m as (select min(v) lo from vol)") + "select voxel, i, j, k, label, case when label >= 20 then v else lo end v from vol, m")
def mask_to_minimum(spark, d):
    v = volume(spark, d)
    return E.apply_mask(v, v.select("voxel", F.col("label").alias("mask")), 20, outside=E.lowest(v))


@query(with_(VOLUME, "m as (select min(v) lo from vol)") + "select voxel, i, j, k, label, case when i between 2 and 7 and k between 1 and 12 then v else lo end v from vol, m")
def blank_to_minimum(spark, d):
    v = volume(spark, d)
    return E.blank(v, {"i": (2, 7), "k": (1, 12)}, E.lowest(v))


@query(with_(VOLUME) + "select (g.i + 3)::int i, (g.j - 4)::int j, (g.k + 2)::int k, coalesce(v, 0.0) v from (select unnest(range(-3, 8)) i) a, lateral (select a.i, unnest(range(4, 13)) j) b, lateral (select b.i, b.j, unnest(range(-2, 2)) k) g left join vol on vol.i = g.i and vol.j = g.j and vol.k = g.k")
def crop_padded(spark, d):
    return E.crop_padded(volume(spark, d), {"i": (-3, 7), "j": (4, 12), "k": (-2, 1)})


@query(with_(VOLUME) + "select voxel, k as i, (9 - i)::int as j, j as k, label, v from vol")
def permute_mirrored(spark, d):
    return E.permute_mirrored(volume(spark, d), ["K", "Im", "J"], {"i": 10, "j": 10})


@query(with_(VOLUME, "m as (select max(k) + 1 n from vol)") + "select voxel, i, j, v from vol, m where k = n // 2")
def middle_plane(spark, d):
    v = volume(spark, d)
    return E.plane(v, "k", -1, _dims(v)[2]).select("voxel", "i", "j", "v")


@query(with_(VOLUME, "m as (select max(v) top from vol)") + "select voxel, i, j, k, label, case when i % 3 = 0 or j % 3 = 0 then 0.5 * top else v end v from vol, m")
def grid_relative(spark, d):
    v = volume(spark, d)
    return E.add_grid(v, 3, 0.5 * v.agg(F.max("v")).first()[0])


@query(with_(SERIES) + "select t, label, coalesce(n, 0) n from (select t, unnest(range(6))::int label from (select distinct t from ser)) left join (select t, ((voxel + t) % 7)::int label, count(*) n from ser group by 1, 2) using (t, label)")
def label_counts_by_frame(spark, d):
    s = series(spark, d)
    return E.label_counts_by_frame(s.select("t", "voxel", ((F.col("voxel") + F.col("t")) % 7).cast("double").alias("v")), 5)


# --- distance matrices ------------------------------------------------------------------------------------------------

_D2 = "((a.i - b.i) * (a.i - b.i) + (a.j - b.j) * (a.j - b.j) + (a.k - b.k) * (a.k - b.k))::double"
_FEATURE = "(a.v - b.v) * (a.v - b.v)"
_SPARSE = f"""near as (select a.voxel i, b.voxel j, {_FEATURE} feature, {_D2} dist from vol a join vol b on a.label = b.label and a.voxel <> b.voxel),
 rk as (select *, row_number() over (partition by i order by feature, j) r from near), cut as (select i, feature c from rk where r = 4),
 mat as (select near.* from near left join cut using (i) where c is null or feature < c union all select voxel, voxel, 0.0::double, 0.0::double from vol)"""


def _featured(spark, d):
    return _points(spark, d).join(volume(spark, d).select(F.col("voxel").alias("id"), F.col("v").alias("f")), "id")


@query(with_(VOLUME) + f"select a.voxel i, b.voxel j, round({_FEATURE}, 4) feature, {_D2} dist from vol a join vol b on a.label = b.label where {_D2} <= 16")
def radius_matrix(spark, d):
    return rounded(D.radius_matrix(_featured(spark, d), 4.0))


@query(with_(VOLUME, _SPARSE) + "select i, j, round(feature, 4) feature, dist from mat")
def sparse_matrix(spark, d):
    return rounded(D.sparse_matrix(_featured(spark, d), 3))


_SERIES_SPARSE = """pt as (select voxel, voxel % 3 as label, (voxel % 10)::double x, (voxel // 10)::double y, list(floor(v / 40)::double order by t) f from ser group by voxel),
 nb as (select greatest(2, least(count(*), floor(count(*) * 4.0 * 0.01)::bigint)) best from pt),
 near as (select a.voxel i, b.voxel j, list_sum(list_transform(range(1, 31), lambda n: (a.f[n] - b.f[n]) * (a.f[n] - b.f[n]))) feature, (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) dist from pt a join pt b on a.label = b.label and a.voxel <> b.voxel),
 rk as (select *, row_number() over (partition by i order by feature, j) r from near), cut as (select i, feature c from rk, nb where r = best + 1)"""


@query(with_(SERIES, _SERIES_SPARSE) + "select near.* from near left join cut using (i) where c is null or feature < c union all select voxel, voxel, 0.0::double, 0.0::double from pt")
def knn_series(spark, d):
    f = F.transform(F.array_sort(F.collect_list(F.struct("t", "v"))), lambda p: F.floor(p["v"] / 40).cast("double"))
    place = F.array((F.col("voxel") % 10).cast("double"), F.floor(F.col("voxel") / 10).cast("double"))
    points = series(spark, d).groupBy("voxel").agg(f.alias("f")).select(F.col("voxel").alias("id"), (F.col("voxel") % 3).alias("label"), "f", place.alias("place"))
    return N.sparse_series_matrix(points, sparsity=4.0)


_AFFINITY = """med as (select quantile_cont(feature + 0.5 * dist, 0.5) m from mat where i <> j), ex as (select i, j, exp(-(feature + 0.5 * dist) / (greatest(m, 1e-5::double) * 2)) e from mat, med),
 sc as (select i, 1 / sqrt(sum(e) + 1) s from ex group by i), pr as (select ex.i, ex.j, a.s * b.s * case when ex.i = ex.j then e + 0.5 else 0.5 * e end w from ex join sc a on ex.i = a.i join sc b on ex.j = b.i),
 aff as (select i src, j dst, sum(w) w from (select i, j, w from pr union all select j, i, w from pr where i <> j) group by 1, 2)"""


@query(with_(VOLUME, _SPARSE, _AFFINITY) + "select src, dst, round(w, 6) w from aff")
def affinity(spark, d):
    return rounded(D.affinity(D.sparse_matrix(_featured(spark, d), 3), 0.5, 2.0), 6)


@query(with_(VOLUME) + "select q, p, d2 from (select a.voxel q, b.voxel p, " + _D2 + " d2 from vol a, vol b where a.label <= 45 and b.label > 45) qualify row_number() over (partition by q order by d2, p) = 1")
def nearest_labelled(spark, d):
    """Every voxel outside the labels above 45 looks for the nearest inside them, in cells that grow until it has one."""
    from ..operators.joins import nearest

    p = _points(spark, d)
    return nearest(p.where("label <= 45"), p.where("label > 45"))


# --- resampling -------------------------------------------------------------------------------------------------------


def _cubic(a: str, top: str) -> str:
    w = "case o when -1 then -0.5 * f * (f - 1) * (f - 1) when 0 then 1 - 2.5 * f * f + 1.5 * f * f * f when 1 then 0.5 * f + 2 * f * f - 1.5 * f * f * f else 0.5 * f * f * (f - 1) end"
    return f"w{a} as (select voxel, least(greatest(b + o, 0), {top})::int n{a}, {w} w{a} from (select voxel, floor(s)::int b, s - floor(s) f, unnest([-1, 0, 1, 2]) o from (select voxel, greatest(least(0.9137 * {a} + 0.2718, ({top})::double), 0.0) s from vol, top)))"


@query(with_(VOLUME, "top as (select max(k) m from vol)", _cubic("i", "9"), _cubic("j", "9"), "tk as (select voxel, k, m from vol, top)", "wk as (select voxel, k nk, 1.0::double wk from vol)") + "select i, j, k, round(coalesce(w, 0.0), 3) v from vol g left join (select wi.voxel, sum(wi * wj * wk * x.v) w from wi join wj using (voxel) join wk using (voxel) join vol x on x.i = ni and x.j = nj and x.k = nk group by 1) using (voxel)")
def reslice_cubic(spark, d):
    v = volume(spark, d)
    return rounded(M.reslice(v, v, [[0.9137, 0, 0, 0.2718], [0, 0.9137, 0, 0.2718], [0, 0, 1, 0]], _dims(v), cubic=True), 3)


@query(with_(VOLUME) + "select c.t, a.i, a.j, a.k, round(coalesce((1 - 0.25 * t) * b.v * (t + 1) + 0.25 * t * e.v * (t + 1), 0.0), 3) v from vol a, (select unnest([0, 1, 2])::int t) c left join vol b on b.i = a.i and b.j = a.j and b.k = a.k left join vol e on e.i = least(a.i + 1, 9) and e.j = a.j and e.k = a.k")
def motion_reslice(spark, d):
    v = volume(spark, d)
    t = spark.range(3).select(F.col("id").cast("int").alias("t"))
    frames = v.join(F.broadcast(t), how="cross").select("t", "i", "j", "k", (F.col("v") * (F.col("t") + 1)).alias("v"))
    one, none = F.lit(1.0), F.lit(0.0)
    moves = t.select("t", F.array(one, none, none, 0.25 * F.col("t"), none, one, none, none, none, none, one, none).alias("m"))
    return rounded(M.motion_reslice(frames, moves, _dims(v)), 3)


@query(with_(VOLUME) + "select round(sqrt(avg(0.01 * i * i + 0.25 + 0.04 * k * k)), 6) rms from vol")
def round_trip_error(spark, d):
    there = [[1.1, 0, 0, 0], [0, 1, 0, 0.5], [0, 0, 0.8, 0]]
    return rounded(M.round_trip_error(_points(spark, d), there, [[1, 0, 0, 0], [0, 1, 0, 0], [0, 0, 1, 0]]), 6)


@query(with_(VOLUME, "kx as (select unnest([-1, 0, 1]) o)", "kw as (select o, exp(-0.5 * o * o)::double / (1 + 2 * exp(-0.5::double)) w from kx)", "tp as (select max(k) m from vol)", *[f"s{a} as (select q.i, q.j, q.k, sum(w * p.v) v from {src} q, kw, tp join {src} p on {on} group by 1, 2, 3)" for a, src, on in (
    ("i", "vol", "p.i = least(greatest(q.i + o, 0), 9) and p.j = q.j and p.k = q.k"),
    ("j", "si", "p.j = least(greatest(q.j + o, 0), 9) and p.i = q.i and p.k = q.k"),
    ("k", "sj", "p.k = least(greatest(q.k + o, 0), m) and p.i = q.i and p.j = q.j"),
)]) + "select (i // 2)::int i, (j // 2)::int j, k, round(v, 3) v from sk where i % 2 = 0 and j % 2 = 0")
def smooth_and_resample(spark, d):
    v = P.smooth(volume(spark, d), 1.0)
    grid = v.where("i % 2 = 0 and j % 2 = 0").select((F.col("i") / 2).cast("int").alias("i"), (F.col("j") / 2).cast("int").alias("j"), "k")
    return rounded(M.reslice(v, grid, [[2, 0, 0, 0], [0, 2, 0, 0], [0, 0, 1, 0]], _dims(v)), 3)


# --- meshes: all parts as a grid of rows of 20, its squares as two triangles each, heights from prices ------------------


def _mesh(spark, d):
    p = read(spark, d, "part").select(F.col("p_partkey").alias("id"), (F.col("p_retailprice") % 7).alias("z"))
    v = p.select("id", (F.col("id") % 20).cast("double").alias("x"), F.floor(F.col("id") / 20).cast("double").alias("y"), "z")
    q = p.join(p.select((F.col("id") - 21).alias("id")), "id", "left_semi").where("id % 20 < 19").select("id", F.col("id").alias("p"))
    tri = F.explode(F.array(F.struct((F.col("id") * 2).alias("id"), F.col("p").alias("v0"), (F.col("p") + 1).alias("v1"), (F.col("p") + 20).alias("v2")), F.struct((F.col("id") * 2 + 1).alias("id"), (F.col("p") + 1).alias("v0"), (F.col("p") + 21).alias("v1"), (F.col("p") + 20).alias("v2"))))
    return v, q.select(tri.alias("f")).select("f.*")


MESH = """ver as (select p_partkey id, (p_partkey % 20)::double x, (p_partkey // 20)::double y, p_retailprice % 7 z from part),
 qd as (select p_partkey n, p_partkey p from part where p_partkey % 20 < 19 and p_partkey + 21 in (select p_partkey from part)), fac as (select n * 2 id, p v0, p + 1 v1, p + 20 v2 from qd union all select n * 2 + 1, p + 1, p + 21, p + 20 from qd),
 crs as (select fac.id, v0, v1, v2, (b.y - a.y) * (c.z - a.z) - (b.z - a.z) * (c.y - a.y) wx, (b.z - a.z) * (c.x - a.x) - (b.x - a.x) * (c.z - a.z) wy, (b.x - a.x) * (c.y - a.y) - (b.y - a.y) * (c.x - a.x) wz, (a.z + b.z + c.z) / 3 cz
 from fac join ver a on v0 = a.id join ver b on v1 = b.id join ver c on v2 = c.id),
 edg as (select least(p, q) a, greatest(p, q) b, count(*) n from (select v0 p, v1 q from fac union all select v1, v2 from fac union all select v2, v0 from fac) group by 1, 2)"""


@query(with_(MESH) + "select id, round(sqrt(wx * wx + wy * wy + wz * wz) / 2, 4) area, round(cz, 4) cz, round(wz / sqrt(wx * wx + wy * wy + wz * wz), 4) nz from crs")
def mesh_faces(spark, d):
    return rounded(W.face_table(*_mesh(spark, d)).select("id", "area", "cz", "nz"))


@query(with_(MESH) + "select a, b, n from edg")
def mesh_edges(spark, d):
    return W.edge_table(_mesh(spark, d)[1])


@query(with_(MESH, "vn as (select id, sum(wx) x, sum(wy) y, sum(wz) z from (select v0 id, wx, wy, wz from crs union all select v1, wx, wy, wz from crs union all select v2, wx, wy, wz from crs) group by 1)") + "select id, round(x / sqrt(x * x + y * y + z * z), 4) nx, round(y / sqrt(x * x + y * y + z * z), 4) ny, round(z / sqrt(x * x + y * y + z * z), 4) nz from vn")
def mesh_normals(spark, d):
    return rounded(W.vertex_normals(*_mesh(spark, d)))


@query(with_(MESH, "bo as (select a, b from edg union all select b, a from edg)", "mv as (select a id, avg(x) x, avg(y) y, avg(z) z from bo join ver on b = id group by 1)") + "select id, round(v.x + 0.5 * (m.x - v.x), 4) x, round(v.y + 0.5 * (m.y - v.y), 4) y, round(v.z + 0.5 * (m.z - v.z), 4) z from ver v join mv m using (id)")
def mesh_relax(spark, d):
    return rounded(W.relax(*_mesh(spark, d), rounds=1))


# --- parcels of series ------------------------------------------------------------------------------------------------

_UNITS = """mn as (select voxel, avg(v) m from ser group by 1), nr as (select voxel, sqrt(sum((v - m) * (v - m))) n from ser join mn using (voxel) group by 1),
 un as (select voxel, t, (v - m) / n x from ser join mn using (voxel) join nr using (voxel) where n > 1e-9),
 pc as (select distinct voxel, (voxel % 10)::int i, (voxel // 10)::int j, 0::int k, (1 + (voxel % 10) // 4)::int label from ser),
 tot as (select label, t, sum(x) s from un join pc using (voxel) group by 1, 2), sc as (select voxel, label, round(sum(x * s), 9) near from un join pc using (voxel) join tot using (label, t) group by 1, 2),
 ex as (select label, voxel e from sc qualify row_number() over (partition by label order by near desc, voxel) = 1)"""


def _parcels(spark, d):
    s = series(spark, d)
    v = F.col("voxel")
    return D.unit_series(s), s.select("voxel").distinct().select("voxel", (v % 10).cast("int").alias("i"), F.floor(v / 10).cast("int").alias("j"), F.lit(0).alias("k"), (1 + F.floor(v % 10 / 4)).cast("int").alias("label"))


@query(with_(SERIES, _UNITS) + "select label, e voxel from ex")
def parcel_exemplars(spark, d):
    return D.exemplars(*_parcels(spark, d)).select("label", "voxel")


@query(with_(SERIES, _UNITS, "cand as (select distinct a.voxel, b.label to_ from pc a join pc b on abs(a.i - b.i) + abs(a.j - b.j) <= 1)", "ch as (select c.voxel, to_, round(sum(a.x * b.x), 9) near from cand c join ex on ex.label = to_ join un a on a.voxel = c.voxel join un b on b.voxel = e and b.t = a.t group by 1, 2)", "best as (select voxel, to_ from ch qualify row_number() over (partition by voxel order by near desc, to_) = 1)") + "select pc.voxel, i, j, k, coalesce(to_, label)::int label from pc left join best using (voxel)")
def individual_parcels(spark, d):
    return D.refine_parcels(*_parcels(spark, d))


@query("with x as (select l_partkey % 50 g, l_quantity y, l_quantity * 0.9 + l_discount * 10 p from lineitem) select g, round(avg((y - p) * (y - p)), 6) mse from x group by g")
def mean_squared_error(spark, d):
    x = read(spark, d, "lineitem").select((F.col("l_partkey") % 50).alias("g"), F.col("l_quantity").alias("y"), (F.col("l_quantity") * 0.9 + F.col("l_discount") * 10).alias("p"))
    return rounded(A.mean_squared_error(x, "y", "p", "g"), 6)
