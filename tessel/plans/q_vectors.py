"""Vector queries (P14/P15, P16/P22, V1-V11, J1, J3, S13) over ``embeddings``."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import vector as V
from ..operators import cells, spectral
from ..operators import sampling as R
from ..operators import vectors as ops
from ..session import checkpoint, load, shared_path
from . import fixtures as fx
from .registry import register, sql_of, with_ctes

SEED = 123
_KEY = f"md5('{SEED}:' || cast(uid as varchar))"
_L2SQ = "list_sum(list_transform(range(1, len({a}) + 1), lambda i: ({a}[i] - {b}[i]) * ({a}[i] - {b}[i])))"
_COS = ("case when list_dot_product({a}, {a}) = 0 or list_dot_product({b}, {b}) = 0 then 0.0 else "
        "list_dot_product({a}, {b}) / (sqrt(list_dot_product({a}, {a})) * sqrt(list_dot_product({b}, {b}))) end")


def l2sq_sql(a, b):
    return _L2SQ.format(a=a, b=b)


def cos_sql(a, b):
    return _COS.format(a=a, b=b)


def _texts(spark, sf_dir):
    return load(spark, sf_dir, "documents").select(F.col("doc_id").alias("uid"), "text")


@register("vector_shape", "select count(*) as rows, cast(max(len(embedding)) as integer) as width from embeddings")
def vector_shape(spark, sf_dir):
    return ops.shape(fx.vectors(spark, sf_dir))


@register("attach_vectors", with_ctes(fx.VECTORS_CTE) + """
select d.doc_id as uid, d.lang, cast(len(v.vec) as integer) as width, v.uid is not null as matched
from documents d left join vectors v on d.doc_id = v.uid""")
def attach_vectors(spark, sf_dir):
    docs = load(spark, sf_dir, "documents").select(F.col("doc_id").alias("uid"), "lang")
    return ops.attach_vectors(docs, fx.vectors(spark, sf_dir)).select(
        "uid", "lang", F.when(F.col("vec").isNotNull(), F.size("vec")).alias("width"), "matched")


@register("cosine_to_one", with_ctes(fx.VECTORS_CTE, f"q as (select vec from vectors order by {_KEY}, uid limit 1)") + f"""
select v.uid, round({cos_sql('v.vec', 'q.vec')}, 6) as cos from vectors v, q""")
def cosine_to_one(spark, sf_dir):
    vecs = fx.vectors(spark, sf_dir)
    qid = R.sample_seeded(vecs, 1, SEED).first()["uid"]
    out = ops.cosine_to(vecs, ops.vector_of(vecs, "uid", qid))
    return out.select("uid", F.round("cos", 6).alias("cos"))


@register("cosine_matrix", with_ctes(fx.VECTORS_CTE) + f"""
select * from (select a.uid as i, b.uid as j, round({cos_sql('a.vec', 'b.vec')}, 6) as sim
  from vectors a join vectors b on a.uid <= b.uid where {cos_sql('a.vec', 'b.vec')} >= 0.5) t""")
def cosine_matrix(spark, sf_dir):
    return ops.cosine_matrix(fx.vectors(spark, sf_dir), threshold=0.5).withColumn("sim", F.round("sim", 6))


@register("cosine_matrix_full", with_ctes(fx.VECTORS_CTE, f"few as (select uid, vec from vectors order by {_KEY}, uid limit 40)") + f"""
select a.uid as i, b.uid as j, round({cos_sql('a.vec', 'b.vec')}, 6) as sim from few a join few b on a.uid <= b.uid""")
def cosine_matrix_full(spark, sf_dir):
    """Every pair of a sampled set, negative and small values included."""
    few = R.sample_seeded(fx.vectors(spark, sf_dir), 40, SEED).select("uid", "vec")
    return ops.cosine_matrix(few).withColumn("sim", F.round("sim", 6))


_KNN_SELF = with_ctes(fx.VECTORS_CTE, f"""q as (select uid as q_uid, vec as qv from vectors order by {_KEY}, uid limit 10)""",
                      f"""d as (select q.q_uid, v.uid, {l2sq_sql('q.qv', 'v.vec')} as dist from q, vectors v)""",
                      """nn as (select q_uid, uid, dist, cast(row_number() over (partition by q_uid order by dist, uid) - 1 as integer) as rank from d)""")


@register("knn_self", _KNN_SELF + "select q_uid, rank, uid, round(dist, 6) as dist from nn where rank < 4")
def knn_self(spark, sf_dir):
    vecs = fx.vectors(spark, sf_dir)
    q = R.sample_seeded(vecs, 10, SEED)
    return ops.knn(q, vecs, 4, include_self=True).withColumn("dist", F.round("dist", 6))


@register("knn_graph", with_ctes(fx.VECTORS_CTE, f"""d as (select a.uid as q_uid, b.uid, {l2sq_sql('a.vec', 'b.vec')} as dist
  from vectors a join vectors b on a.uid <> b.uid)""",
                                 """nn as (select q_uid, uid, dist, cast(row_number() over (partition by q_uid order by dist, uid) - 1 as integer) as rank from d)""")
          + "select q_uid, rank, uid, round(dist, 6) as dist from nn where rank < 20")
def knn_graph(spark, sf_dir):
    g = ops.knn_graph(fx.vectors(spark, sf_dir), ks=(5, 10, 15, 20))
    return g.withColumn("dist", F.round("dist", 6))


@register("knn_graph_k5", with_ctes(fx.VECTORS_CTE, f"""d as (select a.uid as q_uid, b.uid, {l2sq_sql('a.vec', 'b.vec')} as dist
  from vectors a join vectors b on a.uid <> b.uid)""",
                                    """nn as (select q_uid, uid, cast(row_number() over (partition by q_uid order by dist, uid) - 1 as integer) as rank from d)""")
          + "select q_uid, rank, uid from nn where rank < 5")
def knn_graph_k5(spark, sf_dir):
    """One step of the neighbour-count sweep: the k = 5 graph as a part of the k = 20 one."""
    return ops.graph_for_k(ops.knn_graph(fx.vectors(spark, sf_dir), ks=(5, 10, 15, 20)), 5).select("q_uid", "rank", "uid")


@register("knn_graph_pruned", sql_of("knn_graph"))
def knn_graph_pruned(spark, sf_dir):
    """V9 with pivot cells: the same graph, points meet only the cells that may hold a neighbour."""
    g = cells.neighbour_graph(fx.vectors(spark, sf_dir), ks=(5, 10, 15, 20), cell_rows=64)
    return g.select("q_uid", "rank", "uid", F.round("dist", 6).alias("dist"))


@register("knn_indexed", sql_of("knn_self"))
def knn_indexed(spark, sf_dir):
    """V7 on a stored index: two thirds of the points built in, the rest appended."""
    vecs = fx.vectors(spark, sf_dir)
    path = shared_path(spark, "index")
    cells.build_index(vecs.filter("uid % 3 <> 0"), path, cell_rows=64)
    cells.append_index(vecs.filter("uid % 3 = 0"), path)
    nn = cells.search_index(R.sample_seeded(vecs, 10, SEED), path, 4, include_self=True)
    return nn.select("q_uid", "rank", "uid", F.round("dist", 6).alias("dist"))


@register("cosine_pairs", sql_of("cosine_matrix"))
def cosine_pairs(spark, sf_dir):
    """V3 with bounds: cells whose best possible cosine is under the threshold never meet."""
    return cells.cosine_pairs(fx.vectors(spark, sf_dir), 0.5, cell_rows=64).select("i", "j", F.round("sim", 6).alias("sim"))


@register("spectral_map")
def spectral_map(spark, sf_dir):
    """V6 by neighbour count: the map of the 5- and of the 20-neighbour graph."""
    graph = checkpoint(ops.knn_graph(fx.vectors(spark, sf_dir), ks=(5, 20)))
    maps = [spectral.spectral_map(graph, k, tolerance=1e-3).select(F.lit(k).alias("k"), "*") for k in (5, 20)]
    return maps[0].unionByName(maps[1])


@register("neighbour_report", _KNN_SELF + """, t as (select q_uid, rank, coalesce(text, '') as text from nn left join documents on documents.doc_id = nn.uid where rank < 4)
select q_uid, string_agg(text, chr(10) order by rank) as report from t group by q_uid""")
def neighbour_report(spark, sf_dir):
    vecs = fx.vectors(spark, sf_dir)
    nn = ops.knn(R.sample_seeded(vecs, 10, SEED), vecs, 4, include_self=True)
    return ops.neighbour_report(nn, _texts(spark, sf_dir))


_MINMAX = """mm as (select min(x) as mnx, max(x) as mxx, min(y) as mny, max(y) as mxy from {src})"""


def _minmax_sel(src):
    return (f"select uid, (x - mnx + 1e-6) / (mxx - mnx + 1e-6) as x, (y - mny + 1e-6) / (mxy - mny + 1e-6) as y "
            f"from {src}, mm")


@register("minmax_axes", with_ctes(fx.MAP2D_CTE, _MINMAX.format(src="map2d")) + _minmax_sel("map2d"))
def minmax_axes(spark, sf_dir):
    return ops.minmax(fx.map2d(spark, sf_dir), ["x", "y"])


_TRIM = with_ctes(fx.MAP2D_CTE,
                  """st as (select avg(x) as mux, stddev_pop(x) as sdx, avg(y) as muy, stddev_pop(y) as sdy from map2d)""",
                  """kept as (select uid, x, y from map2d, st where x < mux + 3 * sdx and x > mux - 3 * sdx
                     and y < muy + 3 * sdy and y > muy - 3 * sdy)""",
                  _MINMAX.format(src="kept"), f"norm as ({_minmax_sel('kept')})")


def _trimmed(spark, sf_dir):
    return ops.minmax(ops.trim_outliers(fx.map2d(spark, sf_dir), ["x", "y"]), ["x", "y"])


@register("trim_outliers", _TRIM + "select uid, round(x, 6) as x, round(y, 6) as y from norm")
def trim_outliers(spark, sf_dir):
    t = _trimmed(spark, sf_dir)
    return t.select("uid", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


@register("density_grid", _TRIM + """
select cast(least(floor(x * 10), 9) as integer) as bx, cast(least(floor(y * 10), 9) as integer) as by,
  count(*) as n from norm group by all""")
def density_grid(spark, sf_dir):
    return ops.density_grid(_trimmed(spark, sf_dir), bins=10)


@register("project_2d")
def project_2d(spark, sf_dir):
    return ops.project_2d(fx.vectors(spark, sf_dir))


# The two principal components of 2-D points in closed form: eigenvectors of the
# covariance matrix, each with its larger loading positive; points are not centred.
_PLANE_CTES = (
    fx.MAP2D_CTE,
    "cv as (select var_samp(x) as a, covar_samp(x, y) as b, var_samp(y) as c from map2d)",
    "ev as (select a, b, c, (a + c) / 2 + sqrt(((a - c) / 2) * ((a - c) / 2) + b * b) as l1, (a + c) / 2 - sqrt(((a - c) / 2) * ((a - c) / 2) + b * b) as l2 from cv)",
    "dirs as (select b / sqrt(b * b + (l1 - a) * (l1 - a)) as p1, (l1 - a) / sqrt(b * b + (l1 - a) * (l1 - a)) as q1, "
    "b / sqrt(b * b + (l2 - a) * (l2 - a)) as p2, (l2 - a) / sqrt(b * b + (l2 - a) * (l2 - a)) as q2 from ev)",
    "pc as (select p1 * sign(case when abs(p1) >= abs(q1) then p1 else q1 end) as p1, q1 * sign(case when abs(p1) >= abs(q1) then p1 else q1 end) as q1, "
    "p2 * sign(case when abs(p2) >= abs(q2) then p2 else q2 end) as p2, q2 * sign(case when abs(p2) >= abs(q2) then p2 else q2 end) as q2 from dirs)",
    "proj as (select uid, p1 * x + q1 * y as x, p2 * x + q2 * y as y from map2d, pc)")


_PLANE = with_ctes(*_PLANE_CTES)
PLANE_NORM = (
    *_PLANE_CTES,
    "st as (select avg(x) as mux, stddev_pop(x) as sdx, avg(y) as muy, stddev_pop(y) as sdy from proj)",
    "kept as (select uid, x, y from proj, st where x < mux + 3 * sdx and x > mux - 3 * sdx and y < muy + 3 * sdy and y > muy - 3 * sdy)",
    _MINMAX.format(src="kept"), f"norm as ({_minmax_sel('kept')})")


def plane_norm(spark, sf_dir):
    """Projection, 3-sigma trim and min-max of the 2-D points, computed once."""
    proj = checkpoint(_plane(spark, sf_dir))
    return checkpoint(ops.minmax(ops.trim_outliers(proj, ["x", "y"]), ["x", "y"]))


def _plane(spark, sf_dir):
    return ops.project_2d(fx.map2d(spark, sf_dir).select("uid", F.array("x", "y").alias("vec")))


@register("project_plane", _PLANE + "select uid, round(x, 6) as x, round(y, 6) as y from proj")
def project_plane(spark, sf_dir):
    return _plane(spark, sf_dir).select("uid", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


@register("density_grid_projected", with_ctes(*PLANE_NORM) + """
select cast(least(floor(x * 10), 9) as integer) as bx, cast(least(floor(y * 10), 9) as integer) as by, count(*) as n from norm group by all""")
def density_grid_projected(spark, sf_dir):
    return ops.density_grid(plane_norm(spark, sf_dir), bins=10)


# every third vector is printed with three elements, so the width filter drops rows
_PRINTED = "'[' || cast(x as varchar) || '  ' || cast(y as varchar) || case when uid % 3 = 0 then '  1e-08' else '' end || ']'"


@register("parse_vector_text", with_ctes(fx.MAP2D_CTE, f"printed as (select uid, {_PRINTED} as s from map2d)") + r"""
select uid, vec from (select uid, list_transform(list_filter(string_split_regex(trim(translate(s, '[]', '')), '\s+'),
  lambda p: p <> ''), lambda p: cast(p as double)) as vec from printed) t where len(vec) = 2""")
def parse_vector_text(spark, sf_dir):
    m = fx.map2d(spark, sf_dir)
    three = F.when(F.col("uid") % 3 == 0, F.array("x", "y", F.lit(1e-8))).otherwise(F.array("x", "y"))
    printed = m.select("uid", V.format_vector(three).alias("s"))
    parsed = printed.select("uid", V.parse_vector("s").alias("vec"))
    return ops.filter_dim(parsed, 2)


@register("joint_vectors", with_ctes(fx.POSTS_CTE, fx.VECTORS_CTE) + """
select p.id as uid, p.original_img_dir || split_part(p.original_img_filename, '.', 1) as img_fpath,
  v.vec || v.vec as joint from posts p join vectors v on p.id = 'p' || cast(v.uid as varchar)""")
def joint_vectors(spark, sf_dir):
    from ..functions import text as T
    p = fx.posts(spark, sf_dir)
    v = fx.vectors(spark, sf_dir).select(F.concat(F.lit("p"), F.col("uid").cast("string")).alias("id"), "vec")
    j = p.join(v, "id")
    return j.select(F.col("id").alias("uid"),
                    T.image_path(F.col("original_img_dir"), T.file_stem("original_img_filename")).alias("img_fpath"),
                    V.joint_vector("vec", "vec").alias("joint"))


@register("l2_to_one", with_ctes(fx.VECTORS_CTE, f"q as (select vec from vectors order by {_KEY}, uid limit 1)") + f"""
select v.uid, round({l2sq_sql('v.vec', 'q.vec')}, 6) as l2sq, round(sqrt({l2sq_sql('v.vec', 'q.vec')}), 6) as l2
from vectors v, q""")
def l2_to_one(spark, sf_dir):
    vecs = fx.vectors(spark, sf_dir)
    q = F.array(*[F.lit(x) for x in ops.vector_of(vecs, "uid", R.sample_seeded(vecs, 1, SEED).first()["uid"])])
    return vecs.select("uid", F.round(V.l2sq(F.col("vec"), q), 6).alias("l2sq"), F.round(V.l2(F.col("vec"), q), 6).alias("l2"))


@register("axis_stats", with_ctes(fx.MAP2D_CTE) + """
select min(x) as min_x, max(x) as max_x, round(avg(x), 6) as mean_x, round(stddev_pop(x), 6) as std_x,
  min(y) as min_y, max(y) as max_y, round(avg(y), 6) as mean_y, round(stddev_pop(y), 6) as std_y from map2d""")
def axis_stats(spark, sf_dir):
    st = ops.axis_stats(fx.map2d(spark, sf_dir), ["x", "y"])
    return st.select(*[F.round(c, 6).alias(c) if c.startswith(("mean", "std")) else F.col(c) for c in st.columns])
