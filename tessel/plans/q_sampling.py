"""Sampling queries (R1, R3, Q1 with R2/J3/J6/U1)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import sampling as R
from ..operators import vectors as vec_ops
from ..session import checkpoint, load
from . import fixtures as fx
from . import q_vectors
from .registry import register, with_ctes

SEED = 123
_KEY = f"md5('{SEED}:' || cast(uid as varchar))"


@register("sample_seeded", with_ctes(fx.VECTORS_CTE) + f"""
select uid, cast(row_number() over (order by {_KEY}, uid) - 1 as integer) as pos
from vectors order by {_KEY}, uid limit 30""")
def sample_seeded(spark, sf_dir):
    return R.sample_seeded(fx.vectors(spark, sf_dir), 30, SEED).select("uid", "pos")


@register("shuffle_rows", with_ctes(fx.VECTORS_CTE) + f"""
select uid, row_number() over (order by md5('{SEED}:0:' || cast(uid as varchar)), uid) - 1 as pos from vectors""")
def shuffle_rows(spark, sf_dir):
    return R.shuffle_rows(fx.vectors(spark, sf_dir).select("uid"), SEED, 0).select("uid", "pos")


def _odd_ctes(src: str) -> list[str]:
    return [c.replace("from map2d", f"from {src}") for c in _ODD_PARTS]


_ODD_PARTS = (
    f"""cent as (select uid as c, x as cx, y as cy, row_number() over (order by {_KEY}, uid) - 1 as idx,
       cast('0x' || substr(md5('{SEED}:odd:' || cast(uid as varchar)), 1, 8) as bigint) as hc
     from map2d order by {_KEY}, uid limit 30)""",
    """pts as (select uid, x, y, cast('0x' || substr(md5('123:odd:' || cast(uid as varchar)), 1, 8) as bigint) as hp from map2d)""",
    """d as (select c, idx, uid, (x - cx) * (x - cx) + (y - cy) * (y - cy) as dist from cent, pts where uid <> c)""",
    """nn as (select c, idx, uid, rank as pos from (
       select c, idx, uid, row_number() over (partition by c order by dist, uid) - 1 as rank from d) t where rank < 2)""",
    """odd as (select c, idx, uid, 3 as pos from (
       select cent.c, idx, pts.uid, row_number() over (partition by cent.c order by (hp + hc) % 4294967296, pts.uid) as r
       from cent, pts where pts.uid <> cent.c and not exists (select 1 from nn where nn.c = cent.c and nn.uid = pts.uid)) t
     where r = 1)""",
    """sets as (select idx, pos, uid from nn union all select idx, 2 as pos, c as uid from cent
     union all select idx, pos, uid from odd)""")

_SETS = """
select cast(idx as integer) as "index", cast(pos as integer) as pos, uid,
  cast(case when pos = 3 then 1 else 0 end as integer) as label, d.text
from sets left join documents d on d.doc_id = sets.uid"""


def _sets(spark, sf_dir, points):
    sets = checkpoint(R.odd_one_out(points.select("uid", F.array("x", "y").alias("vec")), 30, SEED))
    texts = load(spark, sf_dir, "documents").select(F.col("doc_id").alias("uid"), "text")
    return sets.join(vec_ops.texts_of(sets, texts), "uid", "left").select("index", "pos", "uid", "label", "text")


@register("odd_one_out", with_ctes(fx.MAP2D_CTE, *_odd_ctes("map2d")) + _SETS)
def odd_one_out(spark, sf_dir):
    return _sets(spark, sf_dir, fx.map2d(spark, sf_dir))


_NORM = q_vectors.PLANE_NORM


@register("odd_one_out_projected", with_ctes(*_NORM, *_odd_ctes("norm")) + _SETS)
def odd_one_out_projected(spark, sf_dir):
    """The whole chain: projection, 3-sigma trim, min-max, question sets."""
    return _sets(spark, sf_dir, q_vectors.plane_norm(spark, sf_dir))


@register("random_outsiders", with_ctes(
    fx.VECTORS_CTE,
    f"""grp as (select uid as g, cast('0x' || substr(md5('{SEED}:odd:' || cast(uid as varchar)), 1, 8) as bigint) as hg
     from vectors order by {_KEY}, uid limit 30)""",
    f"""pts as (select uid, cast('0x' || substr(md5('{SEED}:odd:' || cast(uid as varchar)), 1, 8) as bigint) as hp
     from vectors)""") + """
select g, uid from (
  select g, uid, row_number() over (partition by g order by (hp + hg) % 4294967296, uid) as r
  from grp, pts where uid <> g) t where r = 1""")
def random_outsiders(spark, sf_dir):
    v = fx.vectors(spark, sf_dir).select("uid")
    groups = R.sample_seeded(v, 30, SEED).select(F.col("uid").alias("g"))
    excluded = groups.select("g", F.col("g").alias("uid"))
    return R.random_outsiders(v, groups, excluded, SEED)
