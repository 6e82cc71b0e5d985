"""Sequence / encoder queries (E1-E7, P21) on ``conversations``, ``pairs``, ``documents``."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import vector as V
from ..operators import encode as enc
from ..session import load, spread
from . import fixtures as fx
from .registry import register, with_ctes

VOCAB_SIZE = 1000
_TOK = r"regexp_extract_all(lower({c}), '([\p{{L}}\p{{N}}]+)', 1)"


def tok_sql(c):
    return _TOK.format(c=c)


_VOCAB = f"""tok_counts as (select token, count(*) as n from (select unnest({tok_sql('text')}) as token from conversations) t0
  group by token),
vocab as (select token, cast(row_number() over (order by n desc, token) + 3 as integer) as id, n from (
  select token, n from tok_counts order by n desc, token limit {VOCAB_SIZE}) t1)"""


def _conv(spark, sf_dir):
    return spread(load(spark, sf_dir, "conversations").select("conv_id", "turn", "text"))


def _vocab(spark, sf_dir):
    return enc.fit_vocab(_conv(spark, sf_dir), "text", VOCAB_SIZE)


@register("corpus_vocab", with_ctes(_VOCAB) + "select token, id, n from vocab")
def corpus_vocab(spark, sf_dir):
    return _vocab(spark, sf_dir)


def _pad_sql(x, n, v=0):
    return f"list_concat({x}, list_transform(range({n} - len({x})), lambda i: {v}))"


_ENC = with_ctes(_VOCAB, f"""toks as (select conv_id, turn, {tok_sql('text')} as l from conversations)""",
                 """pos_toks as (select conv_id, turn, generate_subscripts(l, 1) as pos, unnest(l) as tok from toks)""",
                 """looked as (select p.conv_id, p.turn, p.pos, coalesce(v.id, 1) as tid from pos_toks p
  left join vocab v on v.token = p.tok where p.pos <= 30)""",
                 """bodies as (select conv_id, turn, list(tid order by pos) as body from looked group by conv_id, turn)""",
                 """rows_ as (select c.conv_id, c.turn, coalesce(b.body, []::integer[]) as body from conversations c
  left join bodies b on b.conv_id = c.conv_id and b.turn = c.turn)""")


@register("encode_text", _ENC + f"""
select conv_id, turn, {_pad_sql('list_concat([2], body, [3])', 32)} as ids,
  {_pad_sql('list_transform(range(len(body) + 2), lambda i: 1)', 32)} as mask from rows_""")
def encode_text(spark, sf_dir):
    return enc.encode(_conv(spark, sf_dir), _vocab(spark, sf_dir), ["conv_id", "turn"], "text", 32)


@register("encode_text_shared_keys", _ENC + f"""
select conv_id, {_pad_sql('list_concat([2], body, [3])', 32)} as ids from rows_""")
def encode_text_shared_keys(spark, sf_dir):
    """Keyed by the conversation alone: every turn keeps its own sequence."""
    return enc.encode(_conv(spark, sf_dir), _vocab(spark, sf_dir), ["conv_id"], "text", 32).select("conv_id", "ids")


@register("embed_encoded", _ENC + """
, m as (select conv_id, turn, list_concat([2], body, [3]) as l from rows_)
select conv_id, turn, list_transform(range(16), lambda j: round(list_sum(list_transform(l, lambda i: sin(cast(i as double) * (j + 1)))) / len(l), 6)) as vec
from m""")
def embed_encoded(spark, sf_dir):
    """E5 fed with the ids and the mask of E2."""
    rows = enc.encode(_conv(spark, sf_dir), _vocab(spark, sf_dir), ["conv_id", "turn"], "text", 32)
    out = enc.embed_encoded(rows, enc.mean_embedding_encoder(VOCAB_SIZE + 4, 16), 32)
    return out.select("conv_id", "turn", V.round_vec("vec", 6).alias("vec"))


_PAIRS = with_ctes(_VOCAB, fx.PAIRS_CTE, f"""pt as (select pair_id, {tok_sql('premise')} as a, {tok_sql('hypothesis')} as b from pairs)""",
                   """cut as (select pair_id, a[1:least(len(a), greatest(31, 61 - len(b)))] as a,
  b[1:least(len(b), greatest(30, 61 - len(a)))] as b from pt)""",
                   """ia as (select pair_id, generate_subscripts(a, 1) as pos, unnest(a) as tok from cut)""",
                   """ib as (select pair_id, generate_subscripts(b, 1) as pos, unnest(b) as tok from cut)""",
                   """la as (select i.pair_id, list(coalesce(v.id, 1) order by i.pos) as l from ia i left join vocab v on v.token = i.tok group by i.pair_id)""",
                   """lb as (select i.pair_id, list(coalesce(v.id, 1) order by i.pos) as l from ib i left join vocab v on v.token = i.tok group by i.pair_id)""",
                   """both_ as (select c.pair_id, coalesce(la.l, []::integer[]) as a, coalesce(lb.l, []::integer[]) as b from cut c
  left join la on la.pair_id = c.pair_id left join lb on lb.pair_id = c.pair_id)""")


@register("encode_pairs", _PAIRS + f"""
select pair_id, {_pad_sql('list_concat([2], a, [3], b, [3])', 64)} as ids,
  {_pad_sql('list_concat(list_transform(range(len(a) + 2), lambda i: 0), list_transform(range(len(b) + 1), lambda i: 1))', 64)} as type_ids,
  {_pad_sql('list_transform(range(len(a) + len(b) + 3), lambda i: 1)', 64)} as mask from both_""")
def encode_pairs(spark, sf_dir):
    return enc.encode_pairs(fx.pairs(spark, sf_dir), _vocab(spark, sf_dir), ["pair_id"], max_len=64)


@register("assign_batches", """
select doc_id, cast((row_number() over (order by doc_id) - 1) // 64 as bigint) as batch from documents""")
def assign_batches(spark, sf_dir):
    d = load(spark, sf_dir, "documents").select("doc_id")
    return enc.assign_batches(d, 64, ["doc_id"])


@register("assign_batches_drop_last", """
select doc_id, batch from (select doc_id, cast((row_number() over (order by doc_id) - 1) // 64 as bigint) as batch,
  row_number() over (order by doc_id) - 1 as idx, count(*) over () as total from documents) t
where idx < (total // 64) * 64""")
def assign_batches_drop_last(spark, sf_dir):
    d = load(spark, sf_dir, "documents").select("doc_id")
    return enc.assign_batches(d, 64, ["doc_id"], drop_last=True)


_HASH = with_ctes(f"""ht as (select conv_id, turn, unnest({tok_sql('text')}) as t from conversations)""",
                  """hb as (select conv_id, turn, cast('0x' || substr(md5(t), 1, 8) as bigint) % 64 as b,
  case when cast('0x' || substr(md5(t), 9, 1) as bigint) % 2 = 0 then 1.0 else -1.0 end as s from ht)""",
                  """cells as (select conv_id, turn, b, sum(s) as v from hb group by conv_id, turn, b)""",
                  """grid as (select c.conv_id, c.turn, r.i, coalesce(x.v, 0.0) as v from conversations c cross join range(64) r(i)
  left join cells x on x.conv_id = c.conv_id and x.turn = c.turn and x.b = r.i)""",
                  """nrm as (select conv_id, turn, sqrt(sum(v * v)) as n from grid group by conv_id, turn)""")


@register("hash_encode", _HASH + """
select g.conv_id, g.turn, list(round(case when n.n = 0 then g.v else g.v / n.n end, 6) order by g.i) as vec
from grid g join nrm n on n.conv_id = g.conv_id and n.turn = g.turn group by g.conv_id, g.turn""")
def hash_encode(spark, sf_dir):
    h = enc.hash_encode(_conv(spark, sf_dir), ["conv_id", "turn"], "text", 64)
    return h.select("conv_id", "turn", V.round_vec("vec", 6).alias("vec"))


@register("hash_encode_shared_keys", _HASH + """
select g.conv_id, list(round(case when n.n = 0 then g.v else g.v / n.n end, 6) order by g.i) as vec
from grid g join nrm n on n.conv_id = g.conv_id and n.turn = g.turn group by g.conv_id, g.turn""")
def hash_encode_shared_keys(spark, sf_dir):
    h = enc.hash_encode(_conv(spark, sf_dir), "conv_id", "text", 64)
    return h.select("conv_id", V.round_vec("vec", 6).alias("vec"))


@register("embed_batch", _HASH + """
select g.conv_id, g.turn, list(round(case when n.n = 0 then g.v else g.v / n.n end, 6) order by g.i) as vec
from grid g join nrm n on n.conv_id = g.conv_id and n.turn = g.turn group by g.conv_id, g.turn""")
def embed_batch(spark, sf_dir):
    """E5 through ``predict_batch_udf`` with the stand-in encoder (same hashing
    as E6), so the batched path is checked against the SQL of ``hash_encode``."""
    out = enc.embed(_conv(spark, sf_dir), "text", batch_size=64)
    return out.select("conv_id", "turn", V.round_vec("vec", 6).alias("vec"))


@register("pooled_vectors", with_ctes(fx.VECTORS_CTE) + """
select uid, vec as first_vec,
  list_transform(range(1, len(vec) + 1), lambda i: round((vec[i] + vec[len(vec) + 1 - i]) / 2, 6)) as mean_vec
from vectors""")
def pooled_vectors(spark, sf_dir):
    v = fx.vectors(spark, sf_dir)
    hidden = F.array(F.col("vec"), F.reverse("vec"))  # a two-token [seq, dim] state per row
    return v.select("uid", V.pool_first(hidden).alias("first_vec"),
                    V.round_vec(V.pool_mean(hidden), 6).alias("mean_vec"))


# Weights by a rule that SQL can say, too: row b, column j of a table.
_RULE = "(({b} * 31 + {j} * 17) % 101) / 101.0"
WIDTH = 8


def _weights(spark, kind: str, rows: int) -> str:
    """A weights file as a user would have one; written where the driver runs, shipped to the executors by Spark."""
    import os
    import tempfile
    import uuid

    import numpy as np
    b, j = np.arange(rows)[:, None], np.arange(WIDTH)[None, :]
    path = os.path.join(tempfile.mkdtemp(prefix="tessel-weights-"), f"{kind}-{uuid.uuid4().hex}.npz")
    np.savez(path, kind=kind, table=((b * 31 + j * 17) % 101) / 101.0)
    return path


_WORD_VEC = f"""tok as (select {{key}}, unnest(regexp_extract_all(lower({{text}}), '([\\p{{{{L}}}}\\p{{{{N}}}}]+)', 1)) as t from {{src}}),
tv as (select {{key}}, j, avg({_RULE.format(b="(cast('0x' || substr(md5(t), 1, 8) as bigint) % 512)", j='j')}) as x from tok, range({WIDTH}) r(j) group by {{key}}, j)"""


@register("embed_pairs", with_ctes(
    "caps as (select vec_id as uid, cast(vec_id * vec_id % 9973 as varchar) || ' image ' || cast(vec_id as varchar) as content, 'caption of ' || cast(label as varchar) || ' and ' || cast(vec_id % 50 as varchar) as caption from embeddings)",
    _WORD_VEC.format(key="uid", text="caption", src="caps"),
    "bytes as (select uid, length(content) as n, unnest(string_split(content, '')) as c from caps)",
    f"iv as (select uid, j, sum({_RULE.format(b='ascii(c)', j='j')}) / max(n) as x from bytes, range({WIDTH}) r(j) group by uid, j)") + f"""
select c.uid, list_concat((select list(round(x, 6) order by j) from iv where iv.uid = c.uid), (select list(round(x, 6) order by j) from tv where tv.uid = c.uid)) as joint
from caps c""")
def embed_pairs(spark, sf_dir):
    """Image and caption vectors by two weights files; the image bytes are ASCII here, so that SQL can count them."""
    from ..operators import encoders
    e = load(spark, sf_dir, "embeddings")
    k = F.col("vec_id")
    content = F.concat((k * k % 9973).cast("string"), F.lit(" image "), k.cast("string"))
    caps = e.select(k.alias("uid"), F.encode(content, "UTF-8").alias("content"),
                    F.concat(F.lit("caption of "), F.col("label").cast("string"), F.lit(" and "), (k % 50).cast("string")).alias("caption"))
    out = encoders.embed_pairs_from_files(caps, _weights(spark, "byte_histogram", 256), _weights(spark, "hashed_words", 512))
    return out.select("uid", V.round_vec("joint", 6).alias("joint"))


@register("embed_cached", with_ctes(fx.POSTS_CTE, "docs as (select doc_id as uid, case when doc_id % 5 = 0 then 'the same text' else text end as text from documents)",
                                    _WORD_VEC.format(key="uid", text="text", src="docs")) + f"""
select d.uid, case when count(tv.x) = 0 then list_transform(range({WIDTH}), lambda i: 0.0) else list(round(tv.x, 6) order by j) end as vec
from docs d left join tv on tv.uid = d.uid group by d.uid""")
def embed_cached(spark, sf_dir):
    """Vectors of half the rows are stored first; the whole table then encodes only what is new."""
    from ..operators import encoders
    from ..session import shared_path
    docs = load(spark, sf_dir, "documents").select(F.col("doc_id").alias("uid"), F.when(F.col("doc_id") % 5 == 0, F.lit("the same text")).otherwise(F.col("text")).alias("text"))
    path, encoder = shared_path(spark, "vector-store"), encoders.encoder_from_file(spark, _weights(spark, "hashed_words", 512))
    encoders.embed_cached(docs.filter("uid % 2 = 0"), path, "rule", encoder)
    return encoders.embed_cached(docs, path, "rule", encoder).select("uid", V.round_vec("vec", 6).alias("vec"))
