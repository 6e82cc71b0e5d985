"""Registered queries of the training-data operators and their SQL oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..session import ensure_checkpoint_dir, load
from . import (bytebpe, decontam, maxscore, packing, phrases, quality, secrets, sharding, simhash, substring, tokenfiles, tokens, toxicity,
               whitening)
from .store import shared_folder

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ensure_checkpoint_dir(spark)
        return fn(spark, sf_dir)
    QUERIES[fn.__name__] = run
    return run


@query
def op1_simhash_dedup(spark, sf_dir):
    return simhash.near_duplicates(load(spark, sf_dir, "documents"))


@query
def op2_maxscore_topk(spark, sf_dir):
    return maxscore.top_k(load(spark, sf_dir, "embeddings"))


@query
def op3_quality_ftrl(spark, sf_dir):
    return quality.quality_scores(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels"))


@query
def op4_spaced_seed_decontamination(spark, sf_dir):
    return decontam.contaminated(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"))


@query
def op5_lpt_shards(spark, sf_dir):
    return sharding.assign_shards(load(spark, sf_dir, "documents"))


@query
def op6_toxicity_fm(spark, sf_dir):
    return toxicity.toxicity_scores(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels"))


@query
def op7_secret_scan(spark, sf_dir):
    return secrets.secret_spans(load(spark, sf_dir, "documents"))


@query
def op8_bm25_packing(spark, sf_dir):
    return packing.pack(load(spark, sf_dir, "documents"), tokens.tokenizer_path(), end_id=1)


@query
def op9_substring_dedup(spark, sf_dir):
    return substring.dedup(load(spark, sf_dir, "documents"))


@query
def op10_token_files(spark, sf_dir):
    path = shared_folder(spark, "tokens")
    tokenfiles.write_tokens(load(spark, sf_dir, "documents"), path, tokens.tokenizer_path(), end_id=2)
    return tokenfiles.read_digests(spark, path)


@query
def op11_embedding_whitening(spark, sf_dir):
    return whitening.whitened(load(spark, sf_dir, "embeddings"))


@query
def op12_byte_bpe(spark, sf_dir):
    return bytebpe.digests(load(spark, sf_dir, "documents"), tokens.tokenizer_path("byte_bpe_multi_50k.tiktoken"))


@query
def op13_phrase_collocations(spark, sf_dir):
    return phrases.collocations(load(spark, sf_dir, "documents"))


_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

ORACLES["op2_maxscore_topk"] = """
with v as (
  select vec_id, list_transform(embedding, lambda x: cast(floor(64 * cast(x as double)) as bigint)) as vec
  from embeddings
  where embedding is not null and vec_id is not null
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (
  select q.vec_id as query_id, d.vec_id as vec_id,
    cast(list_dot_product(cast(q.vec as double[]), cast(d.vec as double[])) as bigint) as score
  from v q join v d on q.vec_id % 20 = 0 and q.vec_id <> d.vec_id),
r as (
  select query_id, vec_id, score, row_number() over (partition by query_id order by score desc, vec_id) as rank from s)
select query_id, cast(rank as integer) as rank, vec_id, score from r where rank <= 20
"""

_SIGNS = r"[^0-9A-Za-z\x{80}-\x{10FFFF}]+"
_PLAIN = f"list_filter(list_transform({_WORDS.replace('text', 'lower(text)')}, lambda w: regexp_replace(w, '^{_SIGNS}|{_SIGNS}$', '', 'g')), lambda w: w <> '')"

ORACLES["op4_spaced_seed_decontamination"] = f"""
with d as (select doc_id, {_PLAIN} as ws from documents),
i as (select item_id, {_PLAIN} as ws from benchmark),
dw as (select doc_id, len(ws) as n, unnest(range(len(ws))) as p, unnest(ws) as w from d),
iw as (select item_id, len(ws) as l, unnest(range(len(ws))) as q, unnest(ws) as w from i),
hit as (
  select doc_id, item_id, p - q as diagonal, q, least(l, 15) as need, l, n
  from dw join iw using (w)),
line as (select doc_id, item_id, diagonal, need, l, n, list(q) as qs, count(*) as c from hit group by all having c >= 0.8 * need),
stretch as (
  select doc_id, item_id, diagonal, need, qs, unnest(range(greatest(0, -diagonal), least(l, n - diagonal) - need + 1)) as a from line),
scored as (
  select doc_id, item_id, diagonal + a as doc_word, a as item_word, need as n_words,
    len(list_filter(qs, lambda x: x >= a and x < a + need)) as n_equal from stretch),
ranked as (
  select *, row_number() over (partition by doc_id, item_id order by n_equal desc, doc_word, item_word) as rn
  from scored where n_equal >= 0.8 * n_words - 1e-9)
select doc_id, item_id, cast(doc_word as bigint) as doc_word, cast(item_word as bigint) as item_word,
  cast(n_words as bigint) as n_words, cast(n_equal as bigint) as n_equal from ranked where rn = 1
"""


def _found_sql(kind: int, pattern: str, keep: str = "true") -> str:
    """Matches of a pattern with their positions, from the pieces between them."""
    return f"""select doc_id, {kind} as kind, start, start + length(m) as stop, m from (
    select doc_id, m, list_sum(list_transform(gaps[1:k], lambda g: length(g))) + coalesce(list_sum(list_transform(ms[1:k - 1], lambda g: length(g))), 0) as start
    from (select doc_id, gaps, ms, unnest(range(1, len(ms) + 1)) as k, unnest(ms) as m from (
      select doc_id, string_split_regex(t, '{pattern}') as gaps, regexp_extract_all(t, '{pattern}') as ms from texts) x0) x1) x2 where {keep}"""


_SQ = "'" + "'"
_ASSIGN = secrets.ASSIGN.replace("'", _SQ)
_NAMES = "[" + ", ".join(f"'{k}'" for k in secrets.KINDS) + "]"
_NOT_ALLOWED = " and ".join(f"not regexp_matches(m, '{a}')" for a in secrets.ALLOWED)

ORACLES["op7_secret_scan"] = f"""
with texts as (select doc_id, coalesce(text, '') as t from documents),
base as (
  {_found_sql(0, _ASSIGN, f"length(regexp_extract(m, '{_ASSIGN}', 2)) >= {secrets.ASSIGN_MIN}")}
  union all {_found_sql(1, secrets.ACCESS)}
  union all {_found_sql(2, secrets.HEX)}),
cand as (
  select *, case when regexp_matches(m, '^[0-9a-fA-F]+$') then 3 else 4 end as ekind,
    row_number() over (order by doc_id, start) as cid
  from ({_found_sql(9, secrets.CANDIDATE.split(")", 1)[1])}) c0 where {_NOT_ALLOWED}),
win as (
  select doc_id, ekind, start, cid, unnest(range(0, length(m) - {secrets.WINDOW} + 1)) as i, string_split(m, '') as cs from cand),
high as (
  select doc_id, ekind, start, cid, i from win
  where list_entropy(cs[i + 1:i + {secrets.WINDOW}]) >= case when ekind = 3 then {secrets.HEX_BITS} else {secrets.MIXED_BITS} end - 1e-9),
grp as (
  select *, sum(case when prev is null or i > prev + {secrets.WINDOW} then 1 else 0 end) over (partition by cid order by i) as g from (
    select *, lag(i) over (partition by cid order by i) as prev from high) h),
entropy as (
  select doc_id, ekind as kind, start + min(i) as start, start + max(i) + {secrets.WINDOW} as stop from grp
  group by doc_id, ekind, cid, start, g),
every_ as (select doc_id, kind, start, stop from base union all select doc_id, kind, start, stop from entropy),
listed as (
  select doc_id, string_agg({_NAMES}[kind + 1] || ':' || cast(start as bigint) || ':' || cast(stop as bigint), ',' order by start, kind, stop) as spans,
    string_agg({_NAMES}[kind + 1] || ':' || cast(start as bigint) || ':' || cast(stop as bigint), ',' order by start, kind, stop) filter (where kind < 3) as own,
    count(*) filter (where kind = 0) as n_assign, count(*) filter (where kind = 1) as n_access, count(*) filter (where kind = 2) as n_hex
  from every_ group by doc_id)
select t.doc_id, coalesce(n_assign, 0) as n_assign, coalesce(n_access, 0) as n_access, coalesce(n_hex, 0) as n_hex,
  sha256(coalesce(own, '')) as base_sha256, coalesce(spans, '') as spans
from texts t left join listed l on l.doc_id = t.doc_id
"""

ORACLES["op9_substring_dedup"] = f"""
with d as (select doc_id, {_WORDS} as ws from documents),
win as (
  select doc_id, p, array_to_string(ws[p:p + 49], ' ') as s
  from (select doc_id, ws, unnest(range(1, len(ws) - 48)) as p from d) x),
first_ as (select s, min(doc_id) as f from win group by s),
gone as (select distinct win.doc_id, p + o as p from win join first_ using (s), range(50) r(o) where f < win.doc_id),
word as (select doc_id, unnest(range(1, len(ws) + 1)) as p, unnest(ws) as w from d),
kept as (
  select word.doc_id, string_agg(w, ' ' order by word.p) as t, count(*) as n
  from word anti join gone on gone.doc_id = word.doc_id and gone.p = word.p group by word.doc_id)
select d.doc_id, cast(len(ws) as bigint) as n_words, cast(len(ws) - coalesce(n, 0) as bigint) as n_removed,
  sha256(coalesce(t, '')) as kept_sha256
from d left join kept using (doc_id)
"""

ORACLES["op13_phrase_collocations"] = r"""
with p as (
  select coalesce(lang, 'und') as lang, unnest(string_split_regex(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) as piece from documents),
w as (select lang, regexp_extract_all(piece, '[^\x20\x09]+') as ws from p),
g as (
  select lang, k, unnest(list_transform(range(1, greatest(len(ws) - k + 2, 1)), lambda i: ws[i:i + k - 1])) as ph
  from w, range(1, 5) t(k)),
f as (select lang, k, ph, count(*) as a from g group by all),
total as (select lang, cast(sum(a) as bigint) as n from f where k = 1 group by lang),
c as (select * from f where k >= 2 and a >= 30),
sub as (
  select lang, a, unnest(case when k = 3 then [ph[1:2], ph[2:3]]
                              else [ph[1:3], ph[2:4], ph[1:2], ph[2:3], ph[3:4]] end) as ph
  from c where k >= 3),
held as (select lang, ph, max(a) as held from sub group by all),
kept as (
  select c.* from c left join held on held.lang = c.lang and held.ph = c.ph
  where held is null or 100::hugeint * held < 80::hugeint * c.a),
cut as (select *, unnest(range(1, k)) as j from kept),
scored as (
  select cut.lang, cut.ph, cut.a, x.a as l, y.a as r, j, (2000000::hugeint * cut.a) // (x.a::hugeint + y.a::hugeint) as score
  from cut join f x on x.lang = cut.lang and x.ph = cut.ph[1:j] join f y on y.lang = cut.lang and y.ph = cut.ph[j + 1:cut.k]),
best as (select *, row_number() over (partition by lang, ph order by score, j) as rn from scored),
listed as (
  select lang, array_to_string(ph, ' ') as phrase, a, l, r, score,
    row_number() over (partition by lang order by score desc, a desc, array_to_string(ph, ' ')) as rank
  from best where rn = 1)
select lang, cast(rank as bigint) as rank, phrase, cast(a as bigint) as a, cast(l as bigint) as l, cast(r as bigint) as r,
  n, cast(score as bigint) as score
from listed join total using (lang) where rank <= 2000
"""
