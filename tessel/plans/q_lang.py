"""Language-identification queries (L1-L5): profiles learnt from the labelled
documents, every document / post scored; accuracy on held-out odd ids."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import URL_PATTERN
from ..operators import lang as L
from ..operators import text as text_ops
from ..session import load, spread
from . import fixtures as fx
from . import sqlbits as S
from .registry import register, with_ctes

_LETTERS = r"[^\p{L}]+"


def grams_cte(src: str, id_col: str, text_col: str, extra: str = "") -> str:
    """DuckDB twin of ``lang.gram_array``: per-word padding, one gram per letter."""
    return f"""words as (
  select {id_col}{extra}, unnest(string_split(trim(regexp_replace(regexp_replace(lower({text_col}),
    {S.lit(URL_PATTERN)}, ' ', 'g'), {S.lit(_LETTERS)}, ' ', 'g')), ' ')) as w from {src}),
word_pos as (select {id_col}{extra}, w, unnest(range(1, length(w) + 1)) as i from words where w <> ''),
grams as (select {id_col}{extra}, substr(' ' || w || ' ', i, 3) as gram from word_pos)"""


def profile_ctes(train_filter: str) -> str:
    return f"""train_counts as (select lang, gram, count(*) as c from grams where {train_filter} group by lang, gram),
vocab as (select distinct gram from train_counts),
lden as (select lang, ln(sum(c) + (select count(*) from vocab)) as lden from train_counts group by lang),
prof as (select gram, lang, ln(c + 1) as lw from train_counts)"""


def detect_ctes(occ: str, id_col: str) -> str:
    return f"""m as (select o.{id_col}, count(*) as m from {occ} o join vocab v on o.gram = v.gram group by o.{id_col}),
s as (select o.{id_col}, p.lang, sum(p.lw) as s from {occ} o join prof p on o.gram = p.gram group by o.{id_col}, p.lang),
scored as (select s.{id_col}, s.lang, round(s.s - m.m * l.lden, 6) as score
           from s join m on s.{id_col} = m.{id_col} join lden l on s.lang = l.lang),
best as (select {id_col}, lang as detected from (
  select {id_col}, lang, row_number() over (partition by {id_col} order by score desc, lang) as rn from scored) b
  where rn = 1)"""


def _documents(spark, sf_dir):
    return spread(load(spark, sf_dir, "documents").select("doc_id", "text", "lang"))


def _profile(spark, sf_dir, held_out: bool = False):
    """Profile from the labelled documents: all of them, or only the even ids
    when the odd ids are kept back to measure accuracy (``language_accuracy``)."""
    d = _documents(spark, sf_dir)
    return L.fit_language_profile(d.filter(F.col("doc_id") % 2 == 0) if held_out else d)


@register("char_ngrams", with_ctes(grams_cte("documents", "doc_id", "text", ", lang")) + """
select lang, gram, count(*) as n from grams group by lang, gram""")
def char_ngrams(spark, sf_dir):
    return L.gram_counts(_documents(spark, sf_dir), "text", ["lang"])


_DETECT = with_ctes(grams_cte("documents", "doc_id", "text", ", lang"), profile_ctes("true"),
                    detect_ctes("grams", "doc_id"))
_DETECT_HELD_OUT = with_ctes(grams_cte("documents", "doc_id", "text", ", lang"), profile_ctes("doc_id % 2 = 0"),
                             detect_ctes("grams", "doc_id"))


@register("detect_language", _DETECT + """
select d.doc_id, d.lang, b.detected from documents d left join best b on d.doc_id = b.doc_id""")
def detect_language(spark, sf_dir):
    d = _documents(spark, sf_dir)
    return L.detect_language(d, _profile(spark, sf_dir)).select("doc_id", "lang", "detected")


@register("detect_language_shared_ids", _DETECT + """
select d.doc_id % 7 as id, b.detected, count(*) as n from documents d left join best b on d.doc_id = b.doc_id group by all""")
def detect_language_shared_ids(spark, sf_dir):
    """Rows that share an id keep a language each."""
    d = _documents(spark, sf_dir).withColumn("id", F.col("doc_id") % 7).select("id", "text")
    det = L.detect_language(d, _profile(spark, sf_dir))
    return det.groupBy("id", "detected").agg(F.count(F.lit(1)).alias("n"))


@register("language_accuracy", _DETECT_HELD_OUT + """
select d.lang, case when d.doc_id % 2 = 0 then 'train' else 'held_out' end as part, count(*) as n,
  count(*) filter (where b.detected = d.lang) as correct, count(*) filter (where b.detected is null) as undetected
from documents d left join best b on d.doc_id = b.doc_id group by all""")
def language_accuracy(spark, sf_dir):
    """Every document scored by a profile learnt from the even ids; accuracy
    reported for the training part and the held-out (odd) part."""
    d = _documents(spark, sf_dir)
    j = L.detect_language(d, _profile(spark, sf_dir, held_out=True))
    part = F.when(F.col("doc_id") % 2 == 0, F.lit("train")).otherwise(F.lit("held_out"))
    return j.groupBy("lang", part.alias("part")).agg(
        F.count(F.lit(1)).alias("n"),
        F.count(F.when(F.col("detected") == F.col("lang"), 1)).alias("correct"),
        F.count(F.when(F.col("detected").isNull(), 1)).alias("undetected"))


# Entry 1 with a detected language: posts that pass the length test are scored
# by the profile learnt from the labelled documents, then kept if German.
_POSTS_DETECT = with_ctes(
    fx.POSTS_CTE, S.tagged_cte().replace("tagged as", "pre as"),
    grams_cte("(select id, text from pre where reason is null)", "id", "text"),
    grams_cte("documents", "doc_id", "text", ", lang").replace("words as", "dwords as")
    .replace("word_pos as", "dword_pos as").replace("grams as", "dgrams as")
    .replace("from words", "from dwords").replace("from word_pos", "from dword_pos"),
    profile_ctes("true").replace("from grams", "from dgrams"),
    detect_ctes("grams", "id"),
    """tagged as (
  select pre.* exclude (reason, lang), b.detected as lang,
    coalesce(pre.reason, case when b.detected is null then 'undetected'
                              when b.detected <> 'de' then 'other_language' end) as reason
  from pre left join best b on pre.id = b.id)""")


def _posts_detected(spark, sf_dir):
    pre = text_ops.choose_text(fx.posts(spark, sf_dir).drop("lang"))
    tagged = L.with_language(pre, _profile(spark, sf_dir), where=F.col("reason").isNull())
    return text_ops.tag_language(tagged, keep_language="de")


@register("clean_posts_detected", _POSTS_DETECT + S.clean_select())
def clean_posts_detected(spark, sf_dir):
    return text_ops.clean_table(_posts_detected(spark, sf_dir))


@register("language_counts_detected", _POSTS_DETECT + """
select lang, count(*) as n from tagged
where (reason is null or reason not in ('missing', 'too_short')) and lang is not null group by lang""")
def language_counts_detected(spark, sf_dir):
    return text_ops.language_counts(_posts_detected(spark, sf_dir))


@register("reject_counts_detected", _POSTS_DETECT + """
select reason, count(*) as n from tagged where reason is not null group by reason""")
def reject_counts_detected(spark, sf_dir):
    return text_ops.reject_counts(_posts_detected(spark, sf_dir))
