"""Text-preparation queries (P1-P13, A2, A4, L4 with the table's language)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import WS_CLASS
from ..operators import text as ops
from . import fixtures as fx
from . import sqlbits as S
from .registry import register, with_ctes

_TAGGED = with_ctes(fx.POSTS_CTE, S.tagged_cte())
_TAGGED_DE = with_ctes(fx.POSTS_CTE, S.tagged_cte("de"))


@register("clean_posts", _TAGGED + S.clean_select())
def clean_posts(spark, sf_dir):
    return ops.clean_posts(fx.posts(spark, sf_dir))


@register("clean_posts_one_language", _TAGGED_DE + S.clean_select())
def clean_posts_one_language(spark, sf_dir):
    return ops.clean_posts(fx.posts(spark, sf_dir), keep_language="de")


@register("reject_counts", _TAGGED_DE + """
select reason, count(*) as n from tagged where reason is not null group by reason""")
def reject_counts(spark, sf_dir):
    return ops.reject_counts(ops.tag_posts(fx.posts(spark, sf_dir), keep_language="de"))


@register("language_counts", _TAGGED + """
select lang, count(*) as n from tagged
where (reason is null or reason not in ('missing', 'too_short')) and lang is not null
group by lang""")
def language_counts(spark, sf_dir):
    return ops.language_counts(ops.tag_posts(fx.posts(spark, sf_dir)))


@register("language_counts_json", _TAGGED + """
select '{' || string_agg('"' || lang || '":' || cast(n as varchar), ',' order by lang) || '}' as value from (
  select lang, count(*) as n from tagged where (reason is null or reason not in ('missing', 'too_short')) and lang is not null group by lang) c""")
def language_counts_json(spark, sf_dir):
    """The counts as the one JSON object that is written."""
    from ..sources.writers import counts_json
    return counts_json(ops.language_counts(ops.tag_posts(fx.posts(spark, sf_dir))))


@register("corpus_lines", _TAGGED + f"""
select {S.clean('text')} as value from tagged where reason is null""")
def corpus_lines(spark, sf_dir):
    return ops.corpus(ops.clean_posts(fx.posts(spark, sf_dir)))


@register("corpus_without_hashtags", _TAGGED + f"""
select regexp_replace({S.clean("text || ' #tag' || id || ' end'")}, '#[^{WS_CLASS}]+', '', 'g') as value from tagged where reason is null""")
def corpus_without_hashtags(spark, sf_dir):
    """P8 on: every post has a hashtag before its last word."""
    tagged = ops.tag_posts(fx.posts(spark, sf_dir))
    tagged = tagged.withColumn("text", F.concat("text", F.lit(" #tag"), "id", F.lit(" end")))
    return ops.corpus(ops.clean_table(tagged, hashtags=True))


@register("drop_incomplete", _TAGGED + f"""
select * from ({S.clean_select()}) c
where uid is not null and uid <> '' and text is not null and text <> '' and img_dir is not null
  and img_dir <> '' and img_fname is not null and img_fname <> ''""")
def drop_incomplete(spark, sf_dir):
    return ops.drop_incomplete(ops.clean_posts(fx.posts(spark, sf_dir)), computed=True)


@register("dedup_text", """
select doc_id, lang, source from (
  select doc_id, lang, source, row_number() over (partition by text order by doc_id) as rn from documents) d
where rn = 1""")
def dedup_text(spark, sf_dir):
    from ..session import load
    docs = load(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    return ops.dedup_text(docs).select("doc_id", "lang", "source")


@register("file_stems", with_ctes(fx.POSTS_CTE) + """
select id, original_img_filename, split_part(original_img_filename, '.', 1) as img_fname,
  original_img_dir || split_part(original_img_filename, '.', 1) as img_fpath from posts""")
def file_stems(spark, sf_dir):
    from ..functions import text as T
    p = fx.posts(spark, sf_dir)
    stem = T.file_stem("original_img_filename")
    return p.select("id", "original_img_filename", stem.alias("img_fname"),
                    T.image_path(F.col("original_img_dir"), stem).alias("img_fpath"))
