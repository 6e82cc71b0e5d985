"""SQL fragments shared by the oracle queries (DuckDB dialect, ANSI where possible)."""

from __future__ import annotations

from ..functions.text import BREAKS_PATTERN, NA_WORDS, STRIP_PATTERN, URL_PATTERN


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


NA_LIST = ", ".join(lit(w) for w in NA_WORDS)


def na(c: str) -> str:
    return f"case when {c} in ({NA_LIST}) then null else {c} end"


def clean(c: str) -> str:
    x = f"regexp_replace({c}, {lit(BREAKS_PATTERN)}, '', 'g')"
    x = f"regexp_replace({x}, {lit(URL_PATTERN)}, '', 'g')"
    return f"regexp_replace({x}, {lit(STRIP_PATTERN)}, '', 'g')"


def tagged_cte(keep_language: str | None = None, lang_source: str = "lang") -> str:
    keep = ""
    if keep_language is not None:
        keep = f" when {lang_source} <> {lit(keep_language)} then 'other_language'"
    return f"""p1 as (
  select {na('id')} as id, lang, {na('headline')} as headline, {na('related_text')} as related_text,
    {na('original_img_dir')} as original_img_dir, {na('original_img_filename')} as original_img_filename
  from posts),
chosen as (select *, lower(coalesce(related_text, headline)) as text from p1),
tagged as (
  select *, case when text is null then 'missing'
                 when len(string_split(text, ' ')) <= 5 then 'too_short'
                 when {lang_source} is null then 'undetected'{keep} end as reason
  from chosen)"""


def clean_select(src: str = "tagged") -> str:
    return f"""select id as uid, {clean('text')} as text, original_img_dir as img_dir,
  split_part(original_img_filename, '.', 1) as img_fname
from {src} where reason is null"""
