"""Text preparation: text choice, length test, language filter, cleaning,
reject reasons, language counts, missing-value drop, first-copy dedup.

One pass tags every raw row with a ``reason`` (NULL = kept); the clean table,
the corpus, the language counts and the reject counts are all projections of
that tagged frame, so a caller can persist it once and derive the rest.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

# The column names of the raw post file.
POST_COLUMNS = ["id", "headline", "related_text", "original_img_dir", "original_img_filename"]

# Reject reasons, in the order the checks run.
MISSING, TOO_SHORT, UNDETECTED, OTHER_LANGUAGE = "missing", "too_short", "undetected", "other_language"


def na_to_null(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """P1 over the given string columns (all string columns by default)."""
    cols = cols or [f.name for f in df.schema.fields if f.dataType.simpleString() == "string"]
    return df.select(*[T.na_to_null(c).alias(c) if c in cols else F.col(c) for c in df.columns])


def choose_text(posts: DataFrame, min_tokens: int = 5) -> DataFrame:
    """Adds ``text`` (chosen, lower-cased, uncleaned) and ``reason``
    for rows that are missing or too short (NULL otherwise)."""
    df = na_to_null(posts, [c for c in POST_COLUMNS if c in posts.columns])
    text = T.pick_text("related_text", "headline")
    df = df.withColumn("text", text)
    reason = (F.when(F.col("text").isNull(), F.lit(MISSING))
              .when(T.token_count("text") <= min_tokens, F.lit(TOO_SHORT)))
    return df.withColumn("reason", reason)


def min_tokens(df: DataFrame, n: int = 5, text_col: str = "text") -> DataFrame:
    """Rows whose text has more than ``n`` single-space pieces."""
    return df.filter(T.token_count(text_col) > n)


def keep_language(df: DataFrame, lang: str, lang_col: str = "lang") -> DataFrame:
    """Rows of one language."""
    return df.filter(F.col(lang_col) == F.lit(lang))


def tag_language(df: DataFrame, keep_language: str | None = None, lang_col: str = "lang") -> DataFrame:
    """P11 + L5: rows still unrejected get 'undetected' (no language) or
    'other_language' (a language other than ``keep_language``)."""
    lang = F.col(lang_col)
    reason = F.coalesce(F.col("reason"), F.when(lang.isNull(), F.lit(UNDETECTED)))
    if keep_language is not None:
        reason = F.coalesce(reason, F.when(lang != F.lit(keep_language), F.lit(OTHER_LANGUAGE)))
    return df.withColumn("reason", reason)


def tag_posts(posts: DataFrame, keep_language: str | None = None, min_tokens: int = 5,
              lang_col: str = "lang") -> DataFrame:
    """Full tagging with a language column already on the rows."""
    return tag_language(choose_text(posts, min_tokens), keep_language, lang_col)


def clean_table(tagged: DataFrame, hashtags: bool = False) -> DataFrame:
    """P5-P10: kept rows projected to ``uid, text, img_dir, img_fname``."""
    return (tagged.filter(F.col("reason").isNull())
            .select(F.col("id").alias("uid"),
                    T.clean_text("text", hashtags).alias("text"),
                    F.col("original_img_dir").alias("img_dir"),
                    T.file_stem("original_img_filename").alias("img_fname")))


def clean_posts(posts: DataFrame, keep_language: str | None = None, min_tokens: int = 5,
                lang_col: str = "lang") -> DataFrame:
    """Entry 1 as one plan: raw posts -> clean table.

    With a stored language column and ``keep_language``, the language test is
    also applied first as a plain column filter (same kept rows), so it reaches
    the Parquet scan as a pushed filter instead of waiting for the tagging."""
    if keep_language is not None and lang_col in posts.columns:
        posts = posts.filter(F.col(lang_col) == F.lit(keep_language))
    return clean_table(tag_posts(posts, keep_language, min_tokens, lang_col))


def reject_counts(tagged: DataFrame) -> DataFrame:
    """A2: rows per reject reason (``reason``, ``n``)."""
    return (tagged.filter(F.col("reason").isNotNull())
            .groupBy("reason").agg(F.count(F.lit(1)).alias("n")))


def language_counts(tagged: DataFrame, lang_col: str = "lang") -> DataFrame:
    """L4/A1: detected languages of every row that passed the length test,
    counted before any language filter (``lang``, ``n``)."""
    ok = F.col("reason").isNull() | ~F.col("reason").isin(MISSING, TOO_SHORT)
    return (tagged.filter(ok & F.col(lang_col).isNotNull())
            .groupBy(F.col(lang_col).alias("lang")).agg(F.count(F.lit(1)).alias("n")))


def corpus(clean: DataFrame) -> DataFrame:
    """S8 input: one cleaned text per row in a ``value`` column."""
    return clean.select(F.col("text").alias("value"))


def drop_incomplete(df: DataFrame, cols: list[str] | None = None, computed: bool = False) -> DataFrame:
    """Drop rows with a missing value in any (or the given) column; NaN and
    empty strings count as missing, as they would after a CSV round trip.

    ``computed``: the columns are costly expressions. They are then put behind a generator, so that each is
    evaluated once and not again in the filter; without it the filter reaches a scan."""
    if computed:
        df = df.select(F.inline(F.array(F.struct(*[F.col(f"`{c}`") for c in df.columns]))))
    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    cond = F.lit(True)
    for c in cols or df.columns:
        ok = F.col(c).isNotNull()
        if kinds[c] == "string":
            ok = ok & (F.col(c) != F.lit(""))
        elif kinds[c] in ("double", "float"):
            ok = ok & ~F.isnan(c)
        cond = cond & ok
    return df.filter(cond)


def dedup_text(df: DataFrame, text_col: str = "text", order_col: str = "doc_id") -> DataFrame:
    """A4: keep the first row (smallest ``order_col``) of every distinct text;
    ``order_col`` tells rows with equal texts apart.

    The aggregate holds fixed-width values only (three hashes of the text, 160 bits
    together, and the smallest order value), so it is a hash aggregate that collapses a
    text copied into a third of all rows before the shuffle; the rows are then
    picked by a semi join on it."""
    hashes = {"_h0": F.xxhash64(text_col), "_h1": F.xxhash64(F.lit(1), F.col(text_col)),
              "_h2": F.coalesce(F.crc32(F.encode(F.col(text_col), "utf-8")), F.lit(-1))}
    keyed = df.withColumns(hashes)
    first = keyed.groupBy(*hashes).agg(F.min(order_col).alias(order_col))
    return keyed.join(first, [*hashes, order_col], "left_semi").select(*df.columns)
