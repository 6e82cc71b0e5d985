"""Text column expressions: missing words, text choice, token counts, cleaning.

All of them are built-in Spark expressions (whole-stage codegen, no Python).
The regular expressions are written so the same pattern text also runs in
DuckDB (RE2), which is what the SQL oracles use.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The words a CSV reader with pandas' default settings turns into
# a missing value (exact, case-sensitive match, no trimming).
NA_WORDS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
    "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a",
    "nan", "null",
]

# The characters Python's str.isspace() / re '\s' accept, written
# as one character class that Java regex and RE2 read the same way.
WS_CLASS = (r"\t\n\x0B\f\r \x1C-\x1F\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}"
            r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}")
URL_PATTERN = "https?://[^" + WS_CLASS + "]+"
STRIP_PATTERN = "^[" + WS_CLASS + "]+|[" + WS_CLASS + "]+$"
BREAKS_PATTERN = r"[\n\t]"
HASHTAG_PATTERN = "#[^" + WS_CLASS + "]+"


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def na_to_null(c) -> Column:
    """NA words become NULL (exact match, as a CSV reader would)."""
    c = _c(c)
    return F.when(c.isin(NA_WORDS), F.lit(None).cast("string")).otherwise(c)


def pick_text(related_text, headline) -> Column:
    """P2+P3: the related text when present, else the headline; lower-cased."""
    return F.lower(F.coalesce(_c(related_text), _c(headline)))


def token_count(c) -> Column:
    """Pieces of a split on single spaces; empty pieces count ('' -> 1).
    Counted as spaces + 1, which is the same number without building the array."""
    c = _c(c)
    return F.length(c) - F.length(F.replace(c, F.lit(" "), F.lit(""))) + F.lit(1)


def strip_breaks(c) -> Column:
    """P5: delete newlines and tabs (the words either side join)."""
    return F.regexp_replace(_c(c), BREAKS_PATTERN, "")


def strip_urls(c) -> Column:
    """Delete http(s) URLs up to the next whitespace character."""
    return F.regexp_replace(_c(c), URL_PATTERN, "")


def strip_ws(c) -> Column:
    """Strip Unicode whitespace (incl. NBSP and \\x1c-\\x1f) at both ends."""
    return F.regexp_replace(_c(c), STRIP_PATTERN, "")


def strip_hashtags(c) -> Column:
    """Delete #hashtags (stated as a to-do in the source; off by default)."""
    return F.regexp_replace(_c(c), HASHTAG_PATTERN, "")


def clean_text(c, hashtags: bool = False) -> Column:
    """P5 -> P6 (-> P8) -> P7 in the source's order."""
    out = strip_urls(strip_breaks(c))
    if hashtags:
        out = strip_hashtags(out)
    return strip_ws(out)


def file_stem(c) -> Column:
    """Everything before the first dot; NULL stays NULL."""
    return F.substring_index(_c(c), ".", 1)


def image_path(img_dir, img_fname) -> Column:
    """Directory joined with file name."""
    return F.concat(_c(img_dir), _c(img_fname))


def letter_words(c) -> Column:
    """Lower-cased text with every run of non-letters replaced by one space."""
    return F.regexp_replace(F.lower(_c(c)), r"[^\p{L}]+", " ")


def word_tokens(c) -> Column:
    """Lower-cased runs of letters or digits (the word tokenizer of E1-E3, E6)."""
    return F.regexp_extract_all(F.lower(_c(c)), F.lit(r"([\p{L}\p{N}]+)"), 1)
