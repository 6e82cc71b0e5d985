"""Secret scan with DataFrame expressions only.

Base kinds are pattern matches. The entropy kinds look at candidate strings
(long runs of key characters): a window slides over each one, the counts of the
window's characters are kept up to date by one character entering and one
leaving, and with them the sum of c * log2(c) that gives the Shannon entropy.
Windows at or above the limit of the candidate's character class (hexadecimal or
mixed) make the span; candidates on the allow-list are passed over.

Positions of matches come from splitting a text at a pattern: piece and match
lengths add up to the start of every match. Texts without a match of a pattern
skip its work.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import boxed, unboxed

# The base patterns with their shortest lengths.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_MIN = 6
ACCESS = r"AKIA[A-Z0-9]{16,}"  # AKIA[A-Z0-9]+ of 20 or more characters
HEX = r"[0-9a-f]{24,}"         # [0-9a-f]+ of 24 or more characters
KINDS = ("assign", "access", "hex", "entropy_hex", "entropy_mixed")

CANDIDATE = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}"
WINDOW = 20
HEX_ALPHABET = "0123456789abcdefABCDEF"
MIXED_ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-"
HEX_BITS, MIXED_BITS = 3.0, 3.6
#: Candidates that are no secrets: words, numbers, identifiers in the usual dashed form, paths and slugs of words, documentation samples.
ALLOWED = (r"^[A-Za-z+/_-]+$", r"^[0-9+/_-]+$",
           r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$",
           r"^([A-Za-z]+|[0-9]{1,4})([/_-]+([A-Za-z]+|[0-9]{1,4}))+$", r"(?i)(example|sample|dummy|placeholder)")

_NONE = "array<struct<start:int,kind:int,end:int>>"


def _empty() -> Column:
    return F.array().cast(_NONE)


def _span(start, kind: int, end) -> Column:
    return F.struct(start.cast("int").alias("start"), F.lit(kind).alias("kind"), end.cast("int").alias("end"))


def matches(text: Column, pattern: str, group: int = 0) -> Column:
    """``array<struct<start, end, piece>>`` of the leftmost non-overlapping matches;
    ``piece`` is the match's group. Positions are code points from 0."""
    lit = F.lit(pattern)
    gaps = F.transform(F.split(text, pattern, -1), F.length)
    whole = F.regexp_extract_all(text, lit, F.lit(0))
    piece = F.regexp_extract_all(text, lit, F.lit(group)) if group else whole
    steps = F.zip_with(F.slice(gaps, 1, F.size(whole)), F.arrays_zip(whole.alias("w"), piece.alias("p")),
                       lambda g, x: F.struct(g.alias("gap"), F.length(x["w"]).alias("len"), x["p"].alias("piece")))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int,piece:string>>").alias("out"))

    def step(acc, x):
        at = acc["at"] + x["gap"]
        own = F.struct(at.alias("start"), (at + x["len"]).alias("end"), x["piece"].alias("piece"))
        return F.struct((at + x["len"]).alias("at"), F.concat(acc["out"], F.array(own)).alias("out"))

    return F.aggregate(steps, start, step, lambda acc: acc["out"])


def entropy_spans(piece: Column, alphabet: str, bits: float, window: int = WINDOW) -> Column:
    """``array<struct<from, to>>`` (from 0): merged windows of ``piece`` whose entropy is ``bits`` or more."""
    chars = F.transform(F.split(piece, ""), lambda c: F.instr(F.lit(alphabet), c))
    # c * log2(c) for c = 0..window, and the largest sum a window may have
    table = F.array(F.lit(0.0), F.lit(0.0), *[F.lit(float(c)) * F.log2(F.lit(float(c))) for c in range(2, window + 1)])
    limit = F.lit(float(window)) * (F.log2(F.lit(float(window))) - F.lit(bits)) + F.lit(1e-9)
    steps = F.transform(chars, lambda c, i: F.struct(
        c.alias("new"), F.when(i >= window, F.element_at(chars, (i - window + 1).cast("int"))).otherwise(0).alias("old"), i.alias("i")))
    start = F.struct(F.array_repeat(F.lit(0), len(alphabet)).alias("counts"), F.lit(0.0).alias("sum"),
                     F.array().cast("array<struct<from:int,to:int>>").alias("out"))

    def gain(count, by):
        """Change of the sum when a count of ``count`` changes by ``by``."""
        return F.element_at(table, count + by + 1) - F.element_at(table, count + 1)

    def step(acc, x):
        kept = F.when(x["old"] > 0, F.transform(acc["counts"], lambda c, k: F.when(k + 1 == x["old"], c - 1).otherwise(c))).otherwise(acc["counts"])
        less = F.when(x["old"] > 0, gain(F.element_at(acc["counts"], F.greatest(x["old"], F.lit(1))), -1)).otherwise(0.0)
        total = acc["sum"] + less + gain(F.element_at(kept, x["new"]), 1)
        counts = F.transform(kept, lambda c, k: F.when(k + 1 == x["new"], c + 1).otherwise(c))
        lo, hi = x["i"] - window + 1, x["i"] + 1
        n = F.size(acc["out"])
        last = F.element_at(acc["out"], F.greatest(n, F.lit(1)))
        joins = (n > 0) & (lo <= F.when(n > 0, last["to"]).otherwise(-1))
        own = F.struct(lo.alias("from"), hi.alias("to"))
        out = (F.when((x["i"] < window - 1) | (total > limit), acc["out"])
               .when(joins, F.concat(F.slice(acc["out"], 1, F.greatest(n - 1, F.lit(0))),
                                     F.array(F.struct(F.when(n > 0, last["from"]).alias("from"), hi.alias("to")))))
               .otherwise(F.concat(acc["out"], F.array(own))))
        return F.struct(counts.alias("counts"), total.alias("sum"), out.alias("out"))

    return F.aggregate(steps, start, step, lambda acc: acc["out"])


def scan(docs: DataFrame, allowed: Sequence[str] = ALLOWED, text_col: str = "text") -> DataFrame:
    """``row, text, base, every`` of every row: the row itself, its text, and sorted
    ``array<struct<start, kind, end>>`` of the base spans and of all spans (``kind`` numbers ``KINDS``).

    Whole texts; a null text counts as empty and has no span. Positions are code
    points, the end is exclusive. Repeated rows are scanned each.
    """
    rows = boxed(docs, text=F.coalesce(F.col(text_col), F.lit("")))
    text = F.col("text")

    def found(pattern: str, group: int = 0) -> Column:
        none = F.array().cast("array<struct<start:int,end:int,piece:string>>")
        return F.when(text.rlike(pattern), matches(text, pattern, group)).otherwise(none)

    def flat(col: Column, kind: int) -> Column:
        return F.transform(col, lambda m: _span(m["start"], kind, m["end"]))

    def is_allowed(piece: Column) -> Column:
        out = F.lit(False)
        for pattern in allowed:
            out = out | piece.rlike(pattern)
        return out

    def spans_of(m: Column, kind: int, alphabet: str, bits: float) -> Column:
        return F.transform(entropy_spans(m["piece"], alphabet, bits),
                           lambda s: _span(m["start"] + s["from"], kind, m["start"] + s["to"]))

    assign = flat(F.filter(found(ASSIGN, 2), lambda m: F.length(m["piece"]) >= ASSIGN_MIN), 0)
    entropy = F.flatten(F.transform(
        F.filter(found(CANDIDATE), lambda m: ~is_allowed(m["piece"])),
        lambda m: F.when(m["piece"].rlike("^[0-9a-fA-F]+$"), spans_of(m, 3, HEX_ALPHABET, HEX_BITS))
        .otherwise(spans_of(m, 4, MIXED_ALPHABET, MIXED_BITS))))
    return (rows.withColumn("base", F.array_sort(F.concat(assign, flat(found(ACCESS), 1), flat(found(HEX), 2))))
            .withColumn("entropy", entropy)
            .withColumn("every", F.when(F.size("entropy") > 0, F.array_sort(F.concat("base", "entropy"))).otherwise(F.col("base")))
            .drop("entropy"))


def _listed(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def secret_spans(docs: DataFrame, allowed: Sequence[str] = ALLOWED, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_assign, n_access, n_hex, base_sha256, spans`` of every row (see ``scan``).

    A null text is empty and has no span; repeated rows and null ids have a row each; an empty table gives none; a very
    long text is scanned whole, in its row."""
    rows = scan(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), allowed)

    def number(kind: int) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")

    return rows.select("row.doc_id", number(0).alias("n_assign"), number(1).alias("n_access"), number(2).alias("n_hex"),
                       F.sha2(_listed(F.col("base")), 256).alias("base_sha256"), _listed(F.col("every")).alias("spans"))


def redact(docs: DataFrame, mark: str = "[SECRET]", allowed: Sequence[str] = ALLOWED, text_col: str = "text") -> DataFrame:
    """``docs`` with every found span (overlapping ones as one) replaced by ``mark``;
    columns as before. Texts without a span, null ones included, stay as they are."""
    rows = scan(docs, allowed, text_col)
    text = F.col("text")
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc, s):
        # spans come by start: the text up to the span, then the mark, unless the span starts in what is gone already
        gap = F.greatest(s["start"] - acc["at"], F.lit(0))
        out = F.concat(acc["out"], F.substring(text, acc["at"] + 1, gap), F.when(s["start"] < acc["at"], F.lit("")).otherwise(F.lit(mark)))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), out.alias("out"))

    clean = F.aggregate("every", start, step, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))))
    return unboxed(rows, docs.columns, **{text_col: F.when(F.size("every") > 0, clean).otherwise(F.col(f"row.`{text_col}`"))})
