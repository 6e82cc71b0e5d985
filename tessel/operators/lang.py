"""Language identification as Spark jobs.

Model: naive Bayes over character 3-grams of space-padded letter words, with
add-one smoothing. For language ``l`` with ``c_lg`` training occurrences of
gram ``g``, ``n_l`` gram occurrences in all and ``V`` distinct training grams::

    score(doc, l) = sum over the doc's gram occurrences g that are in the vocabulary
                    of  ln(c_lg + 1) - ln(n_l + V)
                  = S_l - M * ln(n_l + V)

where ``S_l`` only needs the grams seen in ``l`` and ``M`` is the number of the
doc's in-vocabulary occurrences. Candidate languages are
those sharing at least one gram with the document; the highest score rounded
to 6 places wins, ties to the smaller language code. A document with no
in-vocabulary gram (e.g. no letters) gets no language (L5).

Plan: grams are produced per document by one linear regex pass (no per-position
substring, whole texts). The profile is long (gram, language, weight). While its
counted size allows, it is broadcast and a document is scored inside its row:
an Arrow batch looks every distinct gram up once and sums the weight rows, so
there is no explode, no join and no shuffle. A larger profile is joined by
shuffle: grams are counted per row first, and rows are salted by their own id so a
gram that occurs in a third of all documents is spread over many tasks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import URL_PATTERN
from ..session import checkpoint


# Cells (grams x languages) of the profile that may be broadcast: 8 bytes each,
# so the bound keeps the broadcast under ~80 MB.
BROADCAST_PROFILE_CELLS = 10_000_000
BATCH_BYTES = 4 << 20   # bytes of texts in an Arrow batch
SLICE_BYTES = 1 << 20   # bytes of texts whose grams are held at once
ROWS_PER_SALT = 1_000_000  # grams of one kind that one task of the salted join meets, about

GRAM_PATTERN = r"(?=(.\p{L}.))"


def gram_text(c) -> F.Column:
    """Lower-cased text, URLs removed, every run of non-letters one space, padded."""
    t = F.regexp_replace(F.lower(c), URL_PATTERN, " ")
    t = F.regexp_replace(t, r"[^\p{L}]+", " ")
    return F.concat(F.lit(" "), t, F.lit(" "))


def gram_array(c) -> F.Column:
    """All overlapping 3-character windows whose middle is a letter = the
    3-grams of every space-padded word (a word of m letters gives m grams)."""
    return F.regexp_extract_all(gram_text(c), F.lit(GRAM_PATTERN), 1)


def char_ngrams(df: DataFrame, id_col: str, text_col: str, keep: list[str] | None = None) -> DataFrame:
    """L1: one row per gram occurrence: ``id_col, *keep, gram``."""
    keep = keep or []
    return df.select(F.col(id_col), *[F.col(k) for k in keep],
                     F.explode(gram_array(F.col(text_col))).alias("gram"))


def gram_counts(df: DataFrame, text_col: str, by: list[str]) -> DataFrame:
    """L1 aggregated: ``by..., gram, n`` (partial aggregation before the shuffle)."""
    g = df.select(*[F.col(b) for b in by], F.explode(gram_array(F.col(text_col))).alias("gram"))
    return g.groupBy(*by, "gram").agg(F.count(F.lit(1)).alias("n"))


@dataclass
class LanguageProfile:
    grams: DataFrame   # gram, lang, w: ln(c_lg + 1) for every seen pair
    langs: DataFrame   # lang, lden: ln(n_l + V)
    rows: int          # distinct grams V (checked before any broadcast)
    n_langs: int


def fit_language_profile(train: DataFrame, text_col: str = "text", lang_col: str = "lang",
                         min_count: int = 1) -> LanguageProfile:
    """L2: learn the profile from labelled rows (whole texts), for any number of languages.

    One count per (gram, language), partially aggregated before its shuffle and
    checkpointed once. ``min_count`` > 1 keeps only grams seen at least that often
    in all (a model choice, as published detector profiles drop rare grams); the
    default keeps all.
    """
    counts = gram_counts(train.filter(F.col(lang_col).isNotNull()).withColumn("lang", F.col(lang_col)), text_col, ["lang"])
    if min_count > 1:
        often = counts.groupBy("gram").agg(F.sum("n").alias("_t")).filter(F.col("_t") >= min_count).select("gram")
        counts = counts.join(often, "gram")
    counts = checkpoint(counts)
    n_vocab = counts.select("gram").distinct().count()  # V
    if not n_vocab:
        raise ValueError("fit_language_profile: no labelled rows with letters")
    langs = checkpoint(counts.groupBy("lang").agg(F.log(F.sum("n") + F.lit(n_vocab)).alias("lden")))
    grams = counts.select("gram", "lang", F.log(F.col("n") + F.lit(1.0)).alias("w"))
    return LanguageProfile(grams, langs, n_vocab, langs.count())


def _slices(column: pa.Array) -> Iterator[pa.Array]:
    """Runs of rows of about ``SLICE_BYTES``; a longer text is alone or ends its run."""
    size = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
    run = (np.cumsum(size, dtype=np.int64) - size) // SLICE_BYTES
    cut = np.concatenate([[0], np.flatnonzero(np.diff(run)) + 1, [len(column)]])
    for a, e in zip(cut[:-1].tolist(), cut[1:].tolist()):
        yield column[a:e]


def gram_keys(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The grams of ``gram_text`` rows as numbers (21 bits a character: no two share one), and the row of each."""
    texts = ["" if t is None else t for t in column.to_pylist()]
    char = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
    at = np.flatnonzero(char != 32)  # letters; each text begins and ends with a space, so no window leaves its text
    key = (char[at - 1].astype(np.int64) << 42) | (char[at].astype(np.int64) << 21) | char[at + 1]
    end = np.cumsum([len(t) for t in texts], dtype=np.int64)
    return key, np.searchsorted(end, at, "right")


def _gram_key(gram) -> F.Column:
    """The number ``gram_keys`` gives a gram."""
    a, b, c = (F.ascii(F.substring(gram, i, 1)).cast("long") for i in (1, 2, 3))  # code points
    return F.shiftleft(a, 42).bitwiseOR(F.shiftleft(b, 21)).bitwiseOR(c)


def _detect_in_row(df: DataFrame, profile: LanguageProfile, text_col: str, out_col: str) -> DataFrame:
    """Score inside the row with the broadcast profile. Texts travel in batches bounded by bytes, and a slice of one at a time is
    taken apart, so a worker's memory does not follow the number or the length of a batch's texts."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    langs = profile.langs.orderBy("lang").toPandas()  # size checked: V x languages <= BROADCAST_PROFILE_CELLS
    names = langs["lang"].to_numpy(object)
    # the driver holds numbers of grams and of languages, no strings of the profile
    place = F.array_position(F.array(*[F.lit(n) for n in names]), F.col("lang"))
    pairs = profile.grams.select(_gram_key("gram").alias("h"), place.cast("int").alias("l"), "w").toPandas()
    grams, row = np.unique(pairs["h"].to_numpy(np.int64), return_inverse=True)
    weight = np.zeros((len(grams) + 1, len(names)))  # the last row: grams outside the vocabulary
    weight[row, pairs["l"].to_numpy() - 1] = pairs["w"]
    shipped = df.sparkSession.sparkContext.broadcast((grams, weight, langs["lden"].to_numpy(), names))

    def best_of(column: pa.Array) -> np.ndarray:
        grams, weight, lden, names = shipped.value
        out = np.full(len(column), None, object)
        seen, doc = gram_keys(column)
        if not len(seen):
            return out
        known = np.searchsorted(grams, seen)
        known[known == len(grams)] = 0
        known = np.where(grams[known] == seen, known, len(grams))
        has, doc = np.unique(doc, return_inverse=True)
        step = max(1, (1 << 20) // max(1, len(names)))  # occurrences whose weight rows are held at once
        score = np.zeros((len(has), len(names)))
        m = np.bincount(doc, known < len(grams), len(has)).astype(np.int64)
        for a in range(0, len(known), step):
            d = doc[a:a + step]
            first = np.flatnonzero(np.append(True, d[1:] != d[:-1]))
            score[d[first]] += np.add.reduceat(weight[known[a:a + step]], first, axis=0)
        key = np.where(score > 0, np.round(score - m[:, None] * lden[None, :], 6), -np.inf)
        best = key.argmax(axis=1)  # names are sorted: the smaller code wins ties
        ok = m > 0
        out[has[ok]] = names[best[ok]]
        return out

    @F.arrow_udf("string")
    def detected(column: pa.Array) -> pa.Array:
        return pa.array(np.concatenate([np.empty(0, object), *map(best_of, _slices(column))]), pa.string())

    # a filter on the language must not score the texts once more below itself
    return df.withColumn(out_col, detected.asNondeterministic()(gram_text(F.col(text_col))))


def _detect_by_join(df: DataFrame, profile: LanguageProfile, text_col: str, out_col: str) -> DataFrame:
    """The same by shuffle: per-row gram counts joined with the long profile."""
    rows = checkpoint(df.withColumn("_rid", F.monotonically_increasing_id()))
    counts = (rows.select("_rid", F.explode(gram_array(F.col(text_col))).alias("gram"))
              .groupBy("_rid", "gram").agg(F.count(F.lit(1)).alias("n")))
    # the hottest gram stands in at most every row: so many salts share it
    salts = max(1, -(-rows.count() // ROWS_PER_SALT))
    salted = counts.withColumn("_salt", F.pmod(F.xxhash64("_rid"), F.lit(salts)))
    prof = (profile.grams.groupBy("gram").agg(F.collect_list(F.struct("lang", "w")).alias("lw"))
            .withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)).cast("array<long>"))))
    hits = salted.join(prof, ["gram", "_salt"]).select("_rid", "n", "lw")
    m = hits.groupBy("_rid").agg(F.sum("n").alias("m"))
    s = (hits.select("_rid", "n", F.explode("lw").alias("x")).groupBy("_rid", F.col("x.lang").alias("lang"))
         .agg(F.sum(F.col("n") * F.col("x.w")).alias("s")).filter("s > 0"))
    scored = s.join(m, "_rid").join(profile.langs, "lang")
    key = F.struct((-F.round(F.col("s") - F.col("m") * F.col("lden"), 6)).alias("k"), F.col("lang").alias("lang"))
    best = scored.groupBy("_rid").agg(F.min(key)["lang"].alias(out_col))
    return rows.drop(out_col).join(best, "_rid", "left").drop("_rid")


def detect_language(df: DataFrame, profile: LanguageProfile, text_col: str = "text", out_col: str = "detected") -> DataFrame:
    """L3: every row of ``df`` with its language in ``out_col``; null where no gram
    is in the vocabulary (undetectable, L5). Rows are scored one by one, so rows that
    share an id keep a language each."""
    cells = profile.rows * profile.n_langs
    detect = _detect_in_row if cells <= BROADCAST_PROFILE_CELLS else _detect_by_join
    return detect(df, profile, text_col, out_col)


def with_language(df: DataFrame, profile: LanguageProfile, text_col: str = "text", out_col: str = "lang", where=None) -> DataFrame:
    """Attach the detected language to rows (only rows meeting ``where`` are scored)."""
    if where is None:
        return detect_language(df, profile, text_col, out_col)
    scored = detect_language(df.withColumn("_scored", F.when(where, F.col(text_col))), profile, "_scored", out_col)
    return scored.drop("_scored")


def save_profile(profile: LanguageProfile, path: str, mode: str = "overwrite") -> None:
    """Write a profile: gram weights and language denominators as Parquet, so it
    can be trained once and reused."""
    profile.grams.write.mode(mode).parquet(f"{path}/grams")
    profile.langs.write.mode(mode).parquet(f"{path}/langs")


def load_profile(spark, path: str) -> LanguageProfile:
    grams, langs = spark.read.parquet(f"{path}/grams"), spark.read.parquet(f"{path}/langs")
    return LanguageProfile(grams, langs, grams.select("gram").distinct().count(), langs.count())
