"""Language identification: gram extraction equals per-word padding; held-out accuracy."""

from pyspark.sql import functions as F

from tessel.operators import lang as L
from tessel.session import load

from conftest import SF_SMALL


def py_grams(text):
    import regex
    t = regex.sub(r"https?://[^\s\x1c-\x1f]+", " ", text.lower())
    words = [w for w in regex.split(r"[^\p{L}]+", t) if w]
    return sorted(g for w in words for g in (f" {w} "[i:i + 3] for i in range(len(w))))


def test_gram_array_matches_word_padding(spark):
    texts = ["Le chat, noir!", "über Straße 42 x", "a", "   ", "https://ex.org/a b", "ÉTÉ été"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [sorted(r[0]) for r in df.select(L.gram_array(F.col("t"))).collect()]
    assert got == [py_grams(t) for t in texts]


def test_detect_on_held_out_documents(spark):
    d = load(spark, SF_SMALL, "documents").select("doc_id", "text", "lang")
    prof = L.fit_language_profile(d.filter(F.col("doc_id") % 2 == 0))
    held = d.filter(F.col("doc_id") % 2 == 1)
    j = L.detect_language(held, prof)
    total = j.count()
    right = j.filter(F.col("detected") == F.col("lang")).count()
    assert total > 0 and right / total > 0.9


def test_undetectable_rows_have_no_language(spark):
    d = load(spark, SF_SMALL, "documents").select("doc_id", "text", "lang")
    prof = L.fit_language_profile(d)
    odd = spark.createDataFrame([(1, "12345 !!! ???"), (2, "")], "doc_id long, text string")
    assert [r.detected for r in L.detect_language(odd, prof).collect()] == [None, None]


def test_rows_sharing_an_id_are_detected_separately(spark):
    d = load(spark, SF_SMALL, "documents").select("doc_id", "text", "lang")
    prof = L.fit_language_profile(d)
    de = d.filter(F.col("lang") == "de").select("text").first()[0]
    en = d.filter(F.col("lang") == "en").select("text").first()[0]
    rows = spark.createDataFrame([("x", de), ("x", en), ("x", en)], "id string, text string")
    got = sorted(r.lang for r in L.with_language(rows, prof).collect())
    assert got == ["de", "en", "en"]


def test_profile_round_trip(spark):
    import tempfile
    d = load(spark, SF_SMALL, "documents").select("doc_id", "text", "lang")
    prof = L.fit_language_profile(d)
    path = tempfile.mkdtemp(prefix="tessel-prof-", dir="/tmp") + "/p"
    L.save_profile(prof, path)
    back = L.load_profile(spark, path)
    assert sorted(back.langs.collect()) == sorted(prof.langs.collect()) and (back.rows, back.n_langs) == (prof.rows, prof.n_langs)
    a = {r.doc_id: r.detected for r in L.detect_language(d, prof).collect()}
    b = {r.doc_id: r.detected for r in L.detect_language(d, back).collect()}
    assert a == b


def test_min_count_prunes_rare_grams(spark):
    d = load(spark, SF_SMALL, "documents").select("doc_id", "text", "lang")
    full = L.fit_language_profile(d)
    pruned = L.fit_language_profile(d, min_count=5)
    assert pruned.rows < full.rows and pruned.n_langs == full.n_langs
    assert pruned.grams.filter("w <= 0").count() == 0


def test_more_than_500_languages(spark):
    texts = [(f"l{i:03d}", " ".join(chr(0x4e00 + 3 * i + j) * 3 for j in range(3))) for i in range(600)]
    df = spark.createDataFrame(texts, "lang string, text string").repartition(8)
    got = L.detect_language(df, L.fit_language_profile(df)).collect()
    assert len(got) == 600 and all(r.detected == r.lang for r in got)


def test_profile_needs_labels(spark):
    import pytest
    empty = spark.createDataFrame([("some text here", None)], "text string, lang string")
    with pytest.raises(ValueError):
        L.fit_language_profile(empty)


def test_gram_keys_are_the_grams_of_the_pattern(spark):
    """Windows cut from the text in Python are the grams that Spark's pattern finds; a batch is taken apart by bytes."""
    import pyarrow as pa
    from pyspark.sql import functions as F
    texts = ["Guten Tag, \u00c4rger!", None, "", "a", "x1y https://ex.org/abc \u4e2d\u6587 \u00e9t\u00e9", "12 34"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    rows = df.select("i", L.gram_text(F.col("t")).alias("t"), F.transform(L.gram_array(F.col("t")), L._gram_key).alias("k")).orderBy("i").collect()
    key, doc = L.gram_keys(pa.array([r.t for r in rows], pa.string()))
    for r in rows:
        assert key[doc == r.i].tolist() == (r.k or [])
    sizes = [len(s) for s in L._slices(pa.array(["x" * (L.SLICE_BYTES // 4)] * 10 + [None, ""]))]
    assert sum(sizes) == 12 and max(sizes) <= 6 and len(sizes) > 1


def test_filter_on_language_scores_texts_once(spark, tmp_path):
    from tessel.plans import q_lang
    docs = [(i, "der die das und " * 9 if i % 2 else "the and of to in " * 9, "de" if i % 2 else "en", "web") for i in range(40)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    for query in (q_lang.language_counts_detected, q_lang.reject_counts_detected):
        plan = query(spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
        assert plan.count("ArrowEvalPython") == 1
