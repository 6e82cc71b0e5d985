"""Text functions and text preparation: edge rows from FIXTURES.md §3."""

import re

from pyspark.sql import functions as F

from tessel.functions import text as T
from tessel.operators import text as ops


def one(spark, expr, value):
    return spark.createDataFrame([(value,)], "v string").select(expr(F.col("v")).alias("r")).first()["r"]


def test_space_tokens(spark):
    assert one(spark, T.token_count, "  a b ") == 5
    assert one(spark, T.token_count, "") == 1
    for s in ["a b c d e f", "a  b", " x ", "tab\there x", "a b c d e"]:
        assert one(spark, T.token_count, s) == len(s.split(" "))


def test_break_and_url_removal(spark):
    assert one(spark, T.clean_text, "see http://x.y/z\nfoo bar") == "see  bar"
    assert one(spark, T.clean_text, "http s https://\tend") == "http s"


def test_strip_unicode_whitespace(spark):
    for s in [" abc ", "\x1cabc\x1c", "\rabc\r", "\u00a0abc\u00a0", "\u3000abc\u2028", "\x0babc\x0c", "a b"]:
        assert one(spark, T.strip_ws, s) == s.strip()


def test_url_stops_at_python_whitespace(spark):
    py = re.compile(r"http[s]?://\S+")
    for s in ["https://q\x1cz", "https://q\u00a0z", "https://q z", "go https://a.b/c?d=1 now", "http://x\x0by"]:
        assert one(spark, T.strip_urls, s) == py.sub("", s)


def test_file_stem(spark):
    df = spark.createDataFrame([("a.b.jpg",), ("ab",), (".jpg",), (None,)], "f string")
    assert [r[0] for r in df.select(T.file_stem("f")).collect()] == ["a", "ab", "", None]


def test_text_choice_and_reasons(spark):
    rows = [("1", "head line here one two three", "related text is long enough ok yes", None, None, "de"),
            ("2", "only headline words are six here", None, None, None, "de"),
            ("3", None, "only related text words six here", None, None, "de"),
            ("4", None, None, None, None, "de"),
            ("5", "NA", "short", None, None, "de"),
            ("6", "x", "a b c d e f g", None, None, "en")]
    df = spark.createDataFrame(rows, "id string, headline string, related_text string, "
                                     "original_img_dir string, original_img_filename string, lang string")
    tagged = ops.tag_posts(df, keep_language="de")
    got = {r["id"]: (r["text"], r["reason"]) for r in tagged.collect()}
    assert got["1"] == ("related text is long enough ok yes", None)
    assert got["2"] == ("only headline words are six here", None)
    assert got["3"][1] is None
    assert got["4"] == (None, "missing")
    assert got["5"] == ("short", "too_short")
    assert got["6"][1] == "other_language"
    counts = {r["reason"]: r["n"] for r in ops.reject_counts(tagged).collect()}
    assert counts == {"missing": 1, "too_short": 1, "other_language": 1}
    # counts in = clean + sum of rejects
    assert ops.clean_table(tagged).count() + sum(counts.values()) == len(rows)


def test_na_words_exact(spark):
    df = spark.createDataFrame([("NA",), ("nan",), ("None",), (" null ",), ("",), ("ok",)], "v string")
    out = [r[0] for r in df.select(T.na_to_null("v")).collect()]
    assert out == [None, None, None, " null ", None, "ok"]


def test_dedup_keeps_first_and_is_partition_invariant(spark):
    rows = [(i, f"t{i % 7}") for i in range(200)] + [(1000, None), (1001, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    expect = {}
    for i, t in sorted(rows):
        expect.setdefault(t, i)
    for n in (1, 4, 16):
        got = {r["text"]: r["doc_id"] for r in ops.dedup_text(df.repartition(n)).collect()}
        assert got == expect


def test_drop_incomplete_treats_empty_as_missing(spark):
    df = spark.createDataFrame([("a", "x"), ("b", ""), ("c", None)], "uid string, text string")
    assert [r.uid for r in ops.drop_incomplete(df).collect()] == ["a"]
    num = spark.createDataFrame([("a", 1.0), ("b", float("nan")), ("c", None)], "uid string, x double")
    assert [r.uid for r in ops.drop_incomplete(num).collect()] == ["a"]


def test_hashtags_only_when_asked(spark):
    assert one(spark, T.clean_text, "a #tag b") == "a #tag b"
    assert one(spark, lambda c: T.clean_text(c, hashtags=True), "a #tag b #x") == "a  b"


def test_min_tokens_and_keep_language(spark):
    df = spark.createDataFrame([("a b c d e f", "de"), ("a b", "de"), ("a b c d e f g", "en")], "text string, lang string")
    assert ops.min_tokens(df, 5).count() == 2
    assert [r.text for r in ops.keep_language(ops.min_tokens(df, 5), "de").collect()] == ["a b c d e f"]


def test_cleaning_equals_python_on_random_strings(spark):
    import random
    rnd = random.Random(7)
    pieces = ["word", "\u00c9lan", "\u00df", "http://a.b/c", "https://x.y", "http s", "https:/", " ", "  ",
              "\t", "\n", "\r", "\x0b", "\x0c", "\x1c", "\x1f", "\x85", "\u00a0", "\u3000", "\u202f",
              "\u2028", "#tag", ".", "42"]
    texts = ["".join(rnd.choice(pieces) for _ in range(rnd.randint(0, 12))) for _ in range(400)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {r.i: (r.c, r.n) for r in df.select("i", T.clean_text(F.lower("t")).alias("c"),
                                                T.token_count(F.lower("t")).alias("n")).collect()}

    # The patterns under test, as the behaviour they state
    def py_clean(s):
        s = s.lower()
        n = len(s.split(" "))
        s = re.sub(r"[\n\t]*", "", s)
        s = re.sub(r"http[s]?://\S+", "", s)
        return s.strip(), n

    for i, t in enumerate(texts):
        assert got[i] == py_clean(t), repr(t)
