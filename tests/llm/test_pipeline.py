"""The pipeline's stages, each held against its operator on its own input, and on odd tables."""

import re
import zlib
from collections import Counter

import numpy as np
import pytest
from tokenizers import Tokenizer

import __spark_entry__ as E
import corpus_pipeline
from tessel.llm import decontam, quality, secrets, simhash, tokens

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """Each stage's input and output, written and read again."""
    top = tmp_path_factory.mktemp("stages")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SF).write.parquet(f"{top}/{name}")
        after = spark.read.parquet(f"{top}/{name}")
        out[name] = (docs, after)
        docs = after
    return out


def ids(df):
    return Counter(r[0] for r in df.select("doc_id").collect())


def test_stages_are_registered_and_keep_columns(stages, spark):
    assert [n for n, _ in corpus_pipeline.STAGES] == list(stages) and "pipeline" in E.queries()
    for name, (before, after) in list(stages.items())[:-1]:
        assert after.columns == before.columns or set(after.columns) == set(before.columns), name


def test_quality_stage_keeps_what_the_operator_predicts(stages, spark):
    before, after = stages["quality_classifier"]
    want = quality.quality_scores(before, spark.read.parquet(f"{SF}/labels.parquet")).filter("predicted = 1")
    assert ids(after) == ids(want)


def test_near_dedup_stage_keeps_one_of_each_component(stages):
    before, after = stages["simhash_near_dedup"]
    want = simhash.near_duplicates(before).filter("doc_id = component_id")
    assert ids(after) == ids(want)


def test_decontamination_stage_drops_contaminated_documents(stages, spark):
    before, after = stages["benchmark_decontamination"]
    bad = {r[0] for r in decontam.contaminated(before, spark.read.parquet(f"{SF}/benchmark.parquet")).select("doc_id").collect()}
    assert set(ids(after)) == set(ids(before)) - bad


def test_secret_stage_leaves_no_base_secret(stages):
    before, after = stages["secret_scan"]
    assert ids(before) == ids(after)
    left = secrets.secret_spans(after).filter("spans <> ''").count()
    assert left == 0
    changed = {r["doc_id"] for r in before.join(after.withColumnRenamed("text", "t"), "doc_id").filter("text <> t").collect()}
    assert changed == {r["doc_id"] for r in secrets.secret_spans(before).filter("spans <> ''").collect()}
    assert after.filter("n_chars <> length(text)").count() == 0


def test_packing_stage_holds_every_token(stages):
    before, after = stages["bm25_packing"]
    tok = Tokenizer.from_file(tokens.tokenizer_path())
    want = {r["doc_id"]: tok.encode(r["text"] or "", add_special_tokens=False).ids + [1] for r in before.collect()}
    got = Counter()
    for r in after.collect():
        part = want[r["doc_id"]][r["start"]:r["start"] + r["length"]]
        assert zlib.crc32(np.array(part, "<u4").tobytes()) == r["ids_crc32"]
        got[r["doc_id"]] += r["length"]
    assert got == {k: len(v) for k, v in want.items()}


def test_stages_on_odd_and_empty_tables(spark, tmp_path):
    long = " ".join(f"w{i % 977}" for i in range(50_000))
    rows = [(1, "a b c"), (1, "a b c"), (2, None), (3, ""), (None, "no id at all"), (4, long), (5, "password=abcdef123")]
    schema = "doc_id long, text string, n_chars long, k long, _k long, score double, _quality double, spans string"
    for name, data in (("odd", rows), ("none", [])):
        sf = f"{tmp_path}/{name}"
        docs = spark.createDataFrame([(i, t, len(t or ""), *[None] * 5) for i, t in data], schema)
        docs.write.parquet(f"{sf}/documents.parquet")
        spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
        spark.createDataFrame([], "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
        got = corpus_pipeline.run(spark, sf)
        if not data:
            assert got.count() == 0
        else:
            kept = Counter(r["doc_id"] for r in got.filter("start = 0").collect())
            assert kept == {1: 1, 2: 1, None: 1, 4: 1, 5: 1}  # 3 is a copy of 2: both have no words


def test_the_other_queries_do_not_need_these_folders():
    text = open(E.__file__).read()
    assert re.search(r"except ModuleNotFoundError", text)
