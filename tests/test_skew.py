"""Skewed inputs: one key holding a third (or more) of all rows."""

import random

from pyspark.sql import functions as F

from tessel.operators import evaluate as ev
from tessel.operators import lang as L
from tessel.operators import text as ops
from tessel.session import load

from conftest import SF_SMALL


def test_dedup_with_hot_text(spark):
    rows = [(i, "hot" if i % 3 == 0 else f"t{i}") for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    out = ops.dedup_text(df).collect()
    assert len(out) == 1 + 2000
    assert min(r.doc_id for r in out if r.text == "hot") == 0


def test_early_stop_with_one_huge_run(spark):
    rnd = random.Random(1)
    rows = [(0, s, rnd.random()) for s in range(3000)] + [(r, s, rnd.random()) for r in range(1, 20) for s in range(10)]
    log = spark.createDataFrame(rows, "run_id long, step long, eval_loss double").repartition(8)
    a = {r.run_id: tuple(r)[1:] for r in ev.early_stop(log, 3, chunk_steps=64).collect()}
    b = {r.run_id: tuple(r)[1:] for r in ev.early_stop(log, 3, chunk_steps=1 << 20).collect()}
    assert a == b and len(a) == 20


def test_salted_profile_join_equals_broadcast(spark, monkeypatch):
    d = load(spark, SF_SMALL, "documents").select("doc_id", "text", "lang")
    prof = L.fit_language_profile(d.filter(F.col("doc_id") % 2 == 0))
    a = {r.doc_id: r.detected for r in L.detect_language(d, prof).collect()}
    monkeypatch.setattr(L, "BROADCAST_PROFILE_CELLS", 0)
    monkeypatch.setattr(L, "ROWS_PER_SALT", 20)
    salted = L.detect_language(d, prof)
    assert "_salt" in salted._jdf.queryExecution().executedPlan().toString()
    b = {r.doc_id: r.detected for r in salted.collect()}
    assert a == b
