"""Physical-plan checks: native expressions, pushdown/pruning, no single-partition exchange."""

import sys

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E
from tessel import session
from tessel.operators import encode as enc
from tessel.plans import registry
from tessel.session import load

from conftest import SF_SMALL


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_clean_posts_has_no_python(spark):
    p = plan(E.queries()["clean_posts"](spark, SF_SMALL))
    assert "BatchEvalPython" not in p and "ArrowEvalPython" not in p


def test_rows_are_encoded_and_scored_in_place(spark):
    """No exchange on the row's key: sequences, hashes and language scores stay in their row."""
    for name in ("detect_language", "encode_text", "hash_encode"):
        p = plan(E.queries()[name](spark, SF_SMALL))
        assert "hashpartitioning(doc_id" not in p and "hashpartitioning(conv_id" not in p, name
        assert "Join" not in p, name


def test_scan_prunes_columns_and_pushes_filters(spark):
    d = load(spark, SF_SMALL, "documents").filter(F.col("doc_id") > 10).select("doc_id")
    p = plan(d)
    assert "PushedFilters: [IsNotNull(doc_id), GreaterThan(doc_id,10)]" in p
    assert "ReadSchema: struct<doc_id:bigint>" in p


def test_batches_avoid_single_partition(spark):
    d = load(spark, SF_SMALL, "documents").select("doc_id")
    p = plan(enc.assign_batches(d, 64, ["doc_id"]))
    lines = p.splitlines()
    # the only single-partition exchange carries the per-partition row counts
    # (one row per partition), never the data rows
    for i, line in enumerate(lines):
        if "Exchange SinglePartition" in line:
            assert "HashAggregate(keys=[_pid" in lines[i + 1]


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.columns == ["uid", "text", "img_dir", "img_fname"]
    assert df.count() > 0


def test_knn_merge_uses_group_limit(spark):
    p = plan(E.queries()["knn_self"](spark, SF_SMALL))
    assert "WindowGroupLimit" in p
    assert "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p


def test_all_pairs_plans_have_no_cross_join(spark):
    for name in ("knn_graph", "cosine_matrix", "odd_one_out"):
        p = plan(E.queries()[name](spark, SF_SMALL))
        assert "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p, name


def test_language_filter_reaches_the_scan(spark):
    import tempfile
    from tessel.operators import text as ops
    from tessel.plans import fixtures as fx
    d = tempfile.mkdtemp(prefix="tessel-push-", dir="/tmp")
    fx.posts(spark, SF_SMALL).write.parquet(d + "/posts")
    p = plan(ops.clean_posts(spark.read.parquet(d + "/posts"), keep_language="de"))
    assert "EqualTo(lang,de)" in p


def test_dedup_aggregates_by_hash(spark):
    p = plan(E.queries()["dedup_text"](spark, SF_SMALL))
    assert "SortAggregate" not in p and "HashAggregate" in p


def test_spread_keeps_pruning_and_caches_nothing(spark):
    p = plan(E.queries()["file_stems"](spark, SF_SMALL))
    assert "InMemoryTableScan" not in p and "text" not in p.split("ReadSchema")[1].split("\n")[0]


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_every_query_reads_the_given_tables(spark, name, monkeypatch):
    """The tables are opened below the given folder; what is checkpointed comes from them."""
    opened = []
    real = session.load
    for m in [m for n, m in sys.modules.items() if n.startswith("tessel.") and getattr(m, "load", None) is real]:
        monkeypatch.setattr(m, "load", lambda spark, sf_dir, table: opened.append(sf_dir) or real(spark, sf_dir, table))
    registry.queries()[name](spark, SF_SMALL)
    assert opened and set(opened) == {SF_SMALL}, name


def test_incomplete_rows_are_dropped_without_cleaning_twice(spark):
    import __spark_entry__ as E
    from conftest import SF_SMALL
    once = E.queries()["clean_posts"](spark, SF_SMALL)._jdf.queryExecution().optimizedPlan().toString().count("regexp_replace(")
    plan = E.queries()["drop_incomplete"](spark, SF_SMALL)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace(") == once
