"""Registered queries return the same rows whatever the shuffle partitioning."""

import pytest

import __spark_entry__ as E

from conftest import SF_SMALL

NAMES = ["clean_posts_detected", "detect_language", "dedup_text", "early_stop", "assign_batches",
         "hash_encode", "knn_graph", "odd_one_out", "class_report", "shuffle_rows", "random_outsiders"]


def rows(df):
    cols = sorted(df.columns)
    return sorted((tuple(repr(r[c]) for c in cols) for r in df.collect()))


@pytest.mark.parametrize("name", NAMES)
def test_same_result_for_any_shuffle_partitions(spark, name):
    fn = E.queries()[name]
    old = spark.conf.get("spark.sql.shuffle.partitions")
    results = []
    try:
        for n in ("1", "4", "16"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            results.append(rows(fn(spark, SF_SMALL)))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    assert results[0] == results[1] == results[2]
