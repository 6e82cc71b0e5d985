"""Every registered query equals its DuckDB oracle (exact values, any row order)."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as E
from tessel.plans import registry
from tessel.session import TABLES

from conftest import SF_SMALL


def norm(v):
    if isinstance(v, float) and math.isnan(v):
        return "NaN"
    if isinstance(v, float) and v == 0:
        return repr(v)  # 0.0 and -0.0 are told apart
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    if hasattr(v, "asDict"):
        return tuple(norm(x) for x in v)
    return v


def key(row):
    return tuple((x is None, repr(x)) for x in row)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        p = f"{SF_SMALL}/{t}.parquet"
        if os.path.exists(p):
            c.execute(f"create view {t} as select * from read_parquet('{p}')")
    return c


@pytest.mark.parametrize("name", sorted(E.oracle_sql()))
def test_query_matches_oracle(spark, con, name):
    df = E.queries()[name](spark, SF_SMALL)
    cols = sorted(df.columns)
    got = sorted((tuple(norm(r[c]) for c in cols) for r in df.collect()), key=key)
    rel = con.sql(E.oracle_sql()[name])
    assert sorted(rel.columns) == cols
    idx = [rel.columns.index(c) for c in cols]
    want = sorted((tuple(norm(r[i]) for i in idx) for r in rel.fetchall()), key=key)
    assert got == want


def test_every_query_has_oracle_or_is_listed():
    no_oracle = set(registry.queries()) - set(registry.oracle_sql())
    assert no_oracle == {"project_2d", "pair_classifier", "spectral_map", "pair_training"}
