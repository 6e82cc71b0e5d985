"""Registered queries: the columns the results are compared by, and the SQL oracles."""

import pytest

from tessel.llm import queries

SF = "/root/testdata/sf0.001"
COLUMNS = {
    "op1": ["doc_id", "fingerprint", "component_id"],
    "op2": ["query_id", "rank", "vec_id", "score"],
    "op3": ["doc_id", "held_out", "score", "predicted"],
    "op5": ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"],
    "op6": ["doc_id", "held_out", "score", "predicted"],
    "op7": ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"],
    "op8": ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"],
    "op9": ["doc_id", "n_words", "n_removed", "kept_sha256"],
    "op10": ["doc_id", "start", "n_tokens", "ids_crc32"],
    "op11": ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
    "op12": ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
    "op13": ["lang", "rank", "phrase", "a", "l", "r", "n", "score"],
}


@pytest.mark.parametrize("name", list(queries.QUERIES))
def test_columns(spark, name):
    op = name.split("_")[0]
    df = queries.QUERIES[name](spark, SF)
    if op in COLUMNS:
        assert df.columns[:len(COLUMNS[op])] == COLUMNS[op]
    whole = {"op2": None, "op4": None, "op8": None, "op11": None, "op13": None}
    if op not in whole:
        assert df.count() == spark.read.parquet(f"{SF}/documents.parquet").count()


def test_all_operators_are_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 14))


def test_nothing_else_imports_these_folders():
    import pathlib
    top = pathlib.Path(queries.__file__).parents[1]
    for p in top.rglob("*.py"):
        if "llm" not in p.parts:
            assert "llm" not in p.read_text(), p
