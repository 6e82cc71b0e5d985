"""The query registry behind ``__spark_entry__``: Spark plan + SQL oracle per name.

Every query reads the driver tables of ``sf_dir`` (through the fixtures of
``plans.fixtures``) and runs over the whole tables. Column names are aliased
identically on both sides; irrational values are rounded to 6 places on both
sides so sums taken in a different order compare equal.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, QueryFn] = {}
_ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn: QueryFn) -> QueryFn:
        _QUERIES[name] = fn
        if sql is not None:
            _ORACLES[name] = sql.strip()
        return fn
    return deco


def sql_of(name: str) -> str:
    """The oracle of a query registered before, for another way to the same rows."""
    return _ORACLES[name]


def queries() -> dict[str, QueryFn]:
    _load_all()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load_all()
    return dict(_ORACLES)


def _load_all() -> None:
    # Query modules register themselves on import.
    from . import q_text, q_lang, q_encode, q_vectors, q_sampling, q_eval, q_sources  # noqa: F401


def with_ctes(*ctes: str) -> str:
    return "with " + ",\n".join(ctes) + "\n"
