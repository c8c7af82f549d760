"""Registered queries and their DuckDB twins."""

from __future__ import annotations

from collections.abc import Callable
from functools import cache

from pyspark.sql import DataFrame, SparkSession

from auditlake.session import importable

Query = Callable[[SparkSession, str], DataFrame]

_QUERIES: dict[str, Query] = {}
_ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query under its function's name, with its twin where SQL expresses it."""

    def add(f: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            importable(spark)
            return f(spark, sf_dir)

        _QUERIES[f.__name__] = run
        if sql:
            _ORACLES[f.__name__] = sql
        return f

    return add


@cache
def _load() -> None:
    from auditlake.plans import evidence, index, patterns, progress, reports, roots, scalars, scoring, stores, texts, trees  # noqa: F401


def queries() -> dict[str, Query]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_ORACLES)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queries()["a3_threshold_histogram"](spark, sf_dir)
