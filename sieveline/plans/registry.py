"""Named queries over the driver's tables, each with its SQL equivalent."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
_Q: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def register(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a function under its name, with the SQL that gives its rows."""

    def wrap(f: Query) -> Query:
        _Q[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return wrap


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def queries() -> dict[str, Query]:
    from . import curation, graphs, more, outcomes, packaging, retrieval, storage, text, vectors  # noqa: F401

    return dict(_Q)


def oracle_sql() -> dict[str, str]:
    queries()
    return dict(_SQL)
