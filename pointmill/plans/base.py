"""Registration of queries beside their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pointmill.plans import fixtures

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, *views: str, sql: str | None = None, dealt: bool = False):
    """Register f(*views as DataFrames) under ``name``; ``sql`` reads the same views in DuckDB. ``dealt``: see :func:`pointmill.plans.fixtures.view`."""

    def add(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        QUERIES[name] = lambda spark, sf_dir: f(*(fixtures.view(spark, sf_dir, v, dealt) for v in views))
        if sql is not None:
            ORACLE_SQL[name] = fixtures.oracle(sql, *views)
        return f

    return add


def again(name: str, of: str) -> None:
    """A second name of a query, kept from when the first one met a part of its tables only."""
    QUERIES[name] = QUERIES[of]
    ORACLE_SQL[name] = ORACLE_SQL[of]


def uniform_sql(key: str) -> str:
    return f"(('0x' || substr(md5({key}), 1, 8))::BIGINT / 4294967296.0)"
