"""Named queries and their DuckDB oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .fixtures import Views, duck_ctes

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def oracle(views: str, body: str, ctes: list[str] | tuple[str, ...] = ()) -> str:
    """DuckDB text: fixture views, then shared CTEs, then the query body."""
    parts = duck_ctes(*views.split()) + list(ctes)
    return (f"WITH {', '.join(parts)} " if parts else "") + body


def query(name: str, sql: str | None = None):
    """Register ``fn(views) -> DataFrame`` under ``name``; without ``sql`` only its rows are checked."""

    def register(fn: Callable[[Views], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(Views(spark, sf_dir))

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register
