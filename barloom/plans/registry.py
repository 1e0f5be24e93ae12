"""Registration of queries: name, Spark plan over the derived views, DuckDB text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from barloom.plans.oracle_views import with_views
from barloom.session import apply_settings
from barloom.sources.views import Views, presented

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_PARTS: dict[str, tuple[str, str]] = {}


def query(name: str, views: str = "", sql: str | None = None):
    """Register ``fn(Views) -> DataFrame``; ``views`` names the CTEs the SQL needs."""

    def add(fn: Callable[[Views], DataFrame]):
        def run(spark: SparkSession, root: str) -> DataFrame:
            return presented(fn(Views(apply_settings(spark), root)))

        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = run
        if sql is not None:
            ORACLE_PARTS[name] = (views, sql)
        return fn

    return add


def load_all() -> None:
    from barloom.plans import (  # noqa: F401
        factor_queries,
        screen_queries,
        signal_queries,
        store_queries,
        stream_queries,
        trade_queries,
    )


def oracles() -> dict[str, str]:
    return {name: with_views(views, sql) for name, (views, sql) in ORACLE_PARTS.items()}
