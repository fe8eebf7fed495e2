"""Query registry: name -> (Spark job over an sf directory, DuckDB oracle SQL).

Each registered query reads the driver tables (through the derived views of
``vigil.sources.tables``) and runs one operator of the inventory over the
whole tables.  ``oracle`` is ANSI SQL over the same views for the
correctness gate; operators without a SQL form register none.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from vigil.sources.tables import oracle_with

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None, views: tuple[str, ...] = ()):
    """Register ``fn(spark, sf_dir) -> DataFrame`` (and its oracle SQL)."""
    def deco(fn: QueryFn) -> QueryFn:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = oracle_with(sql, *views)
        return fn
    return deco


def load_all() -> None:
    """Import every module that registers queries."""
    from vigil.plans import (  # noqa: F401
        q_release, q_metrics, q_logs, q_telemetry, q_alerts, q_resilience,
        q_incidents, q_warehouse, q_recommender, q_ingest, q_classifier, q_streaming, q_extensions, q_sources,
    )
