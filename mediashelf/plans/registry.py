"""Registry of named queries: a Spark builder ``(spark, sf_dir) -> DataFrame`` and,
where SQL can express it, the oracle text for DuckDB over the driver's tables."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from .oracle_views import with_views

Builder = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Query:
    name: str
    build: Builder
    sql: str | None


QUERIES: dict[str, Query] = {}


def register(name: str, sql: str | None = None, views: tuple[str, ...] = ()):
    """Decorator: register a builder under ``name`` with an optional oracle query.

    ``views`` names the derived catalogue views the SQL reads; they are prefixed as CTEs.
    """
    def deco(fn: Builder) -> Builder:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        text = None
        if sql is not None:
            text = with_views(sql, *views) if views else sql
        QUERIES[name] = Query(name, fn, text)
        return fn
    return deco


def load_all() -> dict[str, Query]:
    """Import every query module (each registers on import) and return the registry."""
    from . import (  # noqa: F401
        q_catalogue, q_paths, q_registry, q_upsert, q_sync, q_migrate, q_scan, q_analysis,
        q_inventory, q_streaming, q_stores,
    )
    return QUERIES
