"""Registry of queries and the SQL that must give the same rows."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}

_MODULES = ("reconcile", "totals", "cleaning", "profiles", "relations", "conversations", "files", "streams")


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register ``fn(spark, sf_dir)`` under ``name`` with its SQL."""

    def register(fn: Query) -> Query:
        if name in _QUERIES:
            raise ValueError(f"query {name} is registered twice")
        _QUERIES[name] = fn
        if sql is not None:
            _SQL[name] = sql
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _load() -> None:
    for module in _MODULES:
        importlib.import_module(f"tallyloom.plans.{module}")


def all_queries() -> dict[str, Query]:
    _load()
    return dict(_QUERIES)


def all_sql() -> dict[str, str]:
    _load()
    return dict(_SQL)


# ---- SQL text helpers ----------------------------------------------------------

def union_sql(parts: list[str]) -> str:
    return "\nUNION ALL\n".join(parts)


def sql_money(expr: str) -> str:
    """``RM 1,234.50`` in SQL."""
    return f"'RM ' || format('{{:,.2f}}', coalesce({expr}, 0.0))"


def sql_grouped(expr: str) -> str:
    return f"format('{{:,}}', cast({expr} as bigint))"
