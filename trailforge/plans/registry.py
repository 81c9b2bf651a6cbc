"""All queries of the library by name, with their SQL twins."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
_queries: dict[str, Query] = {}
_sql: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query (spark, sf_dir) -> DataFrame, with the SQL that must give the same rows."""

    def put(f: Query) -> Query:
        assert name not in _queries, name
        _queries[name] = f
        if sql is not None:
            _sql[name] = sql
        return f

    return put


def oracle_of(name: str) -> str:
    """The SQL of a query that must give the same rows; its module has to be imported before."""
    return _sql[name]


MODULES = ("retrieval", "text", "credit", "graph", "evaluation", "extras", "sources", "agents", "tasks", "stores")


def _load() -> None:
    for name in MODULES:
        importlib.import_module(f"trailforge.plans.{name}")


def queries() -> dict[str, Query]:
    _load()
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_sql)
