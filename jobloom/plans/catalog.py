"""Registry of named queries: each is a Spark callable and, where SQL can say it, its twin."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}
FAMILIES = ["rollup", "search", "resolve", "source", "extract", "dashboard", "scalar", "stream"]


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        if name in _QUERIES:
            raise ValueError(f"query {name} is registered twice")
        _QUERIES[name] = fn
        if sql is not None:
            _SQL[name] = sql
        return fn
    return register


def load() -> tuple[dict[str, Query], dict[str, str]]:
    for family in FAMILIES:
        import_module(f"jobloom.plans.{family}_queries")
    return dict(_QUERIES), dict(_SQL)
