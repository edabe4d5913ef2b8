"""Registry of the engine's queries and their SQL oracles."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_ORACLES: dict[str, str] = {}
_MODULES = ("relational", "texts", "lexical", "ranking", "vectors", "understanding", "feedback", "learning", "indexing", "answers", "streams", "embedding", "upkeep", "search")


def query(sql: str | None = None):
    """Register a function (spark, sf_dir) -> DataFrame under its name, with its oracle in DuckDB's SQL."""

    def add(function):
        _QUERIES[function.__name__] = function
        if sql:
            _ORACLES[function.__name__] = sql
        return function

    return add


def _load() -> None:
    for name in _MODULES:
        import_module(f"trovesift.plans.{name}")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_ORACLES)
