"""Registered queries: a DataFrame callable and, where SQL can say it, its SQL twin."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

from cellgrove.session import tune

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}
_MODULES = (
    "evaluation",
    "curation",
    "scalars",
    "masked",
    "stencils",
    "shapes",
    "thresholds",
    "spatial",
    "recipes",
    "sweeps",
    "classical",
    "files",
)


def query(name: str, sql: str | None = None):
    """Register ``fn(read)``; ``read(table)`` gives a table of the chosen folder."""

    def wrap(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            tune(spark)
            return fn(lambda table: spark.read.parquet(f"{sf_dir}/{table}.parquet"))

        run.__name__ = name
        if name in _QUERIES:
            raise ValueError(f"{name} registered twice")
        _QUERIES[name] = run
        if sql is not None:
            _SQL[name] = sql
        return fn

    return wrap


def load():
    for module in _MODULES:
        import_module(f"cellgrove.catalog.{module}")
    return _QUERIES, _SQL
