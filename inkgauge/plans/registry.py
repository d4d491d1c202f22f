"""Named queries, each with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from inkgauge.plans.views import Views

_queries: dict[str, Callable[[Views], DataFrame]] = {}
_sql: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn: Callable[[Views], DataFrame]):
        if name in _queries:
            raise ValueError(f"{name} is registered twice")
        _queries[name] = fn
        if sql is not None:
            _sql[name] = sql
        return fn

    return register


def _load() -> None:
    from inkgauge.plans import (  # noqa: F401
        queries_evaluation,
        queries_features,
        queries_models,
        queries_sources,
        queries_text,
    )


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()

    def bind(fn: Callable[[Views], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        return lambda spark, sf_dir: fn(Views(spark, sf_dir))

    return {name: bind(fn) for name, fn in _queries.items()}


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_sql)
