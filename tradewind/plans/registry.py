"""Registry of named queries: a Spark function and, where SQL can say it, its oracle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tradewind.plans.oracle_views import with_views
from tradewind.sources.tables import Tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_ORACLE_BODIES: dict[str, str] = {}


def query(name: str, oracle: str | None = None) -> Callable:
    """Register ``fn(tables) -> DataFrame`` under ``name``."""

    def wrap(fn: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        QUERIES[name] = lambda spark, sf_dir: fn(Tables(spark, sf_dir))
        if oracle is not None:
            _ORACLE_BODIES[name] = oracle
        return fn

    return wrap


def oracles() -> dict[str, str]:
    """Oracle SQL by query name, each preceded by the views it names."""
    return {name: with_views(body) for name, body in _ORACLE_BODIES.items()}
