"""Shared registry of (Spark query, oracle SQL) pairs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from rosterlake.sources.adapter import AS_OF, driver_fixture
from rosterlake.sources.schema import ntz

QueryFn = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, tuple[QueryFn, str | None]] = {}


def register(name: str, oracle: str | None):
    def deco(fn: QueryFn) -> QueryFn:
        if name in REGISTRY:
            raise KeyError(f"duplicate query key {name}")
        REGISTRY[name] = (fn, oracle)
        return fn
    return deco


def fx(spark: SparkSession, sf_dir: str, *kept: str):
    return driver_fixture(spark, sf_dir, kept)


def tables(spark: SparkSession, sf_dir: str, *kept: str):
    return fx(spark, sf_dir, *kept).tables


def AS_OF_COL():  # noqa: N802
    return ntz(AS_OF)


def load_all() -> dict[str, tuple[QueryFn, str | None]]:
    """Import every module that registers queries and return the registry."""
    from . import bucket_queries, change_queries, collation_queries, queries, repeated_queries  # noqa: F401
    return REGISTRY
