"""Registry of runnable queries and their reference SQL."""

from __future__ import annotations

import functools
import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from waterspark.session import ship_package

Query = Callable[[SparkSession, str], DataFrame]
MODULES = ["scalar_queries", "spatial_queries", "catalog_queries", "imagery_queries", "raster_queries", "sample_queries", "source_queries"]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")

        @functools.wraps(fn)
        def run(spark: SparkSession, sf: str) -> DataFrame:
            ship_package(spark)
            return fn(spark, sf)

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def load() -> None:
    for module in MODULES:
        importlib.import_module(f"waterspark.plans.{module}")
