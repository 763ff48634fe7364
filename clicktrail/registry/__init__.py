"""Registered driver queries: a Spark builder and, where SQL can state it, a DuckDB oracle.

Every builder takes ``(spark, sf_dir)`` and reads the driver tables under
``sf_dir`` (through the adapters), so its work grows with the data.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]

SPARK_QUERIES: dict[str, QueryFn] = {}
ORACLES: dict[str, str] = {}


def register(name: str, oracle: str | None = None):
    def deco(fn: QueryFn) -> QueryFn:
        if name in SPARK_QUERIES:
            raise ValueError(f"duplicate query {name}")
        SPARK_QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn

    return deco


def load_all() -> None:
    # importing the modules fills the two dicts
    from clicktrail.registry import (  # noqa: F401
        distribution_queries,
        file_queries,
        misc_queries,
        trace_queries,
        quality_queries,
        report_queries,
        sessions,
        stats_queries,
        temporal_queries,
        text_queries,
        trees,
    )
