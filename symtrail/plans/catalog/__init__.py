"""Registered queries: each entry reads the given tables, or data Spark derives from them.

`QUERIES[name] = function(spark, sf_dir)`; `SQL[name]` is the equivalent reference query.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return register


def load() -> None:
    from symtrail.plans.catalog import answers, code, graph, lifecycle, outcomes, retrieval, text  # noqa: F401
