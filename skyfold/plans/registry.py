"""Named queries over the given tables, each with its SQL cross-check if it has one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from skyfold.plans.adapters import with_tables

QueryFn = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, QueryFn] = {}
CHECKS: dict[str, str] = {}


def query(name: str, tables: str = "", sql: str | None = None) -> Callable[[QueryFn], QueryFn]:
    def register(fn: QueryFn) -> QueryFn:
        QUERIES[name] = fn
        if sql:
            CHECKS[name] = with_tables(tables, sql) if tables else sql
        return fn

    return register


def r6(expression: str, digits: int = 6) -> str:
    return f"(round({expression},{digits})+0.0)"
