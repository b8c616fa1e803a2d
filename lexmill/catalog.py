"""All queries of the engine by name, with their oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lexmill.plans import analytics, cases, checks, documents, judging, laws, relations, retrieval, rulesets, trees

MODULES = (retrieval, analytics, trees, checks, cases, relations, laws, judging, documents, rulesets)
Query = Callable[[SparkSession, str], DataFrame]


def queries() -> dict[str, Query]:
    return {f.__name__: f for m in MODULES for f in m.QUERIES}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in m.SQL.items()}
