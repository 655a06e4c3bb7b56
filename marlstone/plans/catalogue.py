"""The registered queries of the engine and their SQL, gathered from the plan modules."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from marlstone.plans import analytics, answers, context, retrieval, structure

_MODULES = [retrieval, structure, analytics, answers, context]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """All queries of the plan modules."""
    return {k: f for m in _MODULES for k, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    """The SQL of those that SQL expresses."""
    return {k: s for m in _MODULES for k, s in m.ORACLE.items()}
