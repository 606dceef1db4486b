"""Every registered query with its check SQL, collected from the query modules."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    """Register a (spark, sf_dir) function; ``sql`` is the same query for the check engine."""

    def register(fn):
        key = name or fn.__name__
        QUERIES[key] = fn
        if sql is not None:
            ORACLE[key] = sql
        return fn

    return register


from offermend.plans import (  # noqa: E402,F401
    queries_learned,
    queries_match,
    queries_process,
    queries_reference,
    queries_report,
    queries_sources,
    queries_suggest,
    queries_text,
    queries_vision,
)
