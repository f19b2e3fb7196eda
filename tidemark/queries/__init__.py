"""Queries that apply the operators to the given tables, with the same results as SQL for checking."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidemark.sources.adapters import sql

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, check: str | None = None):
    """Registers a query under a name, with the SQL that checks it."""

    def add(f):
        QUERIES[name] = f
        if check:
            ORACLE_SQL[name] = sql(check)
        return f

    return add


from tidemark.queries import book, decisions, depth, events, forecast, inference, ingest, resampling, samples, streams, tape, trades  # noqa: E402, F401
