"""Registered queries, each with the SQL that another engine runs on the same tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query under its function's name."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def load_all() -> tuple[dict[str, Query], dict[str, str]]:
    from . import attested, composed, exposure, further, governance, history, invariants, kept, more, ordinals, radix, relational, sequences, statements  # noqa: F401

    return dict(QUERIES), dict(SQL)
