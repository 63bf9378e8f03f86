"""Registered queries: a Spark plan and, where SQL can say it, the same in SQL.

The plans read the star-schema, text and vector tables of one directory; the
mapping of those tables to documents, chunks, calls and cards is in ``base``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[QueryFn], QueryFn]:
    """Register a plan under its function name, with its SQL counterpart."""

    def register(fn: QueryFn) -> QueryFn:
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLES[fn.__name__] = sql
        return fn

    return register


def load_all() -> None:
    from loomdex.catalog import accounting, cards, documents, guards, office, retrieval  # noqa: F401
