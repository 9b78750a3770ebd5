"""Where queries are registered."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from callwise.queries.adapters import CTES

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def with_ctes(names: str, body: str) -> str:
    """``body`` after the named adapter CTEs (space-separated, in order of use)."""
    if not names:
        return body
    return "WITH " + ",\n".join(f"{n} AS ({CTES[n]})" for n in names.split()) + "\n" + body


def query(name: str, sql: str | None = None, ctes: str = "") -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = with_ctes(ctes, sql)
        return fn
    return add
