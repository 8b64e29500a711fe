"""All registered queries and, where SQL can say the same, their SQL (for DuckDB)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under a name that starts with its operator's id, with the same in SQL."""

    def add(function: Query) -> Query:
        QUERIES[name] = function
        if sql:
            ORACLES[name] = sql
        return function

    return add


from . import artifacts, boxes, experiments, more, pages, streams, trees  # noqa: E402, F401  these register their queries
