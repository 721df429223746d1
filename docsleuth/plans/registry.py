"""The register of queries and their DuckDB counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, with_: str = "") -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            # a filtered count is a BIGINT in both engines
            SQL[f.__name__] = ((f"WITH {with_} " if with_ else "") + sql).replace("count_if(", "count(*) FILTER (")
        return f

    return add


def longs(*names: str) -> list:
    return [F.col(n).cast("bigint").alias(n) for n in names]
