"""Queries by name, with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def note(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return note


#: The party table: orders with their customers, a row for each order.
WIDE = "wide AS (SELECT o_orderkey AS row_id, o_orderstatus, o_orderpriority, c_mktsegment, c_nationkey FROM orders JOIN customer ON o_custkey = c_custkey)"


def uniform_sql(text: str) -> str:
    return f"((('0x' || substr(md5({text}), 1, 8))::BIGINT + 0.5e0) / 4294967296e0)"


def hash_sql(text: str) -> str:
    return f"(('0x' || substr(md5({text}), 1, 8))::BIGINT)"
