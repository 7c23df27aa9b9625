"""Shared by the queries: table access, code numbers and registration."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


class Registry:
    """Queries of one area and their SQL."""

    def __init__(self):
        self.queries = {}
        self.oracle = {}

    def add(self, name: str, sql: str | None = None):
        def register(fn):
            self.queries[name] = fn
            if sql is not None:
                self.oracle[name] = sql
            return fn

        return register


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def code(key: str | Column) -> Column:
    """A code of six digits, with the millions of the key behind them from a million on.

    Every key has a code of its own, and all leading digits occur.
    """
    k = F.col(key) if isinstance(key, str) else key
    millions = F.when(k >= 1000000, F.floor(k / 1000000).cast("string")).otherwise("")
    return F.concat(F.lpad(((k * 7919 + 13) % 1000000).cast("string"), 6, "0"), millions)


def code_sql(key: str) -> str:
    return (
        f"(lpad(CAST(({key} * 7919 + 13) % 1000000 AS VARCHAR), 6, '0') || "
        f"CASE WHEN {key} >= 1000000 THEN CAST(CAST({key} AS BIGINT) // 1000000 AS VARCHAR) ELSE '' END)"
    )


def joined_map(c: str | Column) -> Column:
    """A map as sorted ``key=value`` text."""
    entries = F.transform(F.map_entries(c), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return F.array_join(F.array_sort(entries), ";")
