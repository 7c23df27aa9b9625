"""Every operator as a query on the given tables, with the same result in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


def queries() -> dict[str, Query]:
    from themeloom.checks import corpus, drafts, feeds, vectors

    return {**vectors.QUERIES, **drafts.QUERIES, **feeds.QUERIES, **corpus.QUERIES}


def oracle_sql() -> dict[str, str]:
    from themeloom.checks import corpus, drafts, feeds, vectors

    return {**vectors.ORACLE, **drafts.ORACLE, **feeds.ORACLE, **corpus.ORACLE}
