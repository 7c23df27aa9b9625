"""The list of stocks: clean-up, classes, lookups and set operations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from themeloom.functions import codes
from themeloom.functions.text import strip

# The two accepted spellings of the raw columns.
CODE_SPELLINGS = ("代码", "code")
NAME_SPELLINGS = ("名称", "name")


def _first_present(df: DataFrame, spellings: tuple[str, ...]):
    have = [F.col(f"`{s}`").cast("string") for s in spellings if s in df.columns]
    if not have:
        raise ValueError(f"none of {spellings} among {df.columns}")
    return strip(F.coalesce(*have, F.lit("")))


def normalize_universe(df: DataFrame) -> DataFrame:
    """(code, name) from either spelling, trimmed; rows lacking one are dropped.

    Other columns, such as a position, pass through.
    """
    rest = [c for c in df.columns if c not in CODE_SPELLINGS + NAME_SPELLINGS]
    return df.select(
        _first_present(df, CODE_SPELLINGS).alias("code"),
        _first_present(df, NAME_SPELLINGS).alias("name"),
        *rest,
    ).where((F.col("code") != "") & (F.col("name") != ""))


def with_market(df: DataFrame) -> DataFrame:
    return df.withColumn("market", codes.market(F.col("code")))


def with_symbol(df: DataFrame) -> DataFrame:
    return df.withColumn("symbol", codes.symbol(F.col("code")))


def new_keys(candidates: DataFrame, existing: DataFrame, key: str = "code") -> DataFrame:
    """Candidates whose key is not stored yet."""
    return candidates.join(existing.select(key), key, "left_anti")


def attach_concepts(universe: DataFrame, lists: DataFrame) -> DataFrame:
    """Every stock with its concept list, empty if it has none.

    ``lists`` is the result of :func:`themeloom.operators.concepts.concept_lists`.
    """
    return universe.join(lists, "code", "left").select(
        *[universe[c] for c in universe.columns],
        F.coalesce(lists["concepts"], F.array().cast("array<string>")).alias("concepts"),
        F.coalesce(lists["copies"], F.array().cast("array<bigint>")).alias("copies"),
    )


def with_quote_placeholder(universe: DataFrame, quotes: DataFrame) -> DataFrame:
    """Every stock with its quote, or with empty quote fields and ``matched`` false.

    ``quotes`` carries ``seq``; of several quotes for a code the last counts.
    """
    fields = [c for c in quotes.columns if c not in ("code", "seq")]
    last = (
        quotes.groupBy("code")
        .agg(F.max_by(F.struct(*fields), "seq").alias("quote"))
        .select("code", "quote", F.lit(True).alias("hit"))
    )
    rest = [c for c in universe.columns if c not in ("code", "name")]
    joined = universe.join(last, "code", "left")
    return joined.select(
        "code",
        F.when(F.col("hit"), F.col("quote.name")).otherwise(F.col("name")).alias("name"),
        *rest,
        *[F.col(f"quote.{f}").alias(f) for f in fields if f != "name"],
        F.coalesce("hit", F.lit(False)).alias("matched"),
    )


def all_codes(*drafts: DataFrame) -> DataFrame:
    """Distinct codes over all sources."""
    return reduce(DataFrame.unionByName, [d.select("code") for d in drafts]).distinct()


def date_spine(spark, start: str, end: str) -> DataFrame:
    """Every day from ``start`` to ``end``, both included, in either order."""
    a, b = F.lit(start).cast("date"), F.lit(end).cast("date")
    day = F.expr("interval 1 day")
    return spark.range(1).select(
        F.explode(F.sequence(F.least(a, b), F.greatest(a, b), day)).alias("date")
    )


def recent_days(spark, today: str | None = None, days: int = 30) -> DataFrame:
    """The day ``days`` before today up to today."""
    last = F.lit(today).cast("date") if today else F.current_date()
    return spark.range(1).select(
        F.explode(F.sequence(F.date_sub(last, days), last, F.expr("interval 1 day"))).alias("date")
    )


def missing_dates(spine: DataFrame, existing: DataFrame) -> DataFrame:
    """Days of the spine that are not stored."""
    return spine.join(existing.select("date"), "date", "left_anti")


def limited(df: DataFrame, n: int | None, by: str = "pos") -> DataFrame:
    """The first ``n`` rows of the universe for a trial run; all if ``n`` is none."""
    return df if not n else df.orderBy(by).limit(n)


def top_movers(quotes: DataFrame, n: int) -> DataFrame:
    """The ``n`` stocks that rose most since the previous close, ties by code.

    Stocks without a usable price or previous close are not ranked.
    """
    price = F.expr("try_cast(price AS DOUBLE)")
    before = F.expr("nullif(try_cast(prev_close AS DOUBLE), 0.0D)")
    return (
        quotes.withColumn("change", price / before - F.lit(1.0))
        .where(F.col("change").isNotNull())
        .orderBy(F.desc("change"), "code")
        .limit(n)
    )
