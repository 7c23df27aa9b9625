"""Quote lines to typed rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from themeloom.functions.text import strip
from themeloom.operators.scale import once
from themeloom.schemas import QUOTE_FIELDS

# 0-based positions in a quote line, and its smallest field count.
POSITIONS = {
    "code": 2, "name": 1, "price": 3, "prev_close": 4, "open": 5, "volume": 6,
    "turnover": 37, "turnover_rate": 38, "pe": 39, "high": 33, "low": 34,
    "amplitude": 43, "market_cap_float": 44, "market_cap_total": 45, "pb": 46,
}
LOW_FALLBACK = 42
MIN_FIELDS = 48


def split_lines(lines: DataFrame) -> DataFrame:
    """Each line with its fields and, if it is unusable, the reason why."""
    text = F.split_part(F.col("line"), F.lit('"'), F.lit(2))
    cut = once(lines.withColumn("line", strip(F.col("line"))), "_f", F.split(text, "~", -1))
    reason = (
        F.when(~F.col("line").contains("="), "no assignment")
        .when(F.get("_f", F.lit(0)).eqNullSafe("") & (F.size("_f") == 1), "no quoted text")
        .when(F.size("_f") < MIN_FIELDS, "too few fields")
        .when(F.get("_f", F.lit(POSITIONS["code"])) == "", "no code")
    )
    return cut.withColumn("reason", reason)


def parse_quotes(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(quotes, rejects) from a ``line`` column; other columns pass through."""
    rest = [c for c in lines.columns if c != "line"]
    cut = split_lines(lines)

    def at(position: int):
        return F.get("_f", F.lit(position))

    values = {name: at(p) for name, p in POSITIONS.items()}
    short = F.char_length(at(POSITIONS["low"])) <= 2
    values["low"] = F.when(short, at(LOW_FALLBACK)).otherwise(at(POSITIONS["low"]))
    quotes = cut.where(F.col("reason").isNull()).select(
        *rest, *[v.alias(n) for n, v in values.items()]
    )
    rejects = cut.where(F.col("reason").isNotNull()).select(*rest, "line", "reason")
    return quotes, rejects


def typed_quotes(quotes: DataFrame) -> DataFrame:
    """The quote fields as numbers; text that is no number becomes null."""
    return quotes.select(*[
        F.expr(f"try_cast({c} AS DOUBLE)").alias(c) if c in QUOTE_FIELDS else F.col(c)
        for c in quotes.columns
    ])
