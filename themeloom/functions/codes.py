"""Rules on stock codes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# First digit of a code to its market, and to its quote prefix.
MARKETS = (("6", "SH"), ("0", "SZ"), ("3", "SZ"), ("4", "BJ"), ("8", "BJ"))
OTHER_MARKET = "OTHER"
SYMBOLS = (
    ("6", "sh"), ("9", "sh"),
    ("0", "sz"), ("2", "sz"), ("3", "sz"),
    ("4", "bj"), ("8", "bj"),
)
DEFAULT_SYMBOL = "sz"


def _by_first_digit(code: Column, rules: tuple, default: str) -> Column:
    """The label of the first rule whose prefix fits."""
    groups: dict[str, list[str]] = {}
    for digit, label in rules:
        groups.setdefault(label, []).append(digit)
    first = F.substring(code, 1, 1)
    fallback = F.lit(default)
    return reduce(
        lambda rest, item: F.when(first.isin(item[1]), item[0]).otherwise(rest),
        groups.items(),
        fallback,
    )


def market(code: Column) -> Column:
    return _by_first_digit(code, MARKETS, OTHER_MARKET)


def symbol(code: Column) -> Column:
    return F.concat(_by_first_digit(code, SYMBOLS, DEFAULT_SYMBOL), code)
