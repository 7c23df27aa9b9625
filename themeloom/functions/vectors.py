"""Distances between ``ARRAY<DOUBLE>`` columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

METRICS = ("l2sq", "l2", "cosine")
# Fixed value: keeps a cosine defined when a vector is all zero.
EPSILON = 1e-8


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x)


def dot(a: Column, b: Column) -> Column:
    return _total(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def norm(a: Column) -> Column:
    return F.sqrt(_total(F.transform(a, lambda x: x.cast("double") * x.cast("double"))))


def squared_gap(a: Column, b: Column) -> Column:
    """Squared Euclidean distance, summed in element order."""
    return _total(
        F.zip_with(
            a, b,
            lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")),
        )
    )


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (norm(a) * norm(b) + F.lit(EPSILON))


def distance(a: Column, b: Column, metric: str = "l2sq") -> Column:
    if metric == "l2sq":
        return squared_gap(a, b)
    if metric == "l2":
        return F.sqrt(squared_gap(a, b))
    if metric == "cosine":
        return F.lit(1.0) - cosine(a, b)
    raise ValueError(f"metric must be one of {METRICS}, not {metric!r}")


def score(d: Column) -> Column:
    """Similarity in (0, 1] from a distance."""
    return F.round(F.lit(1.0) / (F.lit(1.0) + d), 4)

