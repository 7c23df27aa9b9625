"""Connected components of a large set of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from themeloom.session import materialize


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node, component`` of every node that has a link; the component is its least node.

    Links are moved, in turn, to the least neighbour of their larger and of their
    smaller ends, until they are stars.  A node with very many links is reduced to its
    least neighbour in every task before the shuffle.  Links may repeat and point both
    ways; links of a node to itself and links without an end are left out.
    """
    edges = materialize(
        links.where(F.col(a) != F.col(b))
        .select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), "links")
    state = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        # Larger neighbours move to the least one.
        large = (
            both.where("v > u").join(least, "u")
            .select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        )
        # Then smaller neighbours, with the node itself.
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        edges = materialize(
            large.join(down, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v")
            .unionByName(down.select("u", F.col("m").alias("v"))).distinct(), "links")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state:
            break
        state = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
