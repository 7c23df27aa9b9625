"""Shards by proportional stratified interleaving.

Rows of a source are shuffled by a seeded hash and ranked; the rank as a fraction of the
source's rows is where the row belongs between 0 and 1.  All rows sorted by their fraction
run through every source at its own pace, so any stretch of them has the mixture of the
whole.  The order is cut into shards whose numbers of rows differ by one at most (law
``rows``).  A source's first fraction is a seeded hash of the source, so that sources of few
rows do not meet at one place.

Both sorts are range sorts over all tasks: a row's rank is its place in its partition and
the number of rows before that partition, which comes from a table of counts per partition
and source.  No task holds a source, however many rows it has; rows that repeat are told
apart by where they were read, so they are no hot key either.

Defined results: a null source is a source of its own; a null text has no bytes; equal texts
go with their sources, since a group of copies may be larger than a shard; rows that
repeat are rows of their own; an empty table gives no rows.  Columns other than those asked
for are left aside.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from themeloom.operators.scale import checked_broadcast
from themeloom.session import materialize

SHARDS = 24
SEED = 1
LAW = "rows"
# Place within a partition in the ids that Spark numbers rows with.
PLACE = (1 << 33) - 1


def _sorted_over_all(df: DataFrame, order: Sequence[str], label: str) -> DataFrame:
    """``df`` in order, with the number of the partition and the place in it; written once."""
    return materialize(
        df.repartitionByRange(*order).sortWithinPartitions(*order)
        .withColumn("_part", F.spark_partition_id())
        .withColumn("_at", F.monotonically_increasing_id().bitwiseAND(F.lit(PLACE))), label)


def _phase(source: Column, seed: int) -> Column:
    """Where in the first step between two of its rows a source begins."""
    named = F.concat(F.lit(f"{seed}:"), F.coalesce(F.concat(F.lit("s"), source.cast("string")), F.lit("")))
    return (F.conv(F.substring(F.sha2(named, 256), 1, 8), 16, 10).cast("double") + 0.5) / float(1 << 32)


def assign(
    rows: DataFrame, n_shards: int = SHARDS, source_col: str = "source", key: Sequence[str] = ("doc_id", "text"),
    keep: Sequence[str] = ("doc_id", "text"), seed: int = SEED,
) -> DataFrame:
    """The columns ``keep``, ``shard`` (0 to ``n_shards`` - 1) and ``slot`` (gapless from 0) of every row.

    The shuffle depends on ``seed`` and the columns ``key``.  All of ``keep`` is moved
    twice, so heavy columns are better joined afterwards.
    """
    held = [F.col(c).alias(f"_k{i}") for i, c in enumerate(keep)]
    names = [f"_k{i}" for i in range(len(keep))]
    drawn = rows.select(
        *held, F.col(source_col).alias("_source"), F.xxhash64(F.lit(seed), *key).alias("_drawn"),
        F.xxhash64(*key, F.lit(seed)).alias("_again"), F.monotonically_increasing_id().alias("_read"))
    shuffled = _sorted_over_all(drawn, ["_source", "_drawn", "_again", "_read"], "shuffled")
    earlier = Window.partitionBy("_source").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    counts = (
        shuffled.groupBy("_part", "_source").agg(F.count("*").alias("n"), F.min("_at").alias("_from"))
        .select(
            F.col("_part").alias("_p"), F.col("_source").alias("_s"), "_from",
            F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("_before"),
            F.sum("n").over(Window.partitionBy("_source")).alias("_rows"))
    )
    ranked = shuffled.join(
        checked_broadcast(materialize(counts, "ranks")),
        (F.col("_part") == F.col("_p")) & F.col("_source").eqNullSafe(F.col("_s")))
    fraction = (F.col("_before") + F.col("_at") - F.col("_from") + _phase(F.col("_source"), seed)) / F.col("_rows")
    interleaved = _sorted_over_all(
        ranked.select(*names, "_source", fraction.alias("_fraction")), ["_fraction", "_source"], "interleaved")
    # As many rows as partitions.
    counts = materialize(interleaved.groupBy("_part").agg(F.count("*").alias("n")), "places")
    running = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(F.col("_part").alias("_p"), "n").select(
        "_p", F.coalesce(F.sum("n").over(running), F.lit(0)).alias("_before"))
    total = counts.agg(F.sum("n")).first()[0] or 0
    placed = interleaved.join(checked_broadcast(offsets), F.col("_part") == F.col("_p")).select(
        *names, (F.col("_before") + F.col("_at")).alias("_place"))
    # Whole-number division; places times shards stay far below 2^63.
    cut = placed.withColumn("shard", F.expr(f"int(_place * {n_shards} div {max(total, 1)})"))
    start = F.expr(f"(shard * {total}L + {n_shards - 1}) div {n_shards}")
    return cut.select(
        *[F.col(n).alias(c) for n, c in zip(names, keep)], "shard", (F.col("_place") - start).alias("slot"))


def write(assigned: DataFrame, path: str) -> None:
    """One folder for each shard, its files in the order of slots.

    Rows are cut by range of (shard, slot), so a shard larger than a task is several files.
    """
    order = ["shard", "slot"]
    assigned.repartitionByRange(*order).sortWithinPartitions(*order).write.partitionBy("shard").parquet(path)


def size_of(text: Column) -> Column:
    """Bytes of a text and of its id."""
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 8).cast("long")
