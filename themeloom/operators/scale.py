"""Building blocks that keep joins and windows even when one key dominates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from themeloom.session import materialize
from themeloom.sources.storage import file_size

# A side is broadcast only if it was counted and found no larger than this.
BROADCAST_ROWS = 200_000


# A scan is spread over the cores before heavy work if it is at least this large,
# so that there is something to share, and below the second size per core.
WORTH_SHARING = 2 << 20
SMALL_SCAN = 128 << 20


def once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Add a column whose value is computed once per row.

    The optimizer copies an expression into every filter on it that it pushes
    down.  It does not push filters through a generator, so a one-element explode
    keeps costly parsing from being repeated.
    """
    return df.select("*", F.explode_outer(F.array(value)).alias(name))


def spread(df: DataFrame) -> DataFrame:
    """``df`` over all cores, if it reads only a few small files.

    A file with one row group is one task, however many cores wait.  Tables of
    any size worth the name have files enough and stay as they are.
    """
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    # Counted in the JVM, since a large table may have very many files.
    files = df._jdf.inputFiles()
    if not 0 < len(files) < cores:
        return df
    size = sum(file_size(spark, f) for f in files)
    if not WORTH_SHARING <= size <= cores * SMALL_SCAN:
        return df
    return df.repartition(cores)


def distinct_keys(df: DataFrame, *keys: str) -> bool:
    """Whether no key is null and none comes twice; only the keys are moved."""
    odd = F.col("_n") > 1
    for key in keys:
        odd = odd | F.col(key).isNull()
    return df.groupBy(*keys).agg(F.count("*").alias("_n")).where(odd).isEmpty()


def fits(df: DataFrame, max_rows: int) -> bool:
    """Whether ``df`` has at most ``max_rows`` rows, reading no more than needed."""
    return df.limit(max_rows + 1).count() <= max_rows


def checked_broadcast(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if its counted size allows it.

    Beyond the bound the join stays a shuffle join, which adaptive execution
    splits where a key is skewed.
    """
    return F.broadcast(df) if fits(df, max_rows) else df


def running_max(df: DataFrame, key: str, seq: str, value: str, out: str) -> DataFrame:
    """Largest ``value`` of the same key at a strictly smaller ``seq``.

    ``seq`` is an integer, unique within a key.  Rows are cut into ranges of (key,
    ``seq``) that hold equal numbers of rows, so neither a key with a third of all rows
    nor a burst of close numbers makes a large task.  The maxima of the earlier ranges of
    a key come from a reduced table with one row for each key and range.
    """
    # Written once, with the range that each row fell into.
    ranged = materialize(
        df.repartitionByRange(key, seq).withColumn("_slice", F.spark_partition_id()), "ranges")
    by_slice = Window.partitionBy(key).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    earlier = (
        ranged.groupBy(key, "_slice").agg(F.max(value).alias("_top"))
        .select(
            F.col(key).alias("_key"), F.col("_slice").alias("_at"),
            F.max("_top").over(by_slice).alias("_earlier"),
        )
    )
    within = (
        Window.partitionBy(key, "_slice").orderBy(seq)
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    return (
        ranged.join(
            earlier,
            F.col(key).eqNullSafe(F.col("_key")) & (F.col("_slice") == F.col("_at")),
            "left",
        )
        .withColumn(out, F.greatest(F.max(value).over(within), F.col("_earlier")))
        .drop("_key", "_at", "_slice", "_earlier")
    )
