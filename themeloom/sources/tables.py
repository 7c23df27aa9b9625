"""Writers: merged records, dated feeds, versioned snapshots and collections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from themeloom.operators.universe import new_keys
from themeloom.sources.storage import children, delete, exists

MAX_RECORDS_PER_FILE = 5_000_000
# Versions that stay readable, and the column of a version laid out by key.
KEPT_VERSIONS = 2
BUCKET = "_bucket"
META = "total bigint, collected_at timestamp, last_batch bigint, buckets int"


def write_merged(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """One record per code, replacing what is there.

    The merge leaves rows distributed by code, so sorting within the tasks is
    enough to keep a code's neighbours together in the files.
    """
    writer = df.sortWithinPartitions("code").write.mode("overwrite").option(
        "maxRecordsPerFile", MAX_RECORDS_PER_FILE
    )
    writer.format(fmt).save(path)


def stored_dates(spark: SparkSession, path: str) -> list[str]:
    """Dates of a dated table, from its folder names; one entry per calendar day."""
    return [c.split("=", 1)[1] for c in children(spark, path) if c.startswith("date=")]


def write_by_date(df: DataFrame, path: str, force: bool = False, parts: bool = False) -> None:
    """Add the dates of ``df`` to a table partitioned by date.

    Dates already there are skipped or, with ``force``, replaced.  With ``parts``
    the table is partitioned by the column ``part`` as well, so that a part can be
    replaced by itself.  A busy date is split over several tasks and files, small
    ones share a task.
    """
    spark = df.sparkSession
    if not force:
        have = stored_dates(spark, path)
        if have:
            df = df.where(~F.col("date").cast("string").isin(have))
    keys = ["date", "part"] if parts else ["date"]
    writer = df.hint("rebalance", *keys).write.partitionBy(*keys).option(
        "maxRecordsPerFile", MAX_RECORDS_PER_FILE
    )
    if force:
        writer.mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)
    else:
        writer.mode("append").parquet(path)


def read_by_date(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A dated table, empty if nothing was written yet."""
    if not stored_dates(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(path)


def _number(version: str) -> int:
    return int(version.split("=", 1)[1])


def _next_version(spark: SparkSession, path: str) -> str:
    taken = [v for v in children(spark, path) if v.startswith("v=")]
    return f"{path}/v={_number(taken[-1]) + 1 if taken else 1:09d}"


def _latest(spark: SparkSession, path: str, marker: str) -> str | None:
    """The newest version that was written completely."""
    for v in reversed([c for c in children(spark, path) if c.startswith("v=")]):
        if exists(spark, f"{path}/{v}/{marker}/_SUCCESS"):
            return f"{path}/{v}"
    return None


def expire_versions(spark: SparkSession, path: str, marker: str, keep: int = KEPT_VERSIONS) -> list[str]:
    """Drop versions older than the last ``keep`` complete ones; returns the folders of those.

    A reader keeps the version it began with until ``keep`` newer ones are complete.
    A version after the last complete one may be in the making and stays.
    """
    versions = [c for c in children(spark, path) if c.startswith("v=")]
    complete = [v for v in versions if exists(spark, f"{path}/{v}/{marker}/_SUCCESS")][-keep:]
    for v in versions:
        if complete and v < complete[0]:
            delete(spark, f"{path}/{v}")
    return [f"{path}/{v}" for v in complete]


def bucket_of(key: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def write_snapshot(
    df: DataFrame, path: str, at: Column | None = None, last_batch: int = -1, key: str | None = None,
    buckets: int = 1, beside: dict[str, DataFrame] | None = None,
) -> str:
    """Store a feed as a new version; returns its folder.

    The totals are written after the items, and readers see a version only once
    its totals are committed.  A job lost half-way leaves the old version valid.
    With ``key`` the items are laid out in ``buckets`` by a hash of it.  ``beside``
    names further small tables of the version.  Older versions stay until
    :func:`expire_versions`.
    """
    spark = df.sparkSession
    folder = _next_version(spark, path)
    writer = df.write
    if key is not None:
        placed = df.withColumn(BUCKET, bucket_of(F.col(key), buckets)).hint("rebalance", BUCKET)
        writer = placed.write.partitionBy(BUCKET)
    writer.option("maxRecordsPerFile", MAX_RECORDS_PER_FILE).parquet(f"{folder}/items")
    for name, table in (beside or {}).items():
        table.write.parquet(f"{folder}/{name}")
    items = spark.read.schema(df.schema).parquet(f"{folder}/items")
    items.agg(F.count("*").alias("total")).select(
        "total",
        (F.current_timestamp() if at is None else at).alias("collected_at"),
        F.lit(last_batch).cast("bigint").alias("last_batch"),
        F.lit(0 if key is None else buckets).alias("buckets"),
    ).write.parquet(f"{folder}/meta")
    return folder


def read_snapshot(spark: SparkSession, path: str) -> DataFrame | None:
    """The items of the latest complete version, or none."""
    folder = _latest(spark, path, "meta")
    return spark.read.parquet(f"{folder}/items").drop(BUCKET) if folder else None


def read_buckets(spark: SparkSession, path: str, keys: DataFrame) -> DataFrame | None:
    """The items of the latest complete version whose bucket holds one of ``keys`` (one column)."""
    folder = _latest(spark, path, "meta")
    if folder is None:
        return None
    items = spark.read.parquet(f"{folder}/items")
    buckets = version_meta(spark, folder).first()["buckets"]
    if not buckets:
        return items
    # As many numbers as the snapshot has buckets at most.
    touched = keys.select(bucket_of(F.col(keys.columns[0]), buckets).alias("b")).distinct().collect()
    return items.where(F.col(BUCKET).isin([r["b"] for r in touched])).drop(BUCKET)


def beside_snapshot(spark: SparkSession, path: str, name: str) -> DataFrame | None:
    """A further table of the latest complete version, or none."""
    folder = _latest(spark, path, "meta")
    return spark.read.parquet(f"{folder}/{name}") if folder and exists(spark, f"{folder}/{name}") else None


def version_meta(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(META).parquet(f"{folder}/meta")


def snapshot_meta(spark: SparkSession, path: str) -> DataFrame | None:
    """(total, collected_at, last_batch, buckets) of the latest complete version."""
    folder = _latest(spark, path, "meta")
    return version_meta(spark, folder) if folder else None


def one_per_id(df: DataFrame, key: str, order: str) -> DataFrame:
    """One row per id, the one with the smallest ``order``."""
    w = Window.partitionBy(key).orderBy(order)
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def read_collection(spark: SparkSession, path: str) -> DataFrame | None:
    """The rows of the latest complete version of a collection, or none."""
    folder = _latest(spark, path, "rows")
    return spark.read.parquet(f"{folder}/rows") if folder else None


def write_collection(
    df: DataFrame, path: str, mode: str = "overwrite", key: str = "id", order: str | None = None
) -> None:
    """Store a vector collection; ``append`` adds unseen ids to the latest version.

    With ``order`` one row per id is kept, the smallest, and the column dropped.
    An overwrite becomes a new version, visible when it is complete; the one before
    stays for its readers, older ones go.  A Bloom filter on the id lets lookups skip
    files that cannot hold it.
    """
    if mode not in ("overwrite", "append"):
        raise ValueError("mode must be overwrite or append")
    spark = df.sparkSession
    rows = df if order is None else one_per_id(df, key, order)
    if order not in (None, key):
        rows = rows.drop(order)
    current = _latest(spark, path, "rows") if mode == "append" else None
    if current:
        rows = new_keys(rows, spark.read.parquet(f"{current}/rows"), key)
    folder = current or _next_version(spark, path)
    rows.write.mode("append").option(f"parquet.bloom.filter.enabled#{key}", "true").option(
        "maxRecordsPerFile", MAX_RECORDS_PER_FILE
    ).parquet(f"{folder}/rows")
    expire_versions(spark, path, "rows")


def collection_stats(spark: SparkSession, documents: str, keywords: str) -> DataFrame:
    """(collection, n): document and keyword counts; a missing table counts 0."""
    counts = None
    for name, path in (("documents", documents), ("keywords", keywords)):
        rows = read_collection(spark, path)
        if rows is not None:
            one = rows.agg(F.count("*").alias("n"))
        else:
            one = spark.range(1).select(F.lit(0).cast("bigint").alias("n"))
        one = one.select(F.lit(name).alias("collection"), "n")
        counts = one if counts is None else counts.unionByName(one)
    return counts
