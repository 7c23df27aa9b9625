"""Feeds kept current from files as they land."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from themeloom.operators import feeds
from themeloom.session import materialize
from themeloom.sources import feeds as landed
from themeloom.sources import state as store
from themeloom.sources import tables
from themeloom.sources.drafts import decoded


def stream_feed(
    spark: SparkSession, landing: str, state: str, kind: str, files_per_batch: int | None = None,
    progress: str | None = None,
) -> None:
    """Take in all files that landed since the last run, then stop.

    Each micro-batch is reduced to one row per key and stored as a delta of its
    own, so its cost follows the batch and not the table.  Running a batch again
    rewrites the same delta.  Movers go to a partition per date and part.  Notes are
    paged by run, as ``run-3.json`` or ``3.json``; pages beyond a bad or a last page do not
    count, in whatever order the files arrive.
    ``progress`` is the checkpoint folder, one per feed by default; with a fresh
    one the landed files are taken in again, as new deltas.
    """
    progress = progress or f"{state}/progress/{kind}"
    source = (
        spark.readStream.format("text").option("wholetext", "true")
        .option("pathGlobFilter", "*.json").schema("value string")
    )
    if files_per_batch:
        source = source.option("maxFilesPerTrigger", files_per_batch)
    files = source.load(landing).select(
        F.regexp_extract(decoded(F.col("_metadata.file_name")), r"(.+)\.json$", 1).alias("name"), "value"
    )

    def take(batch: DataFrame, batch_id: int) -> None:
        judged = landed.judge(batch, kind)
        if kind == "action":
            rows = feeds.flatten_actions(landed.usable(judged, kind)).withColumn("part", feeds.part_of(F.col("field_pos")))
            tables.write_by_date(rows, f"{state}/action", force=True, parts=True)
            return
        # The checkpoint names its stream, whatever session runs it.
        run = spark.read.json(f"{progress}/metadata").first()["id"]
        number = store.number_of(spark, f"{state}/{kind}", run, batch_id)
        if number is None:
            return
        if kind == "industry":
            # Parsed once, for the rows and for what the pages say of their run.
            pages = materialize(landed.pages_of(judged).withColumn(
                "run", F.concat(F.lit(f"{run}/"), "run")), "pages").where(F.col("page").isNotNull())
            rows = feeds.flatten_industry(pages.where("good"))
            store.append_delta(
                rows, f"{state}/{kind}", kind, number, pages=pages.select("run", "page", "good", "last"))
        else:
            store.append_delta(feeds.flatten_timeline(landed.usable(judged, kind)), f"{state}/{kind}", kind, number)

    query = (
        files.writeStream.foreachBatch(take)
        .option("checkpointLocation", progress)
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()


def read_state(spark: SparkSession, state: str, kind: str) -> DataFrame | None:
    """A streamed feed as of now."""
    return store.read_state(spark, f"{state}/{kind}", kind)


def compact(spark: SparkSession, state: str, kind: str) -> DataFrame | None:
    """Fold the deltas of a streamed feed into a new snapshot version."""
    return store.compact(spark, f"{state}/{kind}", kind)
