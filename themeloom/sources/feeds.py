"""Reading landed feed responses."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from themeloom.operators.scale import once
from themeloom.schemas import ENVELOPES
from themeloom.sources.drafts import decoded

# Fixed value: the error code of a good answer.
NO_ERROR = "0"
# The date a response is named by and the number of its part, or its page.
DATE_OF = "try_cast(substring(name, 1, 10) AS DATE)"
# A page is named by its number, behind the name of its run if there are several.
RUN_OF = "regexp_extract(name, '^(.*)-[0-9]+$', 1)"
PAGE_OF = "try_cast(nullif(regexp_extract(name, '^(?:.*-)?([0-9]+)$', 1), '') AS INT)"
PART_OF = "try_cast(nullif(regexp_extract(name, '_([0-9]+)$', 1), '') AS INT)"


def landed(spark: SparkSession, path: str, start: str = "") -> DataFrame:
    """(name, value) of the landed JSON files, whole; ``name`` is the file stem.

    Only files whose name begins with ``start`` are listed.
    """
    return (
        spark.read.option("pathGlobFilter", f"{start}*.json").text(path, wholetext=True)
        .select(
            F.regexp_extract(decoded(F.col("_metadata.file_name")), r"(.+)\.json$", 1).alias("name"),
            "value",
        )
    )


def judge(envelopes: DataFrame, kind: str) -> DataFrame:
    """Parse envelopes (name, value) and say in ``reason`` why one is no good.

    Movers are named by date, as in 2024-01-31 or, in parts, 2024-01-31_2, and
    need data; notes and events are named by page number and need error code 0.
    """
    parsed = once(envelopes, "e", F.from_json("value", ENVELOPES[kind].simpleString()))
    data, code = F.col("e.data"), F.col("e.errCode")
    unreadable = F.col("e").isNull() | (code.isNull() & data.isNull())
    reason = F.when(unreadable, "unreadable")
    if kind == "action":
        reason = reason.when(data.isNull() | (F.size(data) == 0), "no data")
        reason = reason.when(F.expr(DATE_OF).isNull(), "no date")
    else:
        reason = reason.when(F.coalesce(code, F.lit("")) != NO_ERROR, "error code")
        reason = reason.when(data.isNull(), "no data")
        reason = reason.when(F.expr(PAGE_OF).isNull(), "no page")
    return parsed.withColumn("reason", reason)


def pages_of(judged: DataFrame) -> DataFrame:
    """(run, page, data, good, last) of judged pages."""
    return judged.select(
        F.expr(RUN_OF).alias("run"), F.expr(PAGE_OF).alias("page"), F.col("e.data").alias("data"),
        F.col("reason").isNull().alias("good"), (~F.coalesce(F.col("e.data.hasNext"), F.lit(False))).alias("last"))


def usable(judged: DataFrame, kind: str) -> DataFrame:
    """(date, part, data) of valid mover envelopes, or (page, data) of the other feeds.

    Notes are paged: those of a run end before a bad page, and with the page that
    says it is the last.
    """
    if kind == "action":
        return judged.where("reason is null").select(
            F.expr(DATE_OF).alias("date"),
            F.coalesce(F.expr(PART_OF), F.lit(0)).alias("part"),
            F.col("e.data").alias("data"),
        )
    if kind != "industry":
        return judged.where("reason is null").select(F.expr(PAGE_OF).alias("page"), F.col("e.data").alias("data"))
    pages = pages_of(judged)
    bad = F.min(F.when(~F.col("good"), F.col("page")))
    last = F.min(F.when(F.col("last"), F.col("page") + 1))
    ends = pages.groupBy("run").agg(F.least(bad, last).alias("end"))
    within = F.col("page") < F.coalesce("end", F.lit(2**31 - 1))
    return pages.join(ends, "run").where(within & F.col("good")).select("page", "data")


def read_feed(
    spark: SparkSession, path: str, kind: str, start: str = ""
) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejects) of the files landed for one run."""
    judged = judge(landed(spark, path, start), kind)
    rejects = judged.where(F.col("reason").isNotNull()).select("name", "value", "reason")
    return usable(judged, kind), rejects
