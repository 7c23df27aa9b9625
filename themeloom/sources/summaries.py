"""Reading summary documents."""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from themeloom.sources.drafts import decoded
from themeloom.sources.files import file_name, list_files, read_files

SUFFIX = ".md"
# Fixed value: file sources pass over names that start like this.
HIDDEN = ("_", ".")
# Signs of a name that a path pattern would read as its own.
GLOB_SIGN = re.compile(r"[\\*?\[\]{},]")


def read_summaries(spark: SparkSession, folder: str, only: Sequence[str] | None = None) -> DataFrame:
    """(file_name, content) of every Markdown file, each file whole.

    Tasks list and open the files.  With ``only``, of the ordinary files just those names
    are opened; hidden and empty ones come as well.  Rows carry no order; sort by
    ``file_name`` where the order matters.
    """
    listed = list_files(spark, folder, SUFFIX, missing=only is not None)
    if only is not None:
        listed = listed.where(~_ordinary())
    found = read_files(listed, folder).select(file_name().alias("file_name"), F.col("value").alias("content"))
    if only:
        named = spark.read.text([f"{folder}/{GLOB_SIGN.sub(r'\\\g<0>', n)}" for n in only], wholetext=True)
        found = found.unionByName(
            named.select(decoded(F.col("_metadata.file_name")).alias("file_name"), F.col("value").alias("content")))
    # Every line end counts as a line feed.
    return found.withColumn("content", F.regexp_replace("content", "\r\n?", "\n"))


def summary_names(spark: SparkSession, folder: str) -> DataFrame:
    """(file_name) of the ordinary Markdown files; none of them is opened."""
    return list_files(spark, folder, SUFFIX).where(_ordinary()).select(file_name().alias("file_name"))


def _ordinary() -> Column:
    """Whether a listed file is neither hidden nor empty."""
    hidden = [file_name().startswith(h) for h in HIDDEN]
    return (F.col("size") > 0) & ~reduce(or_, hidden)
