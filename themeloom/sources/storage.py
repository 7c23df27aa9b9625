"""Looking at folders and files through the Hadoop file system."""

from __future__ import annotations

import re

from pyspark.errors import AnalysisException
from pyspark.sql import SparkSession


def _at(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def exists(spark: SparkSession, path: str) -> bool:
    fs, where = _at(spark, path)
    return fs.exists(where)


def file_size(spark: SparkSession, path: str) -> int:
    fs, where = _at(spark, path)
    return fs.getFileStatus(where).getLen()


def children(spark: SparkSession, path: str) -> list[str]:
    """Names of the entries of a folder, sorted; empty if there is no folder."""
    fs, where = _at(spark, path)
    if not fs.exists(where):
        return []
    return sorted(s.getPath().getName() for s in fs.listStatus(where))


def make_folder(spark: SparkSession, path: str) -> None:
    fs, where = _at(spark, path)
    fs.mkdirs(where)


def delete(spark: SparkSession, path: str) -> None:
    """Remove a file or folder; one that is not there is no error."""
    fs, where = _at(spark, path)
    fs.delete(where, True)


def matching(spark: SparkSession, path: str, missing: bool = False) -> list[str]:
    """The folders or files that a path or path pattern stands for; an error, unless ``missing``, if there are none."""
    fs, where = _at(spark, path)
    found = [s.getPath().toString() for s in fs.globStatus(where) or []]
    if not found and not missing:
        raise AnalysisException(message=f"[PATH_NOT_FOUND] Path does not exist: {path}.")
    return found


def opened(path: str):
    """The Arrow file system that tasks open a path with, and the path within it."""
    from pyarrow import fs

    uri = as_uri(path)
    if uri.startswith("file://"):
        return fs.LocalFileSystem(), uri[len("file://"):]
    return fs.FileSystem.from_uri(uri)


def in_reach(spark: SparkSession, path: str) -> bool:
    """Whether tasks can open the path themselves; else only Spark's readers can."""
    fs, where = _at(spark, path)
    try:
        opened(fs.makeQualified(where).toString())
    except (OSError, ValueError, ImportError):
        return False
    return True


def as_uri(path: str) -> str:
    """A path as the URI that tasks open with the Arrow file systems."""
    if path.startswith("/"):
        return f"file://{path}"
    path = re.sub(r"^s3[an]:", "s3:", path)
    return re.sub(r"^file:/+", "file:///", path)
