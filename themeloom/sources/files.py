"""Whole files, for hand-over from and to tools that expect them: listed, read and written in tasks."""

from __future__ import annotations

import itertools
import os
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from themeloom.sources.storage import as_uri, matching, opened

# Names, and bytes of contents, that a task passes on at once.
NAMES_AT_ONCE = 10_000
BYTES_AT_ONCE = 4 << 20


def write_files(df: DataFrame, folder: str) -> int:
    """Write (name, content) rows as ``folder/name``; returns how many.

    Tasks write their own rows; a file written again by a repeated task has the
    same content.  ``name`` may contain folders.
    """
    uri = as_uri(folder)

    def save(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(uri)
        made: set[str] = set()
        for batch in batches:
            for name, content in zip(batch["name"], batch["content"]):
                path = f"{root}/{name}"
                parent = path.rsplit("/", 1)[0]
                if parent not in made:
                    store.create_dir(parent, recursive=True)
                    made.add(parent)
                with store.open_output_stream(path) as out:
                    out.write((content or "").encode("utf-8"))
            yield pd.DataFrame({"n": [len(batch)]})

    written = df.select("name", "content").mapInPandas(save, "n long").agg(F.sum("n").alias("n"))
    return written.first()["n"] or 0


def file_name(path: str = "path") -> Column:
    """The last part of a path."""
    return F.regexp_extract(path, "([^/]+)$", 1)


def _entries(store, folder: str, suffix: str) -> Iterator[tuple[str, int | None]]:
    """(path, size) of the files of a folder that end with ``suffix``, and (path, None) of its folders.

    A local folder is read entry by entry, so that it may have any number of them.
    """
    from pyarrow import fs

    if isinstance(store, fs.LocalFileSystem):
        with os.scandir(folder) as found:
            for entry in found:
                if entry.is_dir():
                    yield entry.path, None
                elif entry.name.endswith(suffix) and entry.is_file():
                    yield entry.path, entry.stat().st_size
        return
    for entry in store.get_file_info(fs.FileSelector(folder)):
        if entry.type == fs.FileType.Directory:
            yield entry.path, None
        elif entry.base_name.endswith(suffix):
            yield entry.path, entry.size


def _unlisted(folder: str) -> bool:
    """Whether Spark's listing passes over a folder below the one that it was given."""
    name = folder.rsplit("/", 1)[-1]
    if name.startswith(("_metadata", "_common_metadata")):
        return False
    return name.startswith(".") or (name.startswith("_") and "=" not in name) or name.endswith("._COPYING_")


def list_files(
    spark: SparkSession, folder: str, suffix: str, deep: bool = False, missing: bool = False
) -> DataFrame:
    """(path, size) of the files of a folder that end with ``suffix``; none of them is opened.

    With ``deep`` those of folders below come as well, but not of folders that Spark passes
    over.  One task lists the folder, others the folders directly below, and no name
    passes through the driver.  ``missing`` takes no folder for an empty one.
    """
    from pyarrow import fs

    found = matching(spark, folder, missing)
    roots = [opened(p)[1] for p in found]
    uri = (found or [folder])[0]

    def walk(paths: list[str], levels: int) -> Iterator[tuple[str, int | None]]:
        """Files of folders and so many levels of folders below; what is below these, as folders."""
        store, _ = opened(uri)
        left = [(p, levels) for p in paths]
        while left:
            at, more = left.pop()
            info = store.get_file_info(at)
            if info.type != fs.FileType.Directory:
                yield at, info.size
                continue
            for path, size in _entries(store, at, suffix):
                if size is not None:
                    yield path, size
                elif deep and not _unlisted(path):
                    if more:
                        left.append((path, more - 1))
                    else:
                        yield path, None

    arrow = pa.schema([("path", pa.string()), ("size", pa.int64())])

    def told(rows: Iterator[tuple[str, int | None]]) -> Iterator[pa.RecordBatch]:
        for part in itertools.batched(rows, NAMES_AT_ONCE):
            yield pa.record_batch(list(zip(*part)), schema=arrow)

    def top(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _ in batches:
            yield from told(walk(roots, 0))

    def below(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            folders = batch.filter(batch.column("size").is_null())
            yield batch.filter(batch.column("size").is_valid())
            yield from told(walk(folders.column("path").to_pylist(), 1 << 30))

    schema = "path string, size bigint"
    listed = spark.range(0, 1, 1, 1).mapInArrow(top, schema)
    if not deep:
        return listed
    return listed.repartition(spark.sparkContext.defaultParallelism, "path").mapInArrow(below, schema)


def read_files(files: DataFrame, folder: str) -> DataFrame:
    """(path, value) of files listed below a folder, each file whole.

    They are dealt out by path and opened one after another by the tasks.
    """
    spark = files.sparkSession
    uri = (matching(spark, folder, True) or [folder])[0]

    arrow = pa.schema([("path", pa.string()), ("value", pa.binary())])

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = opened(uri)
        for batch in batches:
            paths, values, size = [], [], 0
            for path in batch.column("path").to_pylist():
                with store.open_input_stream(path, compression=None) as stream:
                    values.append(stream.read())
                paths.append(path)
                size += len(values[-1])
                if size >= BYTES_AT_ONCE:
                    yield pa.record_batch([paths, values], schema=arrow)
                    paths, values, size = [], [], 0
            yield pa.record_batch([paths, values], schema=arrow)

    read = files.select("path").repartition("path").mapInArrow(load, "path string, value binary")
    return read.select("path", F.col("value").cast("string").alias("value"))
