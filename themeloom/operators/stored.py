"""Vectors stored in blocks by cell, which tasks read from the shared folder themselves.

A comparison of all with all reads every block many times.  Moved through a shuffle, the
rows would be written as often; read in place they are written once.
"""

from __future__ import annotations

import itertools
import uuid
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from themeloom.functions.blocks import matrix
from themeloom.operators.scale import spread
from themeloom.session import scratch_path
from themeloom.sources.storage import opened

# Bytes of vectors that a task sorts and stores in one file.
FILE_BYTES = 64 << 20


@dataclass(frozen=True)
class Block:
    """Rows of one cell in a file: their number, and their least and largest gap to the cell's center."""

    path: str
    number: int
    cell: int
    rows: int
    lo: float
    hi: float


def store_blocks(
    rows: DataFrame, label: str, most: int, place: Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]]
) -> list[Block]:
    """Store ``rows`` by cell in blocks of at most ``most`` rows; returns the blocks.

    ``place`` tells the cell of each vector and its gap.  Vectors that single precision
    holds exactly are stored in it.  Files of a task that failed are not among the blocks.
    """
    spark = rows.sparkSession
    folder = scratch_path(spark, label)
    told = pa.schema([("path", pa.string()), ("number", pa.int32()), ("cell", pa.int32()), ("rows", pa.int64()),
                      ("lo", pa.float64()), ("hi", pa.float64())])

    def save(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(batches).combine_chunks()
        x = matrix(table.column("embedding"))
        cell, gap = place(x)
        order = np.argsort(cell, kind="stable")
        cell, gap, x = cell[order], gap[order], x[order]
        with np.errstate(over="ignore"):
            single = x.astype(np.float32)
        flat = pa.array((single if np.array_equal(single, x) else x).ravel())
        table = table.drop_columns(["embedding"]).take(pa.array(order)) \
            .append_column("embedding", pa.FixedSizeListArray.from_arrays(flat, x.shape[1])).combine_chunks()
        store, root = opened(folder)
        store.create_dir(root, recursive=True)
        path = f"{root}/{uuid.uuid4().hex}.arrow"
        starts = np.flatnonzero(np.diff(cell, prepend=-1))
        parts = [(a, min(a + most, b)) for s, b in itertools.pairwise([*starts, len(cell)]) for a in range(s, b, most)]
        with store.open_output_stream(path) as out, pa.ipc.new_file(out, table.schema) as writer:
            for a, b in parts:
                writer.write_table(table.slice(a, b - a), max_chunksize=most)
        return pa.record_batch([
            [path] * len(parts), list(range(len(parts))), [int(cell[a]) for a, _ in parts], [int(b - a) for a, b in parts],
            [float(gap[a:b].min()) for a, b in parts], [float(gap[a:b].max()) for a, b in parts]], schema=told)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                size += 8 * len(batch.column("embedding").flatten())
            if size >= FILE_BYTES:
                yield save(held)
                held, size = [], 0
        if held:
            yield save(held)

    ddl = "path string, number int, cell int, rows bigint, lo double, hi double"
    # A row for each cell and file: small beside the vectors.
    return [Block(**r) for r in spread(rows).mapInArrow(run, ddl).toArrow().to_pylist()]


def read_blocks(folder: str, blocks: Iterable[Block], most: int) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Rows of blocks and their vectors, several blocks together up to about ``most`` rows."""
    store, _ = opened(folder)
    held, vectors, n = [], [], 0
    for path, own in itertools.groupby(sorted(blocks, key=lambda b: (b.path, b.number)), key=lambda b: b.path):
        with store.open_input_file(path) as source:
            reader = pa.ipc.open_file(source)
            for block in own:
                batch = reader.get_batch(block.number)
                vectors.append(matrix(batch.column("embedding")))
                held.append(batch.drop_columns(["embedding"]))
                n += block.rows
                if n >= most or n * vectors[0].itemsize * vectors[0].shape[1] >= FILE_BYTES:
                    yield pa.Table.from_batches(held).combine_chunks(), np.concatenate(vectors)
                    held, vectors, n = [], [], 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks(), np.concatenate(vectors)


def read_all(folder: str, blocks: Iterable[Block]) -> tuple[pa.Table, np.ndarray]:
    """All rows of blocks and their vectors at once."""
    parts = list(read_blocks(folder, blocks, 1 << 62))
    return pa.concat_tables([t for t, _ in parts]).combine_chunks(), np.concatenate([x for _, x in parts])


def packed(blocks: Iterable[Block], most: int) -> Iterator[list[Block]]:
    """Blocks that follow one another by cell, as many together as hold at most ``most`` rows."""
    held: list[Block] = []
    n = 0
    for block in sorted(blocks, key=lambda b: (b.cell, b.path, b.number)):
        if held and n + block.rows > most:
            yield held
            held, n = [], 0
        held.append(block)
        n += block.rows
    if held:
        yield held


def in_tasks(spark, units: list, work, schema) -> DataFrame:
    """``work`` on each unit, in a task each; units are sent to the tasks, so they are to be small."""
    sent = spark.sparkContext.broadcast(units)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in batch.column(0).to_pylist():
                yield from work(sent.value[i])

    return spark.range(0, len(units), 1, max(1, len(units))).mapInArrow(run, schema)
