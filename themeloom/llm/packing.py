"""Best-fit packing of token sequences by bin completion.

Lengths are whole numbers up to the capacity, so a corpus is, for this purpose, how many
pieces there are of each length: at most ``capacity`` numbers whatever its size.  Branch
and bound works on these.  The largest length left opens a sequence; the undominated ways
to fill it are tried, the least waste first, and each is repeated as often as the pieces
allow.  A branch is left when its waste shows that it cannot beat the best packing known,
which starts as best-fit decreasing.  The search ends at a lower bound or after ``nodes``
branchings; the best packing so far is then used.

The packing is a list of patterns.  Every piece gets its rank among the pieces of its
length (a count per task and the sums of the tasks before), and rank and pattern give its
sequence and place.  Pieces never meet in one task or in the driver.

Defined results: a null text is an empty text; an empty text is one piece with only the
end token; longer documents are cut every ``capacity`` tokens; repeated rows are packed
each; other columns are left aside; an empty table gives an empty table.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from themeloom.llm.bpe import _id_type, codec, vocabulary
from themeloom.session import materialize

CAPACITY = 2048
END_TOKEN = 0
# Branchings of the search, and fillings tried at each.
NODES = 4_000
WIDTH = 6

# A pattern: lengths with how many of each in a sequence, and how many such sequences.
Pattern = tuple[tuple[tuple[int, int], ...], int]


def lower_bound(counts: np.ndarray) -> int:
    """Sequences that any packing needs: by total, and by pieces too large to share."""
    size = len(counts) - 1
    lengths = np.arange(size + 1)
    number, total = np.cumsum(counts), np.cumsum(counts * lengths)
    best = math.ceil(int(total[-1]) / size) if size else 0
    half = size // 2
    for k in range(half + 1):
        # Larger than size - k: alone.  Above half: one each, with room for those from k on.
        alone = int(number[size] - number[size - k])
        one = int(number[size - k] - number[half])
        held = int(total[size - k] - total[half])
        small = int(total[half] - (total[k - 1] if k else 0))
        best = max(best, alone + one + max(0, math.ceil((small - (one * size - held)) / size)))
    return best


def best_fit(counts: np.ndarray) -> list[Pattern]:
    """Best-fit decreasing, many equal pieces at a time."""
    size = len(counts) - 1
    open_: dict[int, list[list]] = {}
    done: list[Pattern] = []
    for length in range(size, 0, -1):
        left = int(counts[length])
        while left:
            room = min((r for r in open_ if r >= length), default=None)
            if room is None:
                fill, times = (), left // (size // length) if left >= size // length else 0
                each = size // length
                if not times:
                    each, times = left, 1
                new = [((length, each),), times]
                left -= each * times
                rest = size - each * length
            else:
                group = open_[room][-1]
                fill, times = group
                each = min(room // length, left)
                use = min(times, max(1, left // each))
                if use == times:
                    open_[room].pop()
                    if not open_[room]:
                        del open_[room]
                else:
                    group[1] -= use
                new = [(*fill, (length, each)), use]
                left -= each * use
                rest = room - each * length
            if rest:
                open_.setdefault(rest, []).append(new)
            else:
                done.append((new[0], new[1]))
    return done + [(f, t) for groups in open_.values() for f, t in groups]


def sequences(patterns: list[Pattern]) -> int:
    return sum(times for _, times in patterns)


def _fuller(counts: np.ndarray, room: int, width: int) -> list[tuple[int, ...]]:
    """Fillings of ``room`` by lengths at hand, least waste first, none dominated.

    A filling is dominated if another has the same or larger lengths in its place: so
    fillings to which a further piece could be added, or in which one piece could be
    exchanged for a larger one, are left out, and one piece that fills the room exactly
    makes all others needless.
    """
    have = np.flatnonzero(counts[:room + 1])
    have = have[have > 0][::-1]
    if not len(have):
        return [()]
    if have[0] == room:
        return [(room,)]
    found: dict[tuple[int, ...], int] = {(int(have[0]),): room - int(have[0])} if have[0] + have[-1] > room else {}
    # Two pieces: for each larger one the largest that still fits.
    upto = np.maximum.accumulate(np.where(counts[:room + 1] > 0, np.arange(room + 1), 0))
    second = np.minimum(upto[room - have], have)
    same = (second == have) & (counts[have] < 2)
    second = np.where(same, upto[np.maximum(np.minimum(have - 1, room - have), 0)], second)
    waste = room - have - second
    for k in np.argsort(waste, kind="stable")[:width]:
        if second[k]:
            found[(int(have[k]), int(second[k]))] = int(waste[k])
    if min(found.values(), default=1):
        fill = _subset(counts, room, have)
        found[fill] = room - sum(fill)
    kept = {f: w for f, w in found.items() if w == 0 or not _improvable(counts, f, w)}
    return sorted(kept or found, key=lambda f: (found[f], len(f)))[:width]


def _improvable(counts: np.ndarray, fill: tuple[int, ...], waste: int) -> bool:
    used = {x: fill.count(x) for x in fill}
    free = lambda x: counts[x] > used.get(x, 0)
    return any(free(x) for x in range(1, waste + 1)) or any(
        free(y) for x in used for y in range(x + 1, x + waste + 1))


def _subset(counts: np.ndarray, room: int, have: np.ndarray) -> tuple[int, ...]:
    """Pieces whose lengths sum as near to ``room`` as can be, large ones first."""
    full, reach, steps = (1 << (room + 1)) - 1, 1, []
    for length in have.tolist():
        left, part = min(int(counts[length]), room // length), 1
        while left:
            take = min(part, left)
            steps.append((length, take, reach))
            reach |= reach << (length * take) & full
            left -= take
            part *= 2
        if reach >> room & 1:
            break
    at, out = reach.bit_length() - 1, []
    for length, take, before in reversed(steps):
        if not before >> at & 1:
            out += [length] * take
            at -= length * take
    return tuple(sorted(out, reverse=True))


def _apply(counts: np.ndarray, length: int, fill: tuple[int, ...]) -> tuple[np.ndarray, Pattern]:
    """Take one pattern out of ``counts`` as often as it goes."""
    items: dict[int, int] = {length: 1}
    for x in fill:
        items[x] = items.get(x, 0) + 1
    times = min(int(counts[x]) // n for x, n in items.items())
    counts = counts.copy()
    for x, n in items.items():
        counts[x] -= n * times
    return counts, (tuple(items.items()), times)


def complete(counts: np.ndarray, nodes: int = NODES, width: int = WIDTH) -> list[Pattern]:
    """Patterns that pack all pieces; ``counts[l]`` pieces have length ``l``."""
    counts = np.asarray(counts, np.int64)
    size = len(counts) - 1
    total = int((counts * np.arange(size + 1)).sum())
    bound = lower_bound(counts)
    best = best_fit(counts)
    least = sequences(best)
    path: list[Pattern] = []
    stack = [(counts, 0, None, 0)]
    while stack and least > bound and nodes > 0:
        left, depth, step, waste = stack.pop()
        del path[max(depth - 1, 0):]
        if step is not None:
            path.append(step)
        # Waste that a better packing may have in all.
        if waste > (least - 1) * size - total:
            continue
        nodes -= 1
        largest = int(np.flatnonzero(left)[-1]) if left.any() else 0
        if not largest:
            if sequences(path) < least:
                best, least = list(path), sequences(path)
            continue
        rest = left.copy()
        rest[largest] -= 1
        for fill in reversed(_fuller(rest, size - largest, width)):
            after, taken = _apply(left, largest, fill)
            lost = (size - largest - sum(fill)) * taken[1]
            stack.append((after, depth + 1, taken, waste + lost))
    return best


def _pieces(sent, capacity: int, with_ids: bool, arrow_kind: pa.DataType):
    fields = [
        ("_id", arrow_kind), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()),
        ("ids_crc32", pa.int64()), ("task", pa.int32()), ("nth", pa.int64()),
    ]
    schema = pa.schema(fields + [("ids", pa.binary())] * with_ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, task = codec(sent.value), TaskContext.get().partitionId()
        end = END_TOKEN.to_bytes(4, "little")
        nth = [0] * (capacity + 1)
        rows: list[tuple] = []
        held = 0

        def out():
            return pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)

        for batch in batches:
            for key, text in zip(batch.column(0), batch.column(1)):
                ids = own.encode(text.as_py()) + end
                for piece, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at:at + 4 * capacity]
                    length = len(part) // 4
                    row = (key.as_py(), piece, at // 4, length, zlib.crc32(part), task, nth[length])
                    rows.append((*row, part) if with_ids else row)
                    nth[length] += 1
                    held += len(part) if with_ids else 64
                if held > 1 << 22:
                    yield out()
                    rows.clear()
                    held = 0
        if rows:
            yield out()

    return run


def _places(patterns: list[Pattern], capacity: int) -> dict[int, tuple[np.ndarray, ...]]:
    """For each length: first rank, first sequence, pieces a sequence and place of a pattern."""
    table: dict[int, list] = {}
    first_rank = [0] * (capacity + 1)
    sequence = 0
    for items, times in patterns:
        offset = 0
        for length, each in items:
            table.setdefault(length, []).append((first_rank[length], sequence, each, offset))
            first_rank[length] += each * times
            offset += each * length
        sequence += times
    return {k: tuple(np.array(c, np.int64) for c in zip(*v)) for k, v in table.items()}


def place(pieces: DataFrame, capacity: int = CAPACITY, nodes: int = NODES) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to pieces with ``length``, ``task`` and ``nth``.

    ``nth`` counts the pieces of one length within a task, from 0.
    """
    spark = pieces.sparkSession
    per_task = pieces.groupBy("task", "length").agg(F.count("*").alias("n"))
    counts = np.zeros(capacity + 1, np.int64)
    # At most one row for each length.
    for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect():
        counts[r["length"]] = r["n"]
    sent = spark.sparkContext.broadcast(_places(complete(counts, nodes), capacity))
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    base = per_task.select("task", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_base"))
    ranked = pieces.join(base, ["task", "length"]).withColumn("_rank", F.col("_base") + F.col("nth"))

    @F.pandas_udf("sequence_id long, offset long")
    def located(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        n, r = length.to_numpy(), rank.to_numpy()
        sequence, offset = np.empty(len(n), np.int64), np.empty(len(n), np.int64)
        for value in np.unique(n):
            own = np.flatnonzero(n == value)
            first, start, each, at = sent.value[int(value)]
            k = np.searchsorted(first, r[own], "right") - 1
            back = r[own] - first[k]
            sequence[own] = start[k] + back // each[k]
            offset[own] = at[k] + back % each[k] * value
        return pd.DataFrame({"sequence_id": sequence, "offset": offset})

    columns = [c for c in pieces.columns if c not in ("task", "nth")]
    return ranked.withColumn("_at", located("length", "_rank")).select(*columns, "_at.sequence_id", "_at.offset")


def pack(
    df: DataFrame, vocab_path: str, id_col: str = "doc_id", text_col: str = "text",
    capacity: int = CAPACITY, with_ids: bool = False, nodes: int = NODES,
) -> DataFrame:
    """Pieces of all texts with their places: ``id_col, piece, start, length, ids_crc32,``
    ``ids`` (little-endian unsigned 32-bit, if asked for), ``sequence_id, offset``."""
    kind, arrow_kind = _id_type(df, id_col)
    sent = df.sparkSession.sparkContext.broadcast(vocabulary(vocab_path))
    ddl = f"_id {kind}, piece int, start long, length long, ids_crc32 long, task int, nth long"
    pieces = materialize(
        df.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"))
        .mapInArrow(_pieces(sent, capacity, with_ids, arrow_kind), ddl + ", ids binary" * with_ids),
        "pieces")
    return place(pieces, capacity, nodes).withColumnRenamed("_id", id_col)
