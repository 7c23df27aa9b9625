"""Removal of word sequences that repeat across documents, by recompression.

Every text is a sequence of words.  Rounds name runs of one symbol and pairs of symbols
(a hash of a name tells first from second halves of pairs), so texts shrink to fewer,
longer symbols.  A name is a hash of what it stands for: equal content has one name in
the whole corpus without any exchange between tasks, and equal word sequences share all
symbols but those near their ends.  Every window of ``window`` words is represented by
one such symbol inside it, so about one symbol in ten words stands for all windows.

1. The words that decide these symbols are hashed and counted over all documents.  Only
   symbols found in two documents can stand for repeated windows.
2. Windows with the same symbol in a row form a group.  A group whose words are all the
   same as those of a group in an earlier document is repeated as a whole.
3. Groups that share the symbol but not all words are settled window by window, once
   for each distinct content, by 128-bit hashes of the windows.
4. Words covered by repeated windows are removed.

Keys are aggregated before they are joined; a passage found in a third of all documents
is one row per task then, and joins of rows with hot keys are left to adaptive execution.
No step holds more than one slice of texts, or the windows of one document.

Defined results: words are separated by the six ASCII white space bytes; a null text
has no words; texts shorter than a window lose nothing; repeated rows (same id and text)
are one document to each other, so they keep the same words; rows with a null id neither
lose words nor make others lose any.  The id is an integer.  Other columns are left aside.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from themeloom.llm.bpe import _id_type
from themeloom.llm.words import FACTORS, field_hash, find_words, mix, slices, span_hash, window_hash, word_hashes
from themeloom.session import materialize

WINDOW = 50
LEVELS = 5
# Rounds that also name runs of one symbol; without them periodic texts never shrink.
RUN_ROUNDS = (0, 3)

_SALT = np.random.default_rng(7).integers(1, 1 << 63, 64, np.uint64) | np.uint64(1)


def recompress(names: np.ndarray, row: np.ndarray, first: np.ndarray, levels: int = LEVELS):
    """Symbols of every level: their name and the span of words that decides them.

    A symbol's name is a hash of what it stands for, so equal content has one name in
    the whole corpus.  ``lo``/``hi`` is the span of words on which the symbol depends:
    wherever these words stand, the symbol is found there.  Symbols that depend on
    the edge of a text get a span that reaches beyond it.
    """
    n = len(names)
    pos = np.arange(n, dtype=np.int64)
    lo, hi = pos, pos + 1
    out = [(names, lo, hi)]
    doc = row
    for level in range(levels):
        if level in RUN_ROUNDS:
            names, lo, hi, doc = _runs(names, lo, hi, doc, first, level)
        names, lo, hi, doc = _pairs(names, lo, hi, doc, first, level)
        out.append((names, lo, hi))
    return out


def _around(lo, hi, doc, first):
    """Span of the neighbours of each symbol; beyond the text where there is none."""
    left = np.empty_like(lo)
    right = np.empty_like(hi)
    left[1:] = np.where(doc[1:] == doc[:-1], lo[:-1], first[doc[1:]] - 1)
    left[:1] = first[doc[:1]] - 1
    right[:-1] = np.where(doc[1:] == doc[:-1], hi[1:], first[doc[:-1] + 1] + 1)
    right[-1:] = first[doc[-1:] + 1] + 1
    return left, right


def _runs(names, lo, hi, doc, first, level):
    if not len(names):
        return names, lo, hi, doc
    left, right = _around(lo, hi, doc, first)
    new = np.ones(len(names), bool)
    new[1:] = (names[1:] != names[:-1]) | (doc[1:] != doc[:-1])
    at = np.flatnonzero(new)
    last = np.append(at[1:], len(names)) - 1
    length = (last - at + 1).astype(np.uint64)
    named = mix(names[at] + length * _SALT[2 * level])
    return np.where(length > 1, named, names[at]), left[at], right[last], doc[at]


def _pairs(names, lo, hi, doc, first, level):
    if not len(names):
        return names, lo, hi, doc
    left, right = _around(lo, hi, doc, first)
    second = (names * _SALT[2 * level + 1]) >> np.uint64(63) == 1
    joined = np.zeros(len(names), bool)
    joined[:-1] = ~second[:-1] & second[1:] & (doc[1:] == doc[:-1])
    taken = np.zeros(len(names), bool)
    taken[1:] = joined[:-1]
    # A symbol left alone is so because of the neighbour on its open side.
    new_lo = np.where(second, left, lo)
    new_hi = np.where(second, hi, right)
    at = np.flatnonzero(joined)
    out = names.copy()
    out[at] = mix(names[at] * _SALT[2 * level] + mix(names[at + 1] + _SALT[2 * level + 1]))
    new_lo[at], new_hi[at] = lo[at], hi[at + 1]
    keep = ~taken
    return out[keep], new_lo[keep], new_hi[keep], doc[keep]


def anchors(levels, hashes: np.ndarray, first: np.ndarray, window: int = WINDOW):
    """For every window its first word, and key and place of the symbol that stands for it.

    Of the symbols decided within a window, on the highest level that has any, the one
    with the least name is taken, the first of equals.  Equal windows take equal ones.
    The key is a hash of the words that decide the symbol.  Symbols that repeat without
    a break share one place, so that a periodic text does not get a group per period.
    """
    size = np.diff(first)
    count = np.maximum(size - window + 1, 0)
    total = int(count.sum())
    begin = np.repeat(first[:-1] - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(total)
    key = np.zeros(total, np.uint64)
    place = np.full(total, -1, np.int64)
    open_ = np.arange(total)
    n = int(first[-1])
    for level in range(len(levels) - 1, -1, -1):
        if not len(open_):
            break
        names, lo, hi = levels[level]
        w = begin[open_]
        # First symbol decided at or after w, and last decided by w + window.
        before = np.cumsum(np.bincount(lo + 1, minlength=n + 2))
        until = np.cumsum(np.bincount(hi, minlength=n + 2))
        a, b = before[w], until[w + window]
        has = b > a
        got, a, b = open_[has], a[has], b[has]
        best = _least(names, a, b)
        key[got] = span_hash(hashes, np.maximum(lo, 0), np.minimum(hi, n), FACTORS[2])[best]
        new = np.ones(len(names), bool)
        new[1:] = names[1:] != names[:-1]
        place[got] = np.maximum.accumulate(np.where(new, np.arange(len(names)), 0))[best] * 64 + level
        open_ = open_[~has]
    return begin, key, place


def _least(values, a, b):
    """Place of the least value in each range [a, b), the first of equals."""
    if not len(a):
        return a
    power = np.log2(b - a).astype(np.int64)
    out = np.empty(len(a), np.int64)
    table = np.arange(len(values))
    for p in range(int(power.max()) + 1):
        at = np.flatnonzero(power == p)
        if len(at):
            x, y = table[a[at]], table[b[at] - (1 << p)]
            out[at] = np.where(values[x] <= values[y], x, y)
        step = 1 << p
        if len(table) > step:
            x, y = table[:-step], table[step:]
            table = np.where(values[x] <= values[y], x, y)
    return out


def groups(texts: pa.Array, window: int, contents: bool = True):
    """Groups of windows of a text column, slice by slice.

    Yields the row of each group, key, two hashes of its words (only with ``contents``),
    first word, windows.
    """
    for part in slices(texts):
        words = find_words(part)
        if not (np.diff(words.first) >= window).any():
            continue
        hashes = word_hashes(part.data, words)
        levels = recompress(hashes, words.row, words.first)
        begin, key, place = anchors(levels, hashes, words.first, window)
        row = words.row[begin]
        new = np.ones(len(begin), bool)
        new[1:] = (place[1:] != place[:-1]) | (key[1:] != key[:-1]) | (begin[1:] != begin[:-1] + 1)
        at = np.flatnonzero(new)
        last = np.append(at[1:], len(begin)) - 1
        start, end = begin[at], begin[last] + window
        yield (
            part.first + row[at], key[at].view(np.int64),
            *(field_hash(hashes, start, end, f).view(np.int64) if contents else None for f in (0, 1)),
            start - words.first[row[at]], last - at + 1,
        )


def _keys(window: int):
    schema = pa.schema([("key", pa.int64()), ("low", pa.int64()), ("high", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy()
            for row, key, *_ in groups(batch.column(1), window, contents=False):
                order = np.lexsort((ids[row], key))
                key, doc = key[order], ids[row][order]
                at = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
                last = np.append(at[1:], len(key)) - 1
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key[at]), pa.array(doc[at]), pa.array(doc[last])], schema=schema)

    return run


GROUP = "doc long, body long, key long, c1 long, c2 long, at int, n int"


def _groups(window: int):
    schema = pa.schema([
        *((c, pa.int64()) for c in ("doc", "body", "key", "c1", "c2")), ("at", pa.int32()), ("n", pa.int32()),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, bodies = batch.column(0).to_numpy(), batch.column(2).to_numpy()
            for row, key, c1, c2, at, n in groups(batch.column(1), window):
                yield pa.RecordBatch.from_arrays([
                    pa.array(ids[row]), pa.array(bodies[row]), pa.array(key), pa.array(c1), pa.array(c2),
                    pa.array(at, pa.int32()), pa.array(n, pa.int32()),
                ], schema=schema)

    return run


def _windows(window: int):
    """Hashes of the windows of the groups that come with each text."""
    schema = pa.schema([*((c, pa.int64()) for c in ("doc", "body", "h1", "h2")), ("at", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, bodies, spans = batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(3)
            for part in slices(batch.column(2)):
                words = find_words(part)
                hashes = word_hashes(part.data, words)
                own = spans.slice(part.first, part.rows)
                size = np.asarray(own.value_lengths().fill_null(0))
                flat = own.flatten()
                at, n = flat.field("at").to_numpy(), flat.field("n").to_numpy()
                row = np.repeat(np.repeat(np.arange(part.rows), size), n)
                first = np.repeat(at - np.concatenate([[0], np.cumsum(n)[:-1]]), n) if len(n) else at
                first = first + np.arange(len(first))
                start = words.first[row] + first
                yield pa.RecordBatch.from_arrays([
                    pa.array(ids[part.first + row]), pa.array(bodies[part.first + row]),
                    pa.array(window_hash(hashes, start, window, 3).view(np.int64)),
                    pa.array(window_hash(hashes, start, window, 4).view(np.int64)),
                    pa.array(first, pa.int32()),
                ], schema=schema)

    return run


def repeated_windows(df: DataFrame, id_col: str, text_col: str, window: int = WINDOW) -> DataFrame:
    """Runs of windows that also start in a document of smaller id: ``doc, body, at, n``.

    ``body`` is a hash of the text, ``at`` the first word of the run, ``n`` its windows.
    """
    docs = (
        df.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull())
        .select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).cast("string").alias("text"),
                F.xxhash64(F.col(text_col).cast("string")).alias("body"))
    )
    shared = materialize(
        docs.select("doc", "text").mapInArrow(_keys(window), "key long, low long, high long")
        .groupBy("key").agg(F.min("low").alias("low"), F.max("high").alias("high"))
        .where("low < high").select("key"),
        "shared",
    )
    found = materialize(
        docs.select("doc", "text", "body").mapInArrow(_groups(window), GROUP).join(shared, "key", "left_semi"),
        "groups",
    )
    # Written before it is joined, so that a content with very many rows can be split.
    contents = materialize(found.groupBy("key", "c1", "c2").agg(F.min("doc").alias("origin")), "contents")
    several = contents.groupBy("key").agg(F.count("*").alias("contents")).where("contents > 1")
    told = materialize(found.join(contents, ["key", "c1", "c2"]).select(
        "doc", "body", "key", "at", "n", (F.col("origin") < F.col("doc")).alias("whole")), "told")
    whole = told.where("whole").select("doc", "body", "at", "n")
    open_ = (
        told.where("not whole").join(several, "key", "left_semi")
        .groupBy("doc", "body").agg(F.collect_list(F.struct("at", "n")).alias("spans"))
    )
    tried = materialize(
        docs.join(open_, ["doc", "body"]).select("doc", "body", "text", "spans")
        .mapInArrow(_windows(window), "doc long, body long, h1 long, h2 long, at int"),
        "windows",
    )
    first = materialize(tried.groupBy("h1", "h2").agg(F.min("doc").alias("origin")), "origins")
    single = (
        tried.join(first, ["h1", "h2"]).where("origin < doc")
        .select("doc", "body", "at", F.lit(1).alias("n"))
    )
    return whole.unionByName(single)


def cut(texts: pa.Array, spans: pa.Array, window: int, layout: bool):
    """Slices of a text column with what is left of the texts, and numbers of words and
    of removed words."""
    missing = np.asarray(texts.is_null())
    for part in slices(texts):
        words = find_words(part)
        size = np.diff(words.first)
        own = spans.slice(part.first, part.rows)
        row = np.repeat(np.arange(part.rows), np.asarray(own.value_lengths().fill_null(0)))
        flat = own.flatten()
        begin = words.first[row] + flat.field("at").to_numpy()
        change = np.zeros(len(words.starts) + 1, np.int64)
        np.add.at(change, begin, 1)
        np.add.at(change, begin + flat.field("n").to_numpy() + window - 1, -1)
        gone = np.cumsum(change)[:-1] > 0
        lost = np.concatenate([[0], np.cumsum(gone)])
        lost = lost[words.first[1:]] - lost[words.first[:-1]]
        raw, out = part.data.tobytes(), []
        for i in range(part.rows):
            a, b = words.first[i], words.first[i + 1]
            if layout and (missing[part.first + i] or not lost[i]):
                out.append(None if missing[part.first + i] else raw[part.bounds[i]:part.bounds[i + 1]])
                continue
            keep = np.flatnonzero(~gone[a:b]) + a
            if layout:
                # A word goes with the white space behind it.
                until = np.append(words.starts[a + 1:b], part.bounds[i + 1])[keep - a]
                lead = raw[part.bounds[i]:words.starts[a]]
                out.append(lead + b"".join(raw[s:e] for s, e in zip(words.starts[keep], until)))
            else:
                out.append(b" ".join(raw[s:e] for s, e in zip(words.starts[keep], words.ends[keep])))
        kept = pa.array([t if t is None else t.decode() for t in out], pa.string())
        yield part, kept, size.astype(np.int64), lost.astype(np.int64)


def _spans(df: DataFrame, id_col: str, text_col: str, window: int) -> DataFrame:
    """``__doc, __body, __spans``: the repeated windows of each row."""
    return (
        repeated_windows(df, id_col, text_col, window)
        .groupBy(F.col("doc").alias("__doc"), F.col("body").alias("__body"))
        .agg(F.collect_list(F.struct("at", "n")).alias("__spans"))
    )


def dedup(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW
) -> DataFrame:
    """``id_col``, ``n_words``, ``n_removed`` and ``kept`` (the words left, one space
    between) of every row."""
    kind, arrow_kind = _id_type(df, id_col)
    schema = pa.schema([
        ("_id", arrow_kind), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.string()),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, kept, size, lost in cut(batch.column(1), batch.column(2), window, False):
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(part.first, part.rows), pa.array(size), pa.array(lost), kept,
                ], schema=schema)

    text = F.col(text_col).cast("string")
    docs = df.select(
        F.col(id_col).alias("_id"), text.alias("_text"), F.col(id_col).cast("long").alias("__doc"),
        F.xxhash64(text).alias("__body"))
    return (
        docs.join(_spans(df, id_col, text_col, window), ["__doc", "__body"], "left").select("_id", "_text", "__spans")
        .mapInArrow(run, f"_id {kind}, n_words long, n_removed long, kept string")
        .withColumnRenamed("_id", id_col)
    )


def without_repeats(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW
) -> DataFrame:
    """The rows of ``df``, all columns, with repeated words taken out of their texts, each
    with the white space behind it."""
    place = df.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.select(range(2, batch.num_columns))
            for part, kept, _, _ in cut(batch.column(0), batch.column(1), window, True):
                own = rows.slice(part.first, part.rows)
                yield own.set_column(place, own.schema.field(place).with_type(pa.string()), kept)

    text = F.col(text_col).cast("string")
    keyed = df.select(
        text.alias("__text"), F.col(id_col).cast("long").alias("__doc"), F.xxhash64(text).alias("__body"), *df.columns)
    return (
        keyed.join(_spans(df, id_col, text_col, window), ["__doc", "__body"], "left")
        .select("__text", "__spans", *df.columns).mapInArrow(run, df.schema)
    )
