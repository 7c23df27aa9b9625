"""Line dedup by a log-template tree.

Every line goes down a tree of fixed depth: by its number of tokens, then by its leading
tokens, where a token with a digit is a variable field.  In the leaf it reaches, a token
is a constant if lines of at least ``min_docs`` documents have it at that place, and a
variable field otherwise.  Constants and fields make the template; if at least ``share``
of its tokens are constants, lines of one template are taken to be the same line.  A
template found in at least ``min_docs`` documents is recurring, and so is a line found in as
many as it is, whatever its share of constants: such lines are dropped from all documents
but the first (the least id), so nothing is lost from all of them.

Lines are reduced to one row per content before their tokens are counted, so a line in a
third of all documents is one row per task; lines of leaves that too few documents reach
are left out before their tokens move.

Defined results: lines end at a line feed; tokens are separated by the six ASCII white
space bytes; lines without tokens stay; a null text stays null with no lines; a text that
loses all its lines becomes empty; repeated rows (same id and text) are one document;
rows of one id with different texts are documents of their own, but none of them loses a
line that is first in another; rows without id are taken to have the largest id.  The id is an integer.  Other columns are left
aside.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from themeloom.llm.bpe import _id_type
from themeloom.llm.words import FACTORS, Slice, find_words, mix, sequence_hash, slices, word_hashes
from themeloom.session import materialize

DEPTH = 3
MIN_DOCS = 3
SHARE = 0.6
FIELD = np.uint64(0)


class Lines:
    """Lines with tokens of a slice: row, byte span, tokens, leaf and content."""

    def __init__(self, part: Slice, depth: int):
        words = find_words(part)
        feeds = np.flatnonzero(part.data == 10)
        # A token begins a line if a line feed or a new text lies before it.
        line_of = np.searchsorted(feeds, words.starts) + words.row
        new = np.ones(len(line_of), bool)
        new[1:] = line_of[1:] != line_of[:-1]
        first = np.flatnonzero(new)
        self.first, self.end = first, np.append(first[1:], len(line_of))
        self.row = words.row[first]
        digits = np.concatenate([[0], np.cumsum((part.data >= 48) & (part.data <= 57))])
        field = digits[words.ends] > digits[words.starts]
        self.words = word_hashes(part.data, words)
        self.tokens = np.where(field, FIELD, self.words)
        size = (self.end - self.first).astype(np.uint64)
        lead = sequence_hash(self.tokens, self.first, np.minimum(self.first + depth, self.end), 2)
        self.leaf = mix(lead + size * np.uint64(FACTORS[2])).view(np.int64)
        self.content = sequence_hash(self.tokens, self.first, self.end, 3).view(np.int64)
        before = np.searchsorted(feeds, words.starts[first])
        edge = np.append(-1, feeds)
        self.start = np.maximum(edge[before] + 1, part.bounds[self.row]) if len(first) else first
        after = np.append(feeds + 1, part.bounds[-1])
        self.stop = np.minimum(after[before], part.bounds[self.row + 1]) if len(first) else first

    def exact(self) -> np.ndarray:
        """Content with digits; that of a line without fields is its content."""
        return sequence_hash(self.words, self.first, self.end, 3).view(np.int64)


def _distinct(*keys: np.ndarray) -> np.ndarray:
    order = np.lexsort(keys)
    new = np.zeros(len(order), bool)
    if len(order):
        new[0] = True
        for k in keys:
            new[1:] |= k[order][1:] != k[order][:-1]
    return order[new]


SEEN, FIELDS = 0, 1


def _scan(depth: int):
    """One pass over the texts, the lines of each slice found once, for two uses apart by
    ``kind``: SEEN, every distinct (row, leaf, content) with ``once`` on the first of its row
    and leaf; FIELDS, every distinct (row, content with digits) of a line with fields."""
    schema = pa.schema([
        ("kind", pa.int8()), ("doc", pa.int64()), ("row", pa.int64()), ("leaf", pa.int64()),
        ("content", pa.int64()), ("once", pa.int32()),
    ])

    def rows(kind, doc, row, content, leaf=None, once=None):
        n = len(doc)
        return pa.RecordBatch.from_arrays([
            pa.array(np.full(n, kind, np.int8)), doc, row, pa.nulls(n, pa.int64()) if leaf is None else leaf,
            content, pa.nulls(n, pa.int32()) if once is None else once,
        ], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch.column(2)):
                lines = Lines(part, depth)
                own = _distinct(lines.content, lines.leaf, lines.row)
                own = own[np.lexsort((lines.leaf[own], lines.row[own]))]
                row, leaf = lines.row[own], lines.leaf[own]
                once = np.ones(len(own), np.int32)
                once[1:] = (row[1:] != row[:-1]) | (leaf[1:] != leaf[:-1])
                at = pa.array(part.first + row)
                yield rows(SEEN, batch.column(0).take(at), batch.column(1).take(at), pa.array(lines.content[own]),
                           pa.array(leaf), pa.array(once))

                exact = lines.exact()
                own = _distinct(exact, lines.row)
                own = own[exact[own] != lines.content[own]]
                at = pa.array(part.first + lines.row[own])
                yield rows(FIELDS, batch.column(0).take(at), batch.column(1).take(at), pa.array(exact[own]))

    return run


def _tokens(depth: int):
    schema = pa.schema([("leaf", pa.int64()), ("content", pa.int64()), ("tokens", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch.column(0)):
                lines = Lines(part, depth)
                own = _distinct(lines.content, lines.leaf)
                size = lines.end[own] - lines.first[own]
                offsets = np.concatenate([[0], np.cumsum(size)])
                at = np.repeat(lines.first[own] - offsets[:-1], size) + np.arange(offsets[-1])
                yield pa.RecordBatch.from_arrays([
                    pa.array(lines.leaf[own]), pa.array(lines.content[own]),
                    pa.ListArray.from_arrays(
                        pa.array(offsets, pa.int32()), pa.array(lines.tokens[at].view(np.int64))),
                ], schema=schema)

    return run


def scan(docs: DataFrame, depth: int = DEPTH) -> DataFrame:
    """The lines of ``docs`` (``doc, row, text``) as ``_scan`` gives them, distinct, written once.
    Tokens are not kept here: those of leaves that too few documents reach never move."""
    return materialize(
        docs.select(F.coalesce("doc", F.lit((1 << 63) - 1)).alias("doc"), "row", "text")
        .mapInArrow(_scan(depth), "kind byte, doc long, row long, leaf long, content long, once int")
        .distinct(), "lines")


def cut(texts: pa.Array, drops: pa.Array, depth: int):
    """Slices of a text column with their texts without the dropped lines, the numbers of
    lines and of dropped lines.  Drops are contents with fields or as they are."""
    missing = np.asarray(texts.is_null())
    for part in slices(texts):
        lines = Lines(part, depth)
        exact = lines.exact()
        raw = part.data.tobytes()
        feeds = np.concatenate([[0], np.cumsum(part.data == 10)])
        counts = feeds[part.bounds[1:]] - feeds[part.bounds[:-1]] + 1
        first = np.searchsorted(lines.row, np.arange(part.rows + 1))
        out, lost = [], []
        for i in range(part.rows):
            begin, end = part.bounds[i], part.bounds[i + 1]
            if missing[part.first + i]:
                counts[i] = 0
                out.append(None)
                lost.append(0)
                continue
            own = np.arange(first[i], first[i + 1])
            gone = drops[part.first + i].values
            own = own[np.isin([lines.content[own], exact[own]], gone.to_numpy()).any(axis=0)] if gone is not None else own[:0]
            pieces, at = [], begin
            for k in own:
                pieces.append(raw[at:lines.start[k]])
                at = lines.stop[k]
            text = b"".join([*pieces, raw[at:end]])
            # The last line had no line feed; the one before it has none now.
            if len(own) and lines.stop[own[-1]] == end and raw[end - 1:end] != b"\n":
                text = text.removesuffix(b"\n")
            out.append(text.decode())
            lost.append(len(own))
        yield part, pa.array(out, pa.string()), counts.astype(np.int64), lost


def recurring_lines(
    docs: DataFrame, scanned: DataFrame, depth: int = DEPTH, min_docs: int = MIN_DOCS, share: float = SHARE
) -> DataFrame:
    """``row, content`` of the lines to drop from each row of ``docs`` (``doc, row, text``), with
    the ``scan`` of them."""
    seen = scanned.where(F.col("kind") == SEEN).select("doc", "row", "leaf", "content", "once")
    leaves = materialize(
        seen.groupBy("leaf").agg(F.sum("once").alias("docs")).where(F.col("docs") >= min_docs).select("leaf"),
        "leaves")
    own = materialize(seen.join(leaves, "leaf", "left_semi").select("doc", "row", "leaf", "content"), "own")
    often = own.groupBy("leaf", "content").agg(F.count("*").alias("docs"))
    contents = materialize(
        docs.select("text").mapInArrow(_tokens(depth), "leaf long, content long, tokens array<long>")
        .join(leaves, "leaf", "left_semi")
        .groupBy("leaf", "content").agg(F.any_value("tokens").alias("tokens"))
        .join(often, ["leaf", "content"]), "contents")
    places = contents.select(
        "leaf", "content", "docs", F.size("tokens").alias("size"), F.posexplode("tokens").alias("place", "token"))
    constants = (
        places.where("token != 0").groupBy("leaf", "place", "token").agg(F.sum("docs").alias("docs"))
        .where(F.col("docs") >= min_docs).select("leaf", "place", "token")
    )
    templates = materialize(
        places.join(constants, ["leaf", "place", "token"])
        .groupBy("leaf", "content").agg(
            F.bit_xor(F.xxhash64("place", "token")).alias("fixed"), F.count("*").alias("n"),
            F.first("size").alias("size"))
        .where(F.col("n") >= share * F.col("size"))
        .select("content", "leaf", F.xxhash64("leaf", "fixed", "n").alias("template")), "templates")
    found = materialize(own.join(templates, ["leaf", "content"]).select("doc", "row", "content", "template"), "found")
    recurring = materialize(
        found.select("template", "doc", "row").distinct().groupBy("template").agg(
            F.count("*").alias("docs"), F.min("doc").alias("first"))
        .where(F.col("docs") >= min_docs).select("template", "first"), "recurring")
    return (
        found.join(recurring, "template").where("doc != first").select("row", "content").distinct()
    )


def identical_lines(scanned: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """``row, content`` of lines with fields that recur as they are, whatever their share of
    constants; those without fields are templates of their own.  From the ``scan`` of the rows."""
    found = scanned.where(F.col("kind") == FIELDS).select("doc", "row", "content")
    recurring = materialize(
        found.groupBy("content").agg(F.count("*").alias("docs"), F.min("doc").alias("first"))
        .where(F.col("docs") >= min_docs).select("content", "first"), "identical")
    return found.join(recurring, "content").where("doc != first").select("row", "content")


def _drops(df: DataFrame, id_col: str, text_col: str, depth: int, min_docs: int, share: float) -> DataFrame:
    """``__row, __drops``: the lines that each row loses."""
    text = F.col(text_col).cast("string")
    docs = df.select(
        F.col(id_col).cast("long").alias("doc"), F.xxhash64(F.col(id_col), text).alias("row"), text.alias("text"))
    scanned = scan(docs, depth)
    lost = recurring_lines(docs, scanned, depth, min_docs, share).union(identical_lines(scanned, min_docs))
    return (
        lost.groupBy(F.col("row").alias("__row")).agg(F.collect_list("content").alias("__drops"))
    )


def dedup(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", depth: int = DEPTH,
    min_docs: int = MIN_DOCS, share: float = SHARE,
) -> DataFrame:
    """``id_col``, ``n_lines``, ``n_dropped`` and ``kept`` of every row."""
    kind, arrow_kind = _id_type(df, id_col)
    schema = pa.schema([
        ("_id", arrow_kind), ("n_lines", pa.int64()), ("n_dropped", pa.int64()), ("kept", pa.string()),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, kept, counts, lost in cut(batch.column(1), batch.column(2), depth):
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(part.first, part.rows), pa.array(counts), pa.array(lost, pa.int64()), kept,
                ], schema=schema)

    text = F.col(text_col).cast("string")
    docs = df.select(
        F.col(id_col).alias("_id"), F.xxhash64(F.col(id_col), text).alias("__row"), text.alias("text"))
    return (
        docs.join(_drops(df, id_col, text_col, depth, min_docs, share), "__row", "left")
        .select("_id", "text", "__drops")
        .mapInArrow(run, f"_id {kind}, n_lines long, n_dropped long, kept string")
        .withColumnRenamed("_id", id_col)
    )


def without_recurring(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", depth: int = DEPTH,
    min_docs: int = MIN_DOCS, share: float = SHARE,
) -> DataFrame:
    """The rows of ``df``, all columns, with the recurring lines taken out of their texts."""
    place = df.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.select(range(2, batch.num_columns))
            for part, kept, _, _ in cut(batch.column(0), batch.column(1), depth):
                own = rows.slice(part.first, part.rows)
                yield own.set_column(place, own.schema.field(place).with_type(pa.string()), kept)

    text = F.col(text_col).cast("string")
    drops = _drops(df, id_col, text_col, depth, min_docs, share)
    keyed = df.select(F.xxhash64(F.col(id_col), text).alias("__row"), text.alias("__text"), *df.columns)
    return (
        keyed.join(drops, "__row", "left").select("__text", "__drops", *df.columns).mapInArrow(run, df.schema)
    )


# The same in SQL, over table ``documents``.
SQL = f"""
WITH texts AS (
  SELECT DISTINCT coalesce(doc_id, 9223372036854775807) AS doc_id, text FROM documents WHERE text IS NOT NULL
),
lines AS (
  SELECT doc_id, text, unnest(string_split(text, chr(10))) AS line,
         generate_subscripts(string_split(text, chr(10)), 1) AS num FROM texts
), cut AS (
  SELECT *, [CASE WHEN regexp_matches(t, '[0-9]') THEN NULL ELSE t END
             for t in regexp_extract_all(line, '[^\\x20\\x09-\\x0D]+')] AS toks,
         regexp_extract_all(line, '[^\\x20\\x09-\\x0D]+') AS words FROM lines
), placed AS (
  SELECT *, len(toks) AS size, toks[1:{DEPTH}] AS lead FROM cut WHERE len(toks) > 0
), leaves AS (
  SELECT size, lead FROM placed GROUP BY ALL HAVING count(DISTINCT (doc_id, text)) >= {MIN_DOCS}
), own AS (
  SELECT p.* FROM placed p JOIN leaves l ON p.size = l.size AND p.lead IS NOT DISTINCT FROM l.lead
), contents AS (
  SELECT size, lead, toks, count(DISTINCT (doc_id, text)) AS docs FROM own GROUP BY ALL
), places AS (
  SELECT size, lead, toks, docs, unnest(toks) AS tok, generate_subscripts(toks, 1) AS place FROM contents
), constants AS (
  SELECT size, lead, place, tok FROM places WHERE tok IS NOT NULL GROUP BY ALL HAVING sum(docs) >= {MIN_DOCS}
), templates AS (
  SELECT p.size, p.lead, p.toks, list((p.place, p.tok) ORDER BY p.place) AS template
  FROM places p JOIN constants c
    ON p.size = c.size AND p.lead IS NOT DISTINCT FROM c.lead AND p.place = c.place AND p.tok = c.tok
  GROUP BY p.size, p.lead, p.toks HAVING count(*) >= {SHARE} * p.size
), found AS (
  SELECT o.doc_id, o.text, o.num, t.size, t.lead, t.template FROM own o JOIN templates t
    ON o.size = t.size AND o.lead IS NOT DISTINCT FROM t.lead AND o.toks IS NOT DISTINCT FROM t.toks
), recurring AS (
  SELECT size, lead, template, min(doc_id) AS first FROM found
  GROUP BY ALL HAVING count(DISTINCT (doc_id, text)) >= {MIN_DOCS}
), identical AS (
  SELECT words, min(doc_id) AS first FROM placed GROUP BY ALL HAVING count(DISTINCT (doc_id, text)) >= {MIN_DOCS}
), dropped AS (
  SELECT f.doc_id, f.text, f.num FROM found f JOIN recurring r
    ON f.size = r.size AND f.lead IS NOT DISTINCT FROM r.lead AND f.template = r.template
  WHERE f.doc_id <> r.first
  UNION
  SELECT p.doc_id, p.text, p.num FROM placed p JOIN identical i ON p.words = i.words WHERE p.doc_id <> i.first
), kept AS (
  SELECT l.doc_id, l.text, count(*) AS n_lines, count(d.num) AS n_dropped,
         coalesce(string_agg(l.line, chr(10) ORDER BY l.num) FILTER (d.num IS NULL), '') AS kept
  FROM lines l LEFT JOIN dropped d ON l.doc_id = d.doc_id AND l.text = d.text AND l.num = d.num
  GROUP BY l.doc_id, l.text
)
SELECT x.doc_id, coalesce(k.n_lines, 0) AS n_lines, coalesce(k.n_dropped, 0) AS n_dropped, sha256(k.kept) AS kept_sha256
FROM documents x LEFT JOIN kept k ON coalesce(x.doc_id, 9223372036854775807) = k.doc_id AND x.text = k.text
"""
