"""Ranked lexical search over impact vectors in buckets of similar length.

A document is a vector of impacts, one for each term that a query asks for; its score is
the inner product with the query's counts of terms.  Vectors are kept in order of their
length and cut into buckets of similar length.  A query passes over a bucket whose longest
vector cannot reach the query's k-th best score by the Cauchy-Schwarz inequality, or by the
largest impacts of the bucket at the query's coordinates.  Inside a bucket the query's
weightiest coordinates are its focus: only vectors with one of them can qualify, and of
these only such whose product over the focus, with the bound of what is left by length and
by coordinates, reaches the k-th best score.  These are scored again in whole numbers.

Texts are read once: every task counts the terms asked for and its documents, and the
counts are summed per term.  A first search over the longest vectors gives every query a
lower bound of its k-th best score; it is sent to the search over all vectors and pushed
into their scan.  Items are sent to the tasks, at most about ``ITEM_BYTES`` of text at once;
more items go in rounds.  Every task returns at most k rows an item.

Defined results: terms are maximal runs of digits, letters and characters beyond ASCII,
with A-Z lower-cased; a null text has no terms; every row is a document of its own, also
one that repeats another or has no id (which comes after all ids at equal score); items
are known by id and text, so repeated items are one; empty tables give no rows.  Ids of
documents are whole numbers.  Other columns are left aside.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from themeloom.llm.bpe import _id_type
from themeloom.llm.words import Slice, find_words, lower_ascii, slices, word_hashes
from themeloom.session import materialize

# Share of the document's length in its weight, of 100, and the scales.
LENGTH_SHARE = 75
SCALE = 1_000_000_000
K = 10

ITEM_BYTES = 16 << 20
# Rows of a bucket, and how much shorter its last vector may be once it has enough rows.
BUCKET_ROWS = 2048
LEAST_ROWS = 256
SIMILAR = 0.9
# About so many of the longest vectors give the first bounds.
FIRST_ROWS = 8192
# Room for the rounding of bounds, which are doubles.
SLACK = 1 + 1e-9

APART = np.ones(256, bool)
APART[48:58] = APART[65:91] = APART[97:123] = APART[128:] = False


@dataclass
class Terms:
    """Terms of a slice: two independent hashes of each, and where each row's terms begin."""

    one: np.ndarray
    two: np.ndarray
    first: np.ndarray


def terms_of(part: Slice) -> Terms:
    data = lower_ascii(part.data)
    words = find_words(part, APART)
    return Terms(word_hashes(data, words, 0), word_hashes(data, words, 1), words.first)


@dataclass
class Queries:
    """Items as sparse vectors over the terms that any of them has."""

    one: np.ndarray
    two: np.ndarray
    first: np.ndarray
    term: np.ndarray
    count: np.ndarray

    @property
    def rows(self) -> int:
        return len(self.first) - 1

    def numbers(self, t: Terms) -> np.ndarray:
        """The number of each term, -1 for one that no item has."""
        if not len(self.one):
            return np.full(len(t.one), -1)
        at = np.minimum(np.searchsorted(self.one, t.one), len(self.one) - 1)
        return np.where((self.one[at] == t.one) & (self.two[at] == t.two), at, -1)


def queries_of(texts: pa.ChunkedArray) -> Queries:
    parts = [terms_of(p) for p in slices(texts.combine_chunks())]
    one = np.concatenate([p.one for p in parts]) if parts else np.zeros(0, np.uint64)
    two = np.concatenate([p.two for p in parts]) if parts else one
    sizes = np.concatenate([np.diff(p.first) for p in parts]) if parts else np.zeros(0, np.int64)
    held, first, term = np.unique(one, return_index=True, return_inverse=True)
    row = np.repeat(np.arange(len(sizes)), sizes)
    key, count = np.unique(row * max(len(held), 1) + term, return_counts=True)
    row, term = np.divmod(key, max(len(held), 1))
    return Queries(held, two[first], np.searchsorted(row, np.arange(len(sizes) + 1)), term, count)


def _packed(first: np.ndarray, values: np.ndarray) -> pa.Array:
    """Slices of ``values`` as binary cells."""
    width = values.dtype.itemsize
    return pa.Array.from_buffers(
        pa.binary(), len(first) - 1,
        [None, pa.py_buffer((first * width).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(values))])


def _unpacked(column: pa.Array, kind) -> tuple[np.ndarray, np.ndarray]:
    """Where the values of each cell begin, and all values."""
    wide = column.cast(pa.large_binary())
    bounds = np.frombuffer(wide.buffers()[1], np.int64)[wide.offset:wide.offset + len(wide) + 1]
    raw = wide.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[bounds[0]:bounds[-1]] if raw is not None else np.zeros(0, np.uint8)
    return (bounds - bounds[0]) // np.dtype(kind).itemsize, np.frombuffer(data.tobytes(), kind)


_COUNTS = pa.list_(pa.struct([("term", pa.int32()), ("n", pa.int64())]))


def profile(docs: DataFrame, sent, arrow_kind) -> DataFrame:
    """Counts of the terms asked for in each document, and one row of sums from each task.

    Columns: ``_id``, ``sums`` (a row of sums), ``docs`` and ``n`` (documents with terms and
    their terms), ``terms`` and ``tf`` (packed), ``counts`` (documents per term).
    """
    schema = pa.schema([
        ("_id", arrow_kind), ("sums", pa.bool_()), ("docs", pa.int64()), ("n", pa.int64()),
        ("terms", pa.binary()), ("tf", pa.binary()), ("counts", _COUNTS)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked: Queries = sent.value
        held = np.zeros(len(asked.one), np.int64)
        n_docs = n_terms = 0
        for batch in batches:
            for part in slices(batch.column(1)):
                t = terms_of(part)
                size = np.diff(t.first)
                n_docs, n_terms = n_docs + int((size > 0).sum()), n_terms + int(size.sum())
                number = asked.numbers(t)
                row = np.repeat(np.arange(part.rows), size)[number >= 0]
                key, tf = np.unique(row * max(len(held), 1) + number[number >= 0], return_counts=True)
                row, term = np.divmod(key, max(len(held), 1))
                held += np.bincount(term, minlength=len(held))
                own = np.unique(row)
                first = np.searchsorted(row, np.append(own, part.rows))
                if len(own):
                    keys = batch.column(0).slice(part.first, part.rows).take(pa.array(own))
                    yield pa.RecordBatch.from_arrays([
                        keys, pa.array(np.zeros(len(own), bool)), pa.array(np.ones(len(own), np.int64)),
                        pa.array(size[own]), _packed(first, term.astype(np.int32)), _packed(first, tf.astype(np.int32)),
                        pa.nulls(len(own), _COUNTS)], schema=schema)
        at = np.flatnonzero(held)
        counts = pa.ListArray.from_arrays(pa.array([0, len(at)], pa.int32()), pa.StructArray.from_arrays(
            [pa.array(at.astype(np.int32)), pa.array(held[at])], fields=list(_COUNTS.value_type)))
        yield pa.RecordBatch.from_arrays([
            pa.nulls(1, arrow_kind), pa.array([True]), pa.array([n_docs]), pa.array([n_terms]),
            pa.nulls(1, pa.binary()), pa.nulls(1, pa.binary()), counts], schema=schema)

    kind = docs.schema["_id"].dataType.simpleString()
    return materialize(docs.mapInArrow(
        run, f"_id {kind}, sums boolean, docs long, n long, terms binary, tf binary, "
        "counts array<struct<term: int, n: long>>"), "profile")


def weights_of(told: DataFrame, terms: int) -> tuple[np.ndarray, int, int]:
    """Weight of each term asked for, the number of documents, and of all their terms."""
    sums = told.where("sums")
    docs, total = sums.agg(F.sum("docs"), F.sum("n")).first()
    found = np.zeros(terms, np.int64)
    for r in sums.select(F.inline("counts")).groupBy("term").agg(F.sum("n").alias("n")).collect():
        found[r["term"]] = r["n"]
    docs, total = int(docs or 0), int(total or 0)
    weight = [math.floor(1000 * math.log((2 * docs + 2) / (2 * int(df) + 1))) for df in found]
    return np.array(weight, np.int64), docs, total


def impacts(weight, docs: int, total: int, n: np.ndarray, first, term, tf) -> np.ndarray:
    """What each term of each document adds to a score for one mention in an item."""
    share = LENGTH_SHARE * n.astype(object) * docs // total if LENGTH_SHARE * int(n.max()) * docs >= 1 << 63 \
        else LENGTH_SHARE * n * docs // total
    m = 100 - LENGTH_SHARE + share.astype(np.int64)
    tf = tf.astype(np.int64)
    return weight[term] * (SCALE * tf // (1000 * tf + 8 * np.repeat(m, np.diff(first))))


def vectors(told: DataFrame, weight: np.ndarray, docs: int, total: int) -> DataFrame:
    """``_id``, ``norm``, ``terms``, ``impacts`` of each document with a term asked for, longest first in each file."""
    sent = told.sparkSession.sparkContext.broadcast(weight)
    rows = told.where(~F.col("sums")).select("_id", "n", "terms", "tf")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            first, term = _unpacked(batch.column(2), np.int32)
            _, tf = _unpacked(batch.column(3), np.int32)
            value = impacts(sent.value, docs, total, batch.column(1).to_numpy(), first, term, tf)
            norm = np.sqrt(np.add.reduceat(value.astype(np.float64) ** 2, first[:-1]))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(norm), batch.column(2), _packed(first, value)],
                names=["_id", "norm", "terms", "impacts"])

    kind = rows.schema["_id"].dataType.simpleString()
    out = rows.mapInArrow(run, f"_id {kind}, norm double, terms binary, impacts binary")
    return materialize(out.sortWithinPartitions(F.desc("norm")), "vectors")


class Bucket:
    """Vectors of similar length, longest first."""

    def __init__(self, norm, first, term, value, terms: int):
        self.norm, self.first, self.term, self.value = norm, first, term, value
        self.longest = float(norm[0])
        row = np.repeat(np.arange(len(norm)), np.diff(first))
        order = np.argsort(term, kind="stable")
        self.row, self.by_term = row[order], value[order].astype(np.float64)
        self.begin = np.searchsorted(term[order], np.arange(terms + 1))
        self.most = np.zeros(terms)
        held = np.flatnonzero(np.diff(self.begin))
        self.most[held] = np.maximum.reduceat(self.by_term, self.begin[held])

    def candidates(self, term: np.ndarray, count: np.ndarray, least: float) -> np.ndarray:
        """Rows whose product with the query may reach ``least``."""
        none = np.zeros(0, np.int64)
        if self.longest * math.sqrt(float((count * count).sum())) * SLACK < least:
            return none
        top = count * self.most[term]
        order = np.argsort(-top, kind="stable")
        order = order[top[order] > 0]
        # What the coordinates from each place on can add: by the bucket's largest impacts and by length.
        by_coordinates = np.append(np.cumsum(top[order][::-1])[::-1], 0)
        left = np.append(np.cumsum((count[order] ** 2)[::-1])[::-1], 0)
        rest = np.minimum(by_coordinates, np.sqrt(left) * self.longest)
        if rest[0] * SLACK < least:
            return none
        focus = order[:int(np.argmax(rest * SLACK < least)) if rest[-1] * SLACK < least else len(order)]
        if not len(focus):
            return none
        part, square = np.zeros(len(self.norm)), np.zeros(len(self.norm))
        for i in focus:
            own = slice(self.begin[term[i]], self.begin[term[i] + 1])
            # A row occurs once among the entries of a term.
            part[self.row[own]] += count[i] * self.by_term[own]
            square[self.row[own]] += self.by_term[own] ** 2
        length = np.sqrt(np.maximum(self.norm ** 2 * SLACK - square, 0))
        bound = part + np.minimum(by_coordinates[len(focus)], math.sqrt(left[len(focus)]) * length)
        return np.flatnonzero((part > 0) & (bound * SLACK >= least))

    def scores(self, rows: np.ndarray, query: np.ndarray) -> np.ndarray:
        """Whole-number products of ``rows`` with the query, a count for each term."""
        size = self.first[rows + 1] - self.first[rows]
        begin = np.cumsum(size) - size
        at = np.arange(int(size.sum())) + np.repeat(self.first[rows] - begin, size)
        return np.add.reduceat(self.value[at] * query[self.term[at]], begin)


class Best:
    """The best ``k`` documents of each query so far, ties to the smaller id, no id last."""

    def __init__(self, least: np.ndarray, k: int):
        self.k, self.least = k, least.astype(np.float64)
        self.score = [np.zeros(0, np.int64)] * len(least)
        self.id = [np.zeros(0, np.int64)] * len(least)
        self.none = [np.zeros(0, bool)] * len(least)

    def add(self, q: int, score: np.ndarray, ids: np.ndarray, none: np.ndarray) -> None:
        keep = score >= max(self.least[q], 1)
        score = np.concatenate([self.score[q], score[keep]])
        ids, none = np.concatenate([self.id[q], ids[keep]]), np.concatenate([self.none[q], none[keep]])
        order = np.lexsort((ids, none, -score))[:self.k]
        self.score[q], self.id[q], self.none[q] = score[order], ids[order], none[order]
        if len(order) == self.k:
            self.least[q] = max(self.least[q], float(score[order[-1]]))


def buckets(norm: np.ndarray) -> Iterator[tuple[int, int]]:
    """Spans of rows, in order of length, of similar length."""
    at = 0
    while at < len(norm):
        shorter = int(np.searchsorted(-norm, -SIMILAR * norm[at], "right"))
        end = min(max(shorter, at + LEAST_ROWS), at + BUCKET_ROWS, len(norm))
        yield at, end
        at = end


def search(rows: DataFrame, sent, least: np.ndarray, k: int) -> DataFrame:
    """``item, _id, score``: of each task the best ``k`` of each item that reach its ``least``."""
    first_least = rows.sparkSession.sparkContext.broadcast(least)
    schema = pa.schema([("item", pa.int32()), ("_id", pa.int64()), ("score", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked: Queries = sent.value
        best = Best(first_least.value, k)
        terms = len(asked.one)
        query = np.zeros(terms, np.int64)
        for batch in batches:
            norm_all = batch.column(1).to_numpy()
            order = np.argsort(-norm_all, kind="stable")
            sorted_rows = batch.take(pa.array(order))
            for a, b in buckets(norm_all[order]):
                own = sorted_rows.slice(a, b - a)
                none = own.column(0).is_null().to_numpy(zero_copy_only=False)
                ids = own.column(0).cast(pa.int64()).fill_null(0).to_numpy()
                first, term = _unpacked(own.column(2), np.int32)
                _, value = _unpacked(own.column(3), np.int64)
                bucket = Bucket(own.column(1).to_numpy(), first, term, value, terms)
                for q in range(asked.rows):
                    span = slice(asked.first[q], asked.first[q + 1])
                    term_q, count = asked.term[span], asked.count[span]
                    found = bucket.candidates(term_q, count, max(best.least[q], 1))
                    if len(found):
                        query[term_q] = count
                        best.add(q, bucket.scores(found, query), ids[found], none[found])
                        query[term_q] = 0
        size = [len(s) for s in best.score]
        if sum(size):
            ids = pa.array(np.concatenate(best.id), mask=np.concatenate(best.none))
            yield pa.RecordBatch.from_arrays([
                pa.array(np.repeat(np.arange(len(size)), size).astype(np.int32)), ids,
                pa.array(np.concatenate(best.score))], schema=schema)

    return rows.mapInArrow(run, "item int, _id long, score long")


def _search_round(docs: DataFrame, items: DataFrame, arrow_kind, k: int) -> DataFrame:
    """``item_key, _id, score`` of the best ``k`` documents for items of a bounded size."""
    spark = docs.sparkSession
    table = items.toArrow()
    asked = queries_of(table.column("_text"))
    sent = spark.sparkContext.broadcast(asked)
    told = profile(docs, sent, arrow_kind)
    weight, n_docs, total = weights_of(told, len(asked.one))
    rows = vectors(told, weight, n_docs, total)
    best = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("_id"))
    least = np.zeros(asked.rows)
    count, = rows.agg(F.count("*")).first()
    if count:
        # The longest vectors first: their scores bound those that can matter elsewhere.
        share = max(0.0, 1 - FIRST_ROWS / count)
        long_enough, = rows.agg(F.percentile_approx("norm", F.lit(share), F.lit(10_000))).first()
        seeds = search(rows.where(F.col("norm") >= long_enough), sent, least, k)
        ranked = seeds.withColumn("rank", F.row_number().over(best)).where(F.col("rank") == k)
        for r in ranked.collect():
            least[r["item"]] = r["score"]
    length = np.sqrt(np.add.reduceat(np.append(asked.count, 0).astype(np.float64) ** 2, asked.first[:-1])) \
        if asked.rows else np.zeros(0)
    busy = np.diff(asked.first) > 0
    shortest = float((np.maximum(least, 1)[busy] / length[busy]).min()) / SLACK if busy.any() else 0.0
    hits = search(rows.where(F.col("norm") >= shortest), sent, least, k)
    names = spark.createDataFrame(
        pa.table({"item": pa.array(np.arange(asked.rows), pa.int32()), "item_key": table.column("_item")}))
    ranked = hits.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    # As many rows as items were sent.
    return ranked.join(F.broadcast(names), "item").select("item_key", "rank", "_id", "score")


def rank(
    docs: DataFrame, items: DataFrame, k: int = K, id_col: str = "doc_id", text_col: str = "text",
    item_col: str = "item_id", item_text_col: str = "text", item_bytes: int = ITEM_BYTES,
) -> DataFrame:
    """``item_col``, ``rank``, ``id_col``, ``score`` of the ``k`` best documents of each item.

    Only scores above 0 count; equal scores are in ascending order of the document's id.
    """
    own = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"))
    _, arrow_kind = _id_type(own, "_id")
    asked = items.select(F.col(item_col).alias("_item"), F.col(item_text_col).cast("string").alias("_text")) \
        .where(F.col("_text").isNotNull()).distinct()
    size = asked.agg(F.sum(F.octet_length("_text"))).first()[0] or 0
    rounds = max(1, math.ceil(size / item_bytes))
    if rounds > 1:
        asked = materialize(asked.withColumn("_round", F.pmod(F.xxhash64("_item", "_text"), F.lit(rounds))), "items")
    out = None
    for i in range(rounds):
        part = asked.where(F.col("_round") == i).drop("_round") if rounds > 1 else asked
        hits = _search_round(own, part, arrow_kind, k)
        out = hits if out is None else out.unionByName(hits)
    kind = docs.schema[id_col].dataType
    return out.select(
        F.col("item_key").cast(items.schema[item_col].dataType).alias(item_col), "rank",
        F.col("_id").cast(kind).alias(id_col), "score")


# The same over `documents` and `benchmark`.
SQL = r"""
WITH t AS (
  SELECT d.doc_id, d.uid,
         translate(unnest(regexp_extract_all(d.text, '[0-9A-Za-z\x{80}-\x{10FFFF}]+')),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term
  FROM (SELECT doc_id, text, row_number() OVER () AS uid FROM documents) d),
tf AS (SELECT uid, any_value(doc_id) AS doc_id, term, count(*)::BIGINT AS tf FROM t GROUP BY uid, term),
n AS (SELECT uid, sum(tf)::BIGINT AS n FROM tf GROUP BY uid),
g AS (SELECT count(*)::BIGINT AS docs, sum(n)::BIGINT AS total FROM n),
w AS (
  SELECT term, floor(1000 * ln((2 * any_value(g.docs) + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w
  FROM tf, g GROUP BY term),
q AS (
  SELECT item_id, text, term, count(*)::BIGINT AS c
  FROM (SELECT item_id, text, translate(unnest(regexp_extract_all(text, '[0-9A-Za-z\x{80}-\x{10FFFF}]+')),
               'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term
        FROM (SELECT DISTINCT item_id, text FROM benchmark) b) x
  GROUP BY item_id, text, term),
s AS (
  SELECT q.item_id, q.text, tf.uid, any_value(tf.doc_id) AS doc_id,
         sum(q.c * w.w * ((1000000000 * tf.tf) // (1000 * tf.tf + 8 * (25 + (75 * n.n * g.docs) // g.total))))::BIGINT AS score
  FROM q JOIN tf USING (term) JOIN w USING (term) JOIN n ON n.uid = tf.uid, g
  GROUP BY q.item_id, q.text, tf.uid),
r AS (
  SELECT *, row_number() OVER (PARTITION BY item_id, text ORDER BY score DESC, doc_id NULLS LAST)::INTEGER AS rank
  FROM s WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM r WHERE rank <= 10
"""
