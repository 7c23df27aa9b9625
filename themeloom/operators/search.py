"""Nearest vectors, exactly: of one query, many queries, keywords and pairs."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from themeloom.functions import vectors as vx
from themeloom.functions.blocks import Nearest, closest, distances, matrix
from themeloom.operators.scale import checked_broadcast, distinct_keys, spread
from themeloom.operators.stored import Block, in_tasks, packed, read_all, read_blocks, store_blocks
from themeloom.session import materialize, shared_dir
from themeloom.sources.storage import in_reach

# Query vectors sent to every task at once.
MAX_QUERY_BYTES = 64 << 20
# So few are fetched before their size is looked at.
FEW_QUERIES = 1024
# Upper sizes of the blocks that are compared with each other.
QUERY_BLOCK = 8192
ROW_BLOCK = 65536
# Most cells that vectors are laid out in, by the nearest of as many stored vectors.
MAX_CELLS = 256
# An id list this long still becomes a pushed-down filter.
MAX_LITERAL_IDS = 1000
# Vectors shorter than this are not told apart by angle when cells are pruned, and room for
# the rounding of bounds, which are squared distances.
SHORT = 0.1
SLACK = 1e-5


def get_by_ids(collection: DataFrame, ids: DataFrame | Sequence, key: str = "id") -> DataFrame:
    """The stored rows of a pool; unknown ids are ignored.

    A short id list becomes a filter of the scan, a table a semi join.
    """
    if isinstance(ids, DataFrame):
        pool = ids.select(F.col(ids.columns[0]).alias(key)).distinct()
        return collection.join(checked_broadcast(pool), key, "left_semi")
    if len(ids) <= MAX_LITERAL_IDS:
        return collection.where(F.col(key).isin(list(ids)))
    spark = collection.sparkSession
    table = spark.createDataFrame([(i,) for i in ids], T.StructType([collection.schema[key]]))
    return get_by_ids(collection, table, key)


def scored(hits: DataFrame) -> DataFrame:
    return hits.withColumn("score", vx.score(F.col("d"))).withColumn("distance", F.round("d", 4))


def nearest_to_vector(
    collection: DataFrame, vector: Sequence[float], k: int = 10, metric: str = "l2sq"
) -> DataFrame:
    """(rank, code, name, score, distance) of the ``k`` nearest to one vector."""
    target = F.array(*[F.lit(float(x)) for x in vector])
    return _take(collection, target, k, metric)


def similar_to_id(
    collection: DataFrame, key, k: int = 10, metric: str = "l2sq"
) -> DataFrame:
    """The ``k`` nearest to a stored id, without itself; none if the id is unknown.

    The stored vector is looked up once, as a scalar subquery of the same scan.
    """
    target = collection.where(F.col("id") == key).agg(F.max("embedding")).scalar()
    return _take(collection.where(F.col("id") != key), target, k, metric)


def _take(collection: DataFrame, target, k: int, metric: str) -> DataFrame:
    hits = (
        collection.withColumn("_target", target)
        .where(F.col("embedding").isNotNull() & F.col("_target").isNotNull())
        .select("id", "stock_name", vx.distance(F.col("embedding"), F.col("_target"), metric).alias("d"))
        .orderBy("d", "id").limit(k)
    )
    # The window runs over the k rows left, not over the collection.
    numbered = hits.withColumn("rank", F.row_number().over(Window.orderBy("d", "id")))
    return scored(numbered).select(
        F.col("rank"), F.col("id").alias("code"), F.col("stock_name").alias("name"), "score", "distance"
    )


def ranked(hits: DataFrame, by: Sequence[str] = ("d", "id"), per: str = "query_id") -> DataFrame:
    """Add the 1-based ``rank`` of the hits of each query, of which there are a few."""
    return hits.withColumn("rank", F.row_number().over(Window.partitionBy(per).orderBy(*by)))


def nearest(
    queries: DataFrame,
    collection: DataFrame,
    k: int,
    metric: str = "l2sq",
    key: str = "id",
    payload: Sequence[str] = (),
    skip_self: bool = False,
    query_bytes: int | None = None,
) -> DataFrame:
    """(query_id, rank, id, *payload, d): exact ``k`` nearest rows per query.

    ``queries`` has (query_id, embedding) with unique ids, ``collection`` one row
    per id.  Queries of at most ``query_bytes`` (``MAX_QUERY_BYTES`` by default) go to
    every task, which scans its part of the collection and passes on ``k`` rows per
    query; the collection is not moved.  More queries are compared block by block
    (see :func:`_nested`).
    """
    query_bytes = MAX_QUERY_BYTES if query_bytes is None else query_bytes
    if metric not in vx.METRICS:
        raise ValueError(f"metric must be one of {vx.METRICS}, not {metric!r}")
    asked = queries.select("query_id", F.col("embedding").cast("array<double>").alias("embedding")) \
        .where(F.col("embedding").isNotNull())
    rows = collection.select(F.col(key).alias("id"), *payload, "embedding") \
        .where(F.col("embedding").isNotNull())
    table = _fetched(asked, query_bytes)
    if table is not None:
        return _best(_scan(asked, table, rows, k, metric, skip_self), k)
    return _best(_nested(asked, rows, k, metric, skip_self), k)


def _best(found: DataFrame, k: int) -> DataFrame:
    columns = [c for c in found.columns if c not in ("query_id", "rank", "d")]
    if "rank" not in found.columns:
        found = ranked(found).where(F.col("rank") <= k)
    return found.select("query_id", "rank", *columns, "d")


def _hit_schema(queries: DataFrame, rows: DataFrame, ranks: bool = False) -> T.StructType:
    fields = [queries.schema["query_id"], T.StructField("d", T.DoubleType())]
    fields += [T.StructField("rank", T.IntegerType())] if ranks else []
    fields += [f for f in rows.schema.fields if f.name != "embedding"]
    return T.StructType([T.StructField(f.name, f.dataType, True) for f in fields])


def _fetched(queries: DataFrame, query_bytes: int) -> pa.Table | None:
    """The queries, unless they hold more than ``query_bytes``."""
    table = queries.limit(FEW_QUERIES + 1).toArrow()
    if not table.num_rows:
        return table
    limit = max(1, query_bytes // (8 * max(len(table.column("embedding")[0]), 1)))
    if table.num_rows > FEW_QUERIES and limit > FEW_QUERIES:
        table = queries.limit(limit + 1).toArrow()
    return table if table.num_rows <= limit else None


def _scan(queries: DataFrame, table: pa.Table, rows: DataFrame, k, metric, skip_self) -> DataFrame:
    spark = rows.sparkSession
    schema = _hit_schema(queries, rows)
    sent = spark.sparkContext.broadcast((
        table.column("query_id").combine_chunks(), matrix(table.column("embedding")),
    ))
    arrow = to_arrow_schema(schema)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, vectors = sent.value
        state = Nearest(ids, vectors, k, metric, skip_self)
        for batch in batches:
            if batch.num_rows and len(vectors):
                whole = pa.Table.from_batches([batch])
                state.add(whole.drop_columns(["embedding"]), matrix(whole.column("embedding")))
        for hits in state.results(arrow):
            yield from hits.to_batches()

    return spread(rows).mapInArrow(scan, schema)


def _place(spark: SparkSession, pivots: np.ndarray, metric: str):
    """A function that tells the nearest pivot of each vector, and the distance to it.

    Angles are compared as distances of unit vectors; one too short for that lies
    nowhere, so its gap has no bound.
    """
    sent = spark.sparkContext.broadcast(pivots)

    def place(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        x, nowhere = _flat(vectors, metric)
        cell = closest(x, sent.value)
        return cell, np.where(nowhere, np.inf, np.sqrt(((x - sent.value[cell]) ** 2).sum(axis=1)))

    return place


def _cells(rows: DataFrame, pivots: np.ndarray, metric: str) -> DataFrame:
    """Add ``_cell``, the nearest pivot, and ``_gap``, the distance to it."""
    schema = T.StructType(rows.schema.fields + [
        T.StructField("_cell", T.IntegerType()), T.StructField("_gap", T.DoubleType())])
    place = _place(rows.sparkSession, pivots, metric)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                cell, gap = place(matrix(batch.column("embedding")))
                yield pa.RecordBatch.from_arrays(
                    batch.columns + [pa.array(cell, pa.int32()), pa.array(gap)], batch.schema.names + ["_cell", "_gap"])

    return spread(rows).mapInArrow(run, schema)


def _flat(x: np.ndarray, metric: str) -> tuple[np.ndarray, np.ndarray]:
    """Vectors whose Euclidean order is that of the metric, and which of them have no place."""
    if metric != "cosine":
        return x, np.zeros(len(x), bool)
    size = np.sqrt((x * x).sum(axis=1))
    return x / np.maximum(size, SHORT)[:, None], size < SHORT


def _pivots(rows: DataFrame, cells: int, metric: str) -> np.ndarray:
    """Stored vectors far from one another, chosen from a bounded sample."""
    sample = rows.orderBy(F.xxhash64("id")).limit(4 * cells).select(
        F.col("embedding").cast("array<double>").alias("embedding")).toArrow()
    x, _ = _flat(matrix(sample.column("embedding")), metric)
    chosen = [0]
    gap = distances(x[:1], x, "l2sq")[0]
    while len(chosen) < min(cells, len(x)):
        chosen.append(int(gap.argmax()))
        gap = np.minimum(gap, distances(x[chosen[-1:]], x, "l2sq")[0])
    return x[chosen]


def _laid_out(rows: DataFrame, pivots: np.ndarray, key: str, block: int, metric: str) -> tuple[DataFrame, list]:
    """Rows stored with ``_cell`` and ``_part``, and (cell, parts, rows, least gap, largest gap) of each cell.

    A cell of any size, such as that of a vector in a third of all rows, is cut into
    parts of about ``block`` rows.
    """
    stored = materialize(_cells(rows, pivots, metric), "cells")
    told = stored.groupBy("_cell").agg(F.count("*").alias("n"), F.min("_gap").alias("lo"), F.max("_gap").alias("hi"))
    cells = [(r["_cell"], math.ceil(r["n"] / block), r["n"], r["lo"], r["hi"]) for r in told.collect()]
    parts = [1] * len(pivots)
    for cell, n, *_ in cells:
        parts[cell] = n
    of_cell = F.get(F.array(*[F.lit(n) for n in parts]), F.col("_cell"))
    part = F.pmod(F.xxhash64(key), of_cell).cast("int").alias("_part")
    return stored.drop("_gap").select("*", part), cells


def _surviving(asked: list, held: list, pivots: np.ndarray, need: int) -> list[tuple[int, int, int, int]]:
    """(query cell, its parts, row cell, its parts) of the pairs that can hold a result.

    By the triangle inequality the ``need`` nearest of every query of a cell lie within
    the bound of the cells around it that hold as many rows together; a cell of rows
    that lies wholly beyond has none of them.
    """
    held = sorted(held)
    at = pivots[[h[0] for h in held]]
    rows = np.array([h[2] for h in held])
    hi = np.array([h[4] for h in held])
    lo = np.where(np.isfinite(hi), [h[3] for h in held], 0)
    out = []
    for cell, parts, _, _, reach in asked:
        between = np.sqrt(((at - pivots[cell]) ** 2).sum(axis=1))
        most = between + reach + hi
        order = np.argsort(most, kind="stable")
        enough = np.flatnonzero(np.cumsum(rows[order]) >= need)
        limit = most[order[enough[0]]] if len(enough) else np.inf
        # A reach without bound leaves every cell in.
        least = np.zeros(len(held))
        if np.isfinite(reach):
            bounded = np.isfinite(hi)
            least[bounded] = np.maximum(between - reach - hi, lo - between - reach)[bounded]
        for i in np.flatnonzero(~(np.maximum(least, 0) ** 2 > limit ** 2 * (1 + SLACK) + SLACK)):
            out.append((int(cell), int(parts), int(held[i][0]), int(held[i][1])))
    return out


def _nested(asked: DataFrame, rows: DataFrame, k: int, metric: str, skip_self: bool) -> DataFrame:
    """Hits of blocks of queries with blocks of rows.

    Queries and rows are stored once, in blocks by cell, the nearest of a few stored
    vectors.  Pairs of cells that cannot hold a result are left out by their centers and
    radii, of which there are ``MAX_CELLS`` at most.  A task takes a block of queries and
    reads the blocks of rows one after another, so hits at most are moved, and no query and
    no row passes through the driver.  Only where tasks cannot open the shared folder the
    blocks are shuffled to meet.
    """
    spark = asked.sparkSession
    n_rows = rows.count()
    cells = min(MAX_CELLS, max(math.ceil(asked.count() / QUERY_BLOCK), math.ceil(n_rows / ROW_BLOCK)))
    if cells <= 1 or not n_rows:
        # One block with one block: nothing to lay out.
        on = ["_q", "_q_part", "_r", "_r_part"]
        here = [F.lit(0).alias(c) for c in on]
        return _compare(asked.select("*", *here), rows.select("*", *here), on, k, metric, skip_self)
    pivots = _pivots(rows, cells, metric)
    if not in_reach(spark, shared_dir(spark)):
        return _shuffled(asked, rows, pivots, k, metric, skip_self)
    place = _place(spark, pivots, metric)
    left = store_blocks(asked, "queries", QUERY_BLOCK, place)
    right = store_blocks(rows, "rows", ROW_BLOCK, place)
    meet: dict[int, list[int]] = {}
    for q, _, r, _ in _surviving(_of_cells(left), _of_cells(right), pivots, k + int(skip_self)):
        meet.setdefault(q, []).append(r)
    units = [(part, meet[q]) for q in sorted(meet) for part in packed([b for b in left if b.cell == q], QUERY_BLOCK)]
    # Few blocks of queries share the rows out, to occupy the cores.
    parts = max(1, math.ceil(spark.sparkContext.defaultParallelism / max(len(units), 1)))
    units = [(*unit, i, parts) for unit in units for i in range(parts)]
    held = spark.sparkContext.broadcast(right)
    folder = shared_dir(spark)
    # A query that meets all its rows in one task is ranked there.
    schema = _hit_schema(asked, rows, ranks=parts == 1 and distinct_keys(asked, "query_id"))
    arrow = to_arrow_schema(schema)
    payload = [f for f in schema.names if f not in ("query_id", "d", "rank")]

    def compare(unit) -> Iterator[pa.RecordBatch]:
        blocks, cells, part, parts = unit
        queries, vectors = read_all(folder, blocks)
        state = Nearest(queries.column("query_id").combine_chunks(), vectors, k, metric, skip_self)
        wanted = [b for b in held.value if b.cell in set(cells)][part::parts]
        for found, x in read_blocks(folder, wanted, ROW_BLOCK):
            state.add(found.select(payload), x)
        for hits in state.results(arrow):
            yield from hits.to_batches()

    return in_tasks(spark, units, compare, schema)


def _of_cells(blocks: list[Block]) -> list[tuple]:
    """(cell, 1, rows, least gap, largest gap) of each cell."""
    of: dict[int, list[Block]] = {}
    for b in blocks:
        of.setdefault(b.cell, []).append(b)
    return [(c, 1, sum(b.rows for b in own), min(b.lo for b in own), max(b.hi for b in own)) for c, own in of.items()]


def _shuffled(
    asked: DataFrame, rows: DataFrame, pivots: np.ndarray, k: int, metric: str, skip_self: bool
) -> DataFrame:
    """The same with blocks of queries and rows moved to a task for each pair."""
    on = ["_q", "_q_part", "_r", "_r_part"]
    left, asked_cells = _laid_out(asked, pivots, "query_id", QUERY_BLOCK, metric)
    right, row_cells = _laid_out(rows, pivots, "id", ROW_BLOCK, metric)
    pairs = _surviving(asked_cells, row_cells, pivots, k + int(skip_self))
    # At most MAX_CELLS * MAX_CELLS rows.
    pairs = F.broadcast(asked.sparkSession.createDataFrame(pairs, "_q int, _q_parts int, _r int, _r_parts int"))
    every = lambda parts: F.explode(F.sequence(F.lit(0), F.col(parts) - 1))
    left = left.withColumnRenamed("_cell", "_q").withColumnRenamed("_part", "_q_part").join(pairs, "_q") \
        .withColumn("_r_part", every("_r_parts"))
    right = right.withColumnRenamed("_cell", "_r").withColumnRenamed("_part", "_r_part").join(pairs, "_r") \
        .withColumn("_q_part", every("_q_parts"))
    return _compare(
        left.select("query_id", "embedding", *on), right.select(*rows.columns, *on), on, k, metric, skip_self)


def _compare(queries: DataFrame, rows: DataFrame, on: list[str], k, metric, skip_self) -> DataFrame:
    """Nearest rows within each pair of blocks; both sides carry the keys ``on``."""
    schema = _hit_schema(queries, rows.drop(*on))
    arrow = to_arrow_schema(schema)
    payload = [f for f in schema.names if f not in ("query_id", "d")]

    def pair(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return arrow.empty_table()
        state = Nearest(
            left.column("query_id").combine_chunks(), matrix(left.column("embedding")),
            k, metric, skip_self,
        )
        state.add(right.select(payload), matrix(right.column("embedding")))
        return state.result(arrow)

    return queries.groupBy(*on).cogroup(rows.groupBy(*on)).applyInArrow(pair, schema)


def topk(
    queries: DataFrame, collection: DataFrame, k: int = 10, metric: str = "l2sq",
    skip_self: bool = False, query_bytes: int | None = None,
) -> DataFrame:
    """(query_id, rank, code, name, score, distance) for many queries at once."""
    hits = nearest(queries, collection, k, metric, "id", ["stock_name"], skip_self, query_bytes)
    return scored(hits).select(
        "query_id", "rank", F.col("id").alias("code"), F.col("stock_name").alias("name"),
        "score", "distance",
    )


def similar_to(
    collection: DataFrame, ids: DataFrame | Sequence, k: int = 10, metric: str = "l2sq"
) -> DataFrame:
    """Nearest to each stored id, itself excluded; unknown ids give no rows."""
    wanted = get_by_ids(collection, ids).select(F.col("id").alias("query_id"), "embedding")
    return topk(wanted, collection, k, metric, skip_self=True)


def topk_keywords(
    centroids: DataFrame, keywords: DataFrame, k: int = 10, metric: str = "l2sq"
) -> DataFrame:
    """(cluster_id, rank, keyword, score, doc_freq) nearest to each centroid."""
    queries = centroids.select(F.col("cluster_id").alias("query_id"), "embedding")
    hits = nearest(queries, keywords, k, metric, "keyword", ["doc_freq"])
    return scored(hits).select(
        F.col("query_id").alias("cluster_id"), "rank", F.col("id").alias("keyword"), "score",
        F.coalesce("doc_freq", F.lit(0)).alias("doc_freq"),
    )


def score_pairs(pairs: DataFrame, collection: DataFrame) -> DataFrame:
    """(id_a, id_b, cosine) for given id pairs; unknown ids are ignored."""
    vectors = checked_broadcast(collection.select("id", "embedding"), max_rows=20_000)
    a = vectors.select(F.col("id").alias("id_a"), F.col("embedding").alias("va"))
    b = vectors.select(F.col("id").alias("id_b"), F.col("embedding").alias("vb"))
    return pairs.join(a, "id_a").join(b, "id_b").select(
        "id_a", "id_b", F.round(vx.cosine(F.col("va"), F.col("vb")), 4).alias("cosine")
    )


def assign_lists(rows: DataFrame, centers: np.ndarray, out: str = "list") -> DataFrame:
    """Add the number of the nearest center; ``centers`` is small by construction."""
    schema = T.StructType(rows.schema.fields + [T.StructField(out, T.IntegerType())])
    sent = rows.sparkSession.sparkContext.broadcast(centers)

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                near = closest(matrix(batch.column("embedding")), sent.value)
                yield pa.RecordBatch.from_arrays(
                    batch.columns + [pa.array(near, pa.int32())], batch.schema.names + [out]
                )

    return spread(rows).mapInArrow(label, schema)
