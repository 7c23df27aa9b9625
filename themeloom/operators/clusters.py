"""Clustering a pool of vectors."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from themeloom.functions import vectors as vx
from themeloom.functions.blocks import closest, matrix
from themeloom.operators.scale import checked_broadcast
from themeloom.operators.search import assign_lists, nearest
from themeloom.session import materialize

# First seed and number of starts of a clustering.
SEED = 42
STARTS = 10
MAX_ITERATIONS = 300
ROWS_PER_TASK = 20_000


def as_double(c="embedding"):
    return F.col(c).cast("array<double>")


def centroids(vectors: DataFrame, group: str | None = None) -> DataFrame:
    """(cluster_id, embedding): mean vector per group, or of all rows as cluster 0.

    Sums are combined before the shuffle, so a group of any size sends one
    partial vector per task.  Means are not scaled to length one.
    """
    mean = vector_to_array(Summarizer.mean(array_to_vector(as_double()))).alias("embedding")
    # Grouping by a constant gives no row for a pool without rows.
    key = F.lit(0) if group is None else F.col(group)
    known = vectors.where(F.col("embedding").isNotNull())
    return known.groupBy(key.alias("cluster_id")).agg(mean)


def cluster_sizes(labels: DataFrame) -> DataFrame:
    """(cluster_id, size), largest first, equal sizes by id."""
    return labels.groupBy("cluster_id").agg(F.count("*").alias("size")).orderBy(
        F.desc("size"), "cluster_id"
    )


def representatives(labelled: DataFrame, centers: DataFrame) -> DataFrame:
    """(cluster_id, rep_code, rep_name): the member nearest to its centroid.

    ``labelled`` has (id, stock_name, embedding, cluster_id); of equal distances
    the smallest code counts.
    """
    # Written once, so that counting it does not compute the centroids again.
    known = materialize(centers.select("cluster_id", F.col("embedding").alias("middle")), "centers")
    middle = checked_broadcast(known, max_rows=20_000)
    gap = F.sqrt(vx.squared_gap(F.col("embedding"), F.col("middle")))
    return (
        labelled.join(middle, "cluster_id")
        .select("cluster_id", F.struct("id", "stock_name").alias("who"), F.struct(gap.alias("d"), "id").alias("at"))
        .groupBy("cluster_id").agg(F.min_by("who", "at").alias("who"))
        .select("cluster_id", F.col("who.id").alias("rep_code"), F.col("who.stock_name").alias("rep_name"))
    )


def assign(vectors: DataFrame, centers: DataFrame) -> DataFrame:
    """Add the ``cluster_id`` of the nearest centroid, of equals the smallest.

    Up to ``MAX_CENTERS`` centroids go to every task.  More of them are searched
    block by block, with the vectors as queries; every row is its own query, also
    if ids repeat.  A row without a vector has no cluster.
    """
    known = _collect_centers(centers)
    kind = centers.schema["cluster_id"].dataType
    has = F.col("embedding").isNotNull()
    none = vectors.where(~has).withColumn("cluster_id", F.lit(None).cast(kind))
    if known is None:
        # Written once, so that the numbers of the rows stay.
        rows = materialize(
            vectors.where(has).withColumn("_row", F.monotonically_increasing_id()), "rows")
        near = nearest(
            rows.select(F.col("_row").alias("query_id"), "embedding"), centers, 1, key="cluster_id")
        found = rows.join(
            near.select(F.col("query_id").alias("_row"), F.col("id").cast(kind).alias("cluster_id")), "_row"
        ).drop("_row")
        return found.unionByName(none)
    ids = F.array(*[F.lit(i).cast(kind) for i, _ in known])
    rows = assign_lists(vectors.where(has), np.array([v for _, v in known]), "_at")
    return rows.withColumn("cluster_id", F.get(ids, F.col("_at"))).drop("_at").unionByName(none)


MAX_CENTERS = 10_000


def _collect_centers(centers: DataFrame) -> list[tuple[int, list[float]]] | None:
    rows = centers.select("cluster_id", "embedding").limit(MAX_CENTERS + 1).collect()
    if len(rows) > MAX_CENTERS:
        return None
    return sorted((r.cluster_id, list(r.embedding)) for r in rows)


def update(vectors: DataFrame, label: str = "cluster_id") -> DataFrame:
    """Centroids of the labelled vectors: the second half of an iteration."""
    return centroids(vectors, label)


@dataclass(frozen=True)
class Clustering:
    """``labelled`` rows carry ``cluster_id``; ``centers`` has (cluster_id, embedding)."""

    labelled: DataFrame
    centers: DataFrame
    cost: float

    @property
    def labels(self) -> DataFrame:
        return self.labelled.select(F.col("id").alias("code"), "cluster_id")

    @property
    def members(self) -> DataFrame:
        """The stocks of each cluster, one row per stock."""
        return self.labelled.select("cluster_id", F.col("id").alias("code"), F.col("stock_name").alias("name"))

    @property
    def clusters(self) -> DataFrame:
        """(cluster_id, size, rep_code, rep_name)."""
        return cluster_table(self.labelled, self.centers)


def cluster_table(labelled: DataFrame, centers: DataFrame) -> DataFrame:
    """Size and representative of each cluster of labelled vectors."""
    return (
        labelled.groupBy("cluster_id").agg(F.count("*").alias("size"))
        .join(representatives(labelled, centers), "cluster_id")
        .orderBy("cluster_id")
    )


def kmeans(pool: DataFrame, k: int = 3, seed: int = SEED, starts: int = STARTS) -> Clustering:
    """Cluster (id, stock_name, embedding) into at most ``k`` groups.

    The best of ``starts`` runs by cost is kept.  All starts advance in one pass over
    the rows per iteration; those that have settled rest.  A pool that fits in a task
    is clustered there in one job.  Clusters are numbered by
    their smallest member code, so equal partitions get equal numbers.  A pool of one,
    or ``k`` below two, is one cluster; an empty pool gives no rows.  Rows without a
    vector are left out.
    """
    pool = pool.where(F.col("embedding").isNotNull())
    n = pool.count()
    k = min(k, n)
    if k < 2:
        return single_cluster(pool)
    if n <= ROWS_PER_TASK:
        best, cost, order = _settled_in_one_task(pool, k, seed, starts)
    else:
        best, cost, order = _settled_over_tasks(pool, n, k, seed, starts)
    number = {p: i for i, p in enumerate(order)}
    lookup = F.array(*[F.lit(number.get(p, -1)) for p in range(k)])
    labelled = assign_lists(pool, best, "_p").withColumn("cluster_id", F.get(lookup, F.col("_p"))).drop("_p")
    middle = pool.sparkSession.createDataFrame(
        [(i, best[p].tolist()) for i, p in enumerate(order)], "cluster_id int, embedding array<double>")
    return Clustering(labelled, middle, cost)


def _first_centers(sample: np.ndarray, k: int, seed: int, starts: int) -> np.ndarray:
    return np.stack([_spread_out(sample, k, np.random.default_rng(seed + s)) for s in range(starts)])


def _settled_in_one_task(pool: DataFrame, k: int, seed: int, starts: int) -> tuple[np.ndarray, float, list[int]]:
    """Best centers, their cost, and their numbers by smallest member; all passes run where the rows are.

    The rows fit in a task, so a pass over them is no job of its own.
    """
    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        rows = pa.Table.from_batches(held).sort_by([("h", "ascending"), ("id", "ascending")])
        x = matrix(rows.column("embedding"))

        def measured(centers: np.ndarray):
            found = _empty(len(centers), k, x.shape[1])
            _add(found, x, centers)
            return found

        centers, cost = _iterate(_first_centers(x[:max(SEEDED_FROM, 2 * k)], k, seed, starts), measured)
        best = int(np.argmin(cost))
        label = closest(x, centers[best])
        first = {}
        for p, i in zip(label.tolist(), rows.column("id").to_pylist()):
            first[p] = min(i, first.get(p, i))
        order = sorted(first, key=first.get)
        yield pa.RecordBatch.from_arrays([
            pa.array([centers[best].tobytes()], pa.binary()), pa.array([float(cost[best])]),
            pa.array([order], pa.list_(pa.int32()))], names=["centers", "cost", "numbers"])

    told = (
        pool.select(F.xxhash64("id").alias("h"), "id", as_double().alias("embedding"))
        .repartition(1).mapInArrow(settle, "centers binary, cost double, numbers array<int>").first()
    )
    return np.frombuffer(bytes(told["centers"])).reshape(k, -1), told["cost"], list(told["numbers"])


def _settled_over_tasks(pool: DataFrame, n: int, k: int, seed: int, starts: int) -> tuple[np.ndarray, float, list[int]]:
    """The same with every pass over the rows as a job."""
    # Rows lie where a hash of their id puts them, whatever files they came from.
    tasks = max(1, n // ROWS_PER_TASK)
    held = (
        pool.select("id", as_double().alias("embedding"))
        .repartition(tasks, F.xxhash64("id")).sortWithinPartitions("id")
        .persist(StorageLevel.MEMORY_AND_DISK)
    )
    try:
        sample = matrix(
            held.orderBy(F.xxhash64("id"), "id").limit(max(SEEDED_FROM, 2 * k)).select("embedding").toArrow()
            .column("embedding"))
        centers, cost = _iterate(
            _first_centers(sample, k, seed, starts), lambda centers: _measured_by_tasks(held, tasks, centers))
        best = int(np.argmin(cost))
        placed = assign_lists(held, centers[best], "_p")
        # One row per cluster, k at most.
        order = [r["_p"] for r in placed.groupBy("_p").agg(F.min("id").alias("first")).orderBy("first").collect()]
    finally:
        held.unpersist()
    return centers[best], float(cost[best]), order


# Rows that starting centers are chosen among.
SEEDED_FROM = 4096
# A start has settled when no center moves farther than this.
SETTLED = 1e-4


def _spread_out(rows: np.ndarray, k: int, random: np.random.Generator) -> np.ndarray:
    """``k`` of the rows, each chosen with a chance that grows with its distance from those before."""
    chosen = [int(random.integers(len(rows)))]
    gap = ((rows - rows[chosen[0]]) ** 2).sum(axis=1)
    while len(chosen) < k:
        total = gap.sum()
        nth = random.choice(len(rows), p=gap / total) if total > 0 else random.integers(len(rows))
        chosen.append(int(nth))
        gap = np.minimum(gap, ((rows - rows[chosen[-1]]) ** 2).sum(axis=1))
    return rows[chosen]


def _empty(m: int, k: int, dim: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Cost, sizes and sums of ``m`` starts."""
    return np.zeros(m), np.zeros((m, k)), np.zeros((m, k, dim))


def _add(found: tuple[np.ndarray, np.ndarray, np.ndarray], rows: np.ndarray, centers: np.ndarray) -> None:
    """Count ``rows`` in with the nearest of the centers of every start."""
    m, k, dim = centers.shape
    flat = centers.reshape(m * k, dim)
    size = (flat * flat).sum(axis=1)
    step = max(1, (1 << 21) // (m * k))
    for at in range(0, len(rows), step):
        x = rows[at:at + step]
        gap = (size - 2 * (x @ flat.T)).reshape(len(x), m, k)
        label = gap.argmin(axis=2)
        near = np.take_along_axis(gap, label[:, :, None], 2)[:, :, 0] + (x * x).sum(axis=1)[:, None]
        chosen = (label[:, :, None] == np.arange(k)).astype(float)
        found[0][:] += np.maximum(near, 0).sum(axis=0)
        found[1][:] += chosen.sum(axis=0)
        found[2][:] += (chosen.reshape(len(x), m * k).T @ x).reshape(m, k, dim)


def _iterate(centers: np.ndarray, measured: Callable) -> tuple[np.ndarray, np.ndarray]:
    """Centers (start, cluster, dim) after their iterations, and the cost of each start."""
    centers, cost = centers.copy(), np.full(len(centers), np.inf)
    live = np.arange(len(centers))
    for _ in range(MAX_ITERATIONS + 1):
        found = measured(centers[live])
        cost[live] = found[0]
        old = centers[live]
        moved = np.where(found[1][:, :, None] > 0, found[2] / np.maximum(found[1], 1)[:, :, None], old)
        shift = np.sqrt(((moved - old) ** 2).sum(axis=2)).max(axis=1)
        # A settled start keeps the centers that its cost was measured with.
        going = shift > SETTLED
        centers[live[going]] = moved[going]
        live = live[going]
        if not len(live):
            break
    return centers, cost


def _measured_by_tasks(held: DataFrame, tasks: int, centers: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Cost, sizes and sums of every start over all rows."""
    starts, k, dim = centers.shape
    ddl = "start int, cost double, counts binary, sums binary"
    schema = pa.schema([("start", pa.int32()), ("cost", pa.float64()), ("counts", pa.binary()), ("sums", pa.binary())])
    sent = held.sparkSession.sparkContext.broadcast(centers)

    def emit(cost, counts, sums, which=None):
        which = range(len(cost)) if which is None else sorted(which)
        return pa.RecordBatch.from_arrays([
            pa.array(which, pa.int32()), pa.array([cost[s] for s in which]),
            pa.array([counts[s].tobytes() for s in which], pa.binary()),
            pa.array([sums[s].tobytes() for s in which], pa.binary()),
        ], schema=schema)

    def read(batch, cost, counts, sums, seen=None):
        for start, c, n, x in zip(*(column.to_pylist() for column in batch.columns)):
            if seen is not None:
                seen.add(start)
            cost[start] += c
            counts[start] += np.frombuffer(n).reshape(k)
            sums[start] += np.frombuffer(x).reshape(k, dim)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = _empty(starts, k, dim)
        for batch in batches:
            _add(found, matrix(batch.column("embedding")), sent.value)
        yield emit(*found)

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # One start's sums at a time in memory, however many tasks have sent them; only those of
        # the starts this task was dealt go on.
        found, seen = _empty(starts, k, dim), set()
        for batch in batches:
            read(batch, *found, seen)
        if seen:
            yield emit(*found, seen)

    parts = held.select("embedding").mapInArrow(measure, ddl)
    if tasks > 1:
        parts = parts.repartition(1 + min(8, starts), "start").mapInArrow(total, ddl)
    found = _empty(starts, k, dim)
    for batch in parts.toArrow().to_batches():
        read(batch, *found)
    sent.unpersist()
    return found


def single_cluster(pool: DataFrame) -> Clustering:
    """The whole pool as cluster 0."""
    return Clustering(pool.withColumn("cluster_id", F.lit(0)), centroids(pool), 0.0)
