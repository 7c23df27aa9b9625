"""Exact top-k by inner product with cover trees of queries and data.

Queries are indexed by one cover tree; the rows that a task reads are indexed by cover
trees of ``TREE_ROWS`` rows.  Both are searched together: a pair of nodes is left when the
largest inner product that their covering radii allow is below the worst kth score of the
queries in the group.  The kth score of a query is known to be at least that among the
other queries before the first row is read, and only gets better within a task.

Queries go to the tasks in rounds of at most ``ROUND_BYTES``; data stays where it is.
A task returns at most ``k`` rows a query, and none that the known kth score rules out.

Scores are exact: components are whole numbers, multiplied as doubles where no sum can
exceed 2^53 and as unbounded integers otherwise (then held within a long).

Defined results: vectors null, or with null or non-finite components, take no part; only
vectors of one length are compared; ties go to the smaller id; rows that repeat id and
vector count once; a query is not compared with rows of its own id; rows without id take
no part; a query without any other vector has no rows; other columns are left aside.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

K = 10
SCALE = 1024
TREE_ROWS = 4096
LEAF = 32
ROUND_BYTES = 16 << 20
HELD = 2**63 - 1
LOWEST = np.iinfo(np.int64).min


class CoverTree:
    """Nodes over rows of ``points``: centers whose children cover half its radius each."""

    def __init__(self, points: np.ndarray):
        self.points = points
        self.order = np.arange(len(points))
        self.center: list[np.ndarray] = []
        self.norm: list[float] = []
        self.radius: list[float] = []
        self.span: list[tuple[int, int]] = []
        self.children: list[list[int]] = []
        if len(points):
            self._grow(0, len(points))

    def _grow(self, begin: int, end: int) -> None:
        waiting = [(begin, end, None)]
        while waiting:
            begin, end, parent = waiting.pop()
            rows = self.order[begin:end]
            own = self.points[rows]
            center = own[0]
            away = np.sqrt(((own - center) ** 2).sum(axis=1))
            radius = float(away.max())
            node = len(self.center)
            self.center.append(center)
            self.norm.append(float(np.sqrt((center * center).sum())))
            # A little more than measured, so that rounding never prunes.
            self.radius.append(radius * (1 + 1e-9))
            self.span.append((begin, end))
            self.children.append([])
            if parent is not None:
                self.children[parent].append(node)
            if end - begin <= LEAF or radius == 0:
                continue
            # Centers farther apart than half the radius, until all rows are covered.
            label, nearest, count = np.zeros(len(rows), np.int64), away, 1
            while nearest.max() > radius / 2 and count < len(rows):
                far = own[int(nearest.argmax())]
                reach = np.sqrt(((own - far) ** 2).sum(axis=1))
                label[reach < nearest] = count
                nearest = np.minimum(nearest, reach)
                count += 1
            by = np.lexsort((nearest, label))
            self.order[begin:end] = rows[by]
            sizes = np.bincount(label, minlength=count)
            at = begin
            small: list[int] = []
            for size in sizes:
                # Children too small for a node of their own share one with their neighbours.
                if small and (small[1] - small[0] + size > LEAF or size > LEAF // 2):
                    waiting.append((*small, node))
                    small = []
                if size > LEAF // 2:
                    waiting.append((at, at + int(size), node))
                elif size:
                    small = [small[0] if small else at, at + int(size)]
                at += int(size)
            if small:
                waiting.append((*small, node))


class Best:
    """The k best (score, id) of every query so far."""

    def __init__(self, queries: int, k: int):
        self.scores = np.full((queries, k), LOWEST, np.int64)
        self.ids = np.full((queries, k), np.iinfo(np.int64).max, np.int64)
        self.k = k
        # What a kth score is known to reach.
        self.least = np.full(queries, LOWEST, np.int64)

    def worst(self, rows: np.ndarray) -> int:
        return int(np.maximum(self.scores[rows, -1], self.least[rows]).min())

    def add(self, rows: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        """``scores`` of ``rows`` by candidates ``ids``; LOWEST stands for none."""
        floor = np.maximum(self.scores[rows, -1], self.least[rows])
        some = np.flatnonzero((scores >= floor[:, None]).any(axis=1))
        if not len(some):
            return
        at = rows[some]
        s = np.concatenate([self.scores[at], scores[some]], axis=1)
        i = np.concatenate([self.ids[at], np.broadcast_to(ids, (len(some), len(ids)))], axis=1)
        i = np.where(s == LOWEST, np.iinfo(np.int64).max, i)
        best = np.lexsort((i, -np.maximum(s, LOWEST + 1)), axis=1)
        s, i = np.take_along_axis(s, best, 1), np.take_along_axis(i, best, 1)
        again = np.zeros(s.shape, bool)
        again[:, 1:] = (s[:, 1:] == s[:, :-1]) & (i[:, 1:] == i[:, :-1])
        if again.any():
            keep = np.argsort(again, axis=1, kind="stable")
            s = np.take_along_axis(np.where(again, LOWEST, s), keep, 1)
            i = np.take_along_axis(np.where(again, np.iinfo(np.int64).max, i), keep, 1)
        self.scores[at], self.ids[at] = s[:, :self.k], i[:, :self.k]


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of rows of whole numbers."""
    if a.size == 0 or b.size == 0:
        return np.zeros((len(a), len(b)), np.int64)
    if float(np.abs(a).max()) * float(np.abs(b).max()) * a.shape[1] < 2.0 ** 53:
        return (a @ b.T).astype(np.int64)
    whole = np.array([[int(x) for x in row] for row in a], object) @ np.array([[int(x) for x in row] for row in b], object).T
    return np.array([[max(-HELD, min(HELD, int(v))) for v in row] for row in whole], np.int64)


def search(queries: CoverTree, query_ids: np.ndarray, data: CoverTree, ids: list[np.ndarray], best: Best) -> None:
    """Dual-tree search; ``ids`` holds the ids of every different vector of ``data``."""
    if not queries.center or not data.center:
        return

    def most(q: int, p: int) -> float:
        rq, rp = queries.radius[q], data.radius[p]
        value = float(queries.center[q] @ data.center[p]) + queries.norm[q] * rp + data.norm[p] * rq + rq * rp
        # Scores are held within a long, and so are their bounds.
        return max(value + abs(value) * 1e-9 + 1, -HELD)

    stack = [(most(0, 0), 0, 0)]
    while stack:
        bound, q, p = stack.pop()
        rows = queries.order[slice(*queries.span[q])]
        worst = best.worst(rows)
        if worst != LOWEST and bound < worst:
            continue
        below_q, below_p = queries.children[q], data.children[p]
        if not below_q and not below_p:
            which = data.order[slice(*data.span[p])]
            scores = products(queries.points[rows], data.points[which])
            owner = np.repeat(np.arange(len(which)), [len(ids[w]) for w in which])
            flat = np.concatenate([ids[w] for w in which])
            scores = scores[:, owner]
            scores[query_ids[rows][:, None] == flat[None, :]] = LOWEST
            best.add(rows, scores, flat)
        elif below_q and (not below_p or queries.radius[q] >= data.radius[p]):
            stack += sorted((most(c, p), c, p) for c in below_q)
        else:
            stack += sorted((most(q, c), q, c) for c in below_p)


def distinct_vectors(vectors: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """Different vectors and, of the ids of each, the k + 1 smallest: others are never needed."""
    order = np.lexsort((ids, *vectors.T[::-1])) if vectors.shape[1] else np.argsort(ids, kind="stable")
    vectors, ids = vectors[order], ids[order]
    new = np.ones(len(ids), bool)
    new[1:] = (vectors[1:] != vectors[:-1]).any(axis=1)
    first = np.flatnonzero(new)
    return vectors[first], [np.unique(x)[:k + 1] for x in np.split(ids, first[1:])]


def _rows(batch: pa.RecordBatch, scale: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Ids and whole-number vectors of a batch, by length of the vectors."""
    lists, ids = batch.column(1), batch.column(0).to_numpy()
    size = np.asarray(lists.value_lengths())
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(float)
    first = np.concatenate([[0], np.cumsum(size)[:-1]]).astype(np.int64)
    for d in np.unique(size):
        own = np.flatnonzero(size == d)
        for at in range(0, len(own), TREE_ROWS):
            part = own[at:at + TREE_ROWS]
            yield ids[part], np.floor(scale * flat[first[part][:, None] + np.arange(d)])


def prepare(ids: np.ndarray, vectors: np.ndarray, k: int) -> tuple[np.ndarray, dict, np.ndarray]:
    """Queries of one length as plain values: ids, tree, and least kth scores."""
    tree, best = CoverTree(vectors), Best(len(ids), k)
    points, own = distinct_vectors(vectors, ids, k)
    search(tree, ids, CoverTree(points), own, best)
    return ids, vars(tree), best.scores[:, -1].copy()


def restored(values: dict) -> CoverTree:
    tree = CoverTree(np.empty((0, 0)))
    vars(tree).update(values)
    return tree


def top(
    df: DataFrame, is_query: Column, id_col: str = "vec_id", vector_col: str = "embedding", k: int = K,
    scale: int = SCALE,
) -> DataFrame:
    """``query_id, rank, <id_col>, score`` of the k best rows for every query row."""
    good = df.where(
        F.col(id_col).isNotNull() & F.col(vector_col).isNotNull()
        & F.forall(vector_col, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    ).select(F.col(id_col).cast("long").alias("_id"), F.col(vector_col).cast("array<double>").alias("_v"), is_query.alias("_q"))
    queries = good.where("_q")
    sizes = queries.agg(F.count("*").alias("n"), F.coalesce(F.max(F.size("_v")), F.lit(0)).alias("d")).first()
    # A round is the queries of a range of hashes; their number is near its bound.
    rounds = max(1, -(-sizes["n"] * max(sizes["d"], 1) * 8 // ROUND_BYTES))
    context = df.sparkSession.sparkContext
    schema = pa.schema([("query_id", pa.int64()), ("_id", pa.int64()), ("score", pa.int64())])
    found = None
    for nth in range(rounds):
        own = queries.where(F.pmod(F.xxhash64("_id"), F.lit(rounds)) == nth).select("_id", "_v").dropDuplicates()
        table = own.toArrow()
        groups: dict[int, list] = {}
        for batch in table.to_batches():
            for ids, vectors in _rows(batch, scale):
                groups.setdefault(vectors.shape[1], []).append((ids, vectors))
        held = {
            d: prepare(np.concatenate([i for i, _ in g]), np.concatenate([v for _, v in g]), k) for d, g in groups.items()
        }
        sent = context.broadcast(held)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            best: dict[int, Best] = {}
            rounds = {d: (ids, restored(tree), least) for d, (ids, tree, least) in sent.value.items()}
            for batch in batches:
                for ids, vectors in _rows(batch, scale):
                    d = vectors.shape[1]
                    if d not in rounds:
                        continue
                    query_ids, tree, least = rounds[d]
                    if d not in best:
                        best[d] = Best(len(query_ids), k)
                        best[d].least = least
                    points, own = distinct_vectors(vectors, ids, k)
                    search(tree, query_ids, CoverTree(points), own, best[d])
            for d, b in best.items():
                row, column = np.nonzero(b.ids != np.iinfo(np.int64).max)
                yield pa.RecordBatch.from_arrays([
                    pa.array(rounds[d][0][row]), pa.array(b.ids[row, column]), pa.array(b.scores[row, column]),
                ], schema=schema)

        part = good.select("_id", "_v").mapInArrow(run, "query_id long, _id long, score long")
        found = part if found is None else found.unionByName(part)
    ranked = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("_id"))
    return (
        found.distinct().withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= k)
        .select("query_id", "rank", F.col("_id").alias(id_col), "score")
    )


# The same in SQL, over table ``embeddings``.
SQL = f"""
WITH whole AS (
  SELECT DISTINCT vec_id, [floor({SCALE} * x::DOUBLE)::BIGINT for x in embedding] AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0
), pairs AS (
  SELECT DISTINCT q.vec_id AS query_id, p.vec_id, list_inner_product(q.v::DOUBLE[], p.v::DOUBLE[])::BIGINT AS score
  FROM whole q JOIN whole p ON q.vec_id % 100 = 0 AND q.vec_id <> p.vec_id AND len(q.v) = len(p.v)
), ranked AS (
  SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score FROM pairs
)
SELECT * FROM ranked WHERE rank <= {K}
"""
