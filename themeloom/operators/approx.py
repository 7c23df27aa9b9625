"""Approximate search: a two-level inverted index with coded residuals.

A vector's list is a pair: the nearest of a few group centers, and the nearest of a few
steps from there, which all groups share.  ``g`` centers and ``s`` steps make ``g * s``
lists, so their number grows with the collection while what is sent to tasks grows with its
square root only.  What is left of the vector is coded in one byte for each few dimensions.

A search reads the codes of the lists nearest to a query, ranks them by the distance of the
decoded vectors, and measures the best with their stored vectors.  How many lists and how
many vectors that takes is measured for the ``k`` and metric asked for.
"""

from __future__ import annotations

import math
import pickle
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from urllib.parse import unquote

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from themeloom.functions import vectors as vx
from themeloom.functions.blocks import Nearest, distances, matrix
from themeloom.operators.scale import distinct_keys, spread
from themeloom.operators.search import _hit_schema, scored
from themeloom.operators.stored import Block, in_tasks, packed, read_all, store_blocks
from themeloom.session import scratch_path, shared_dir
from themeloom.sources.storage import in_reach, opened

# Rows, drawn by a hash of their id, that an index is fitted and measured on.
SAMPLE = 65536
# Of these, the rows that codes are fitted on and the rows that stand for queries.
CODED_FROM = 16384
MEASURED = 256
# Dimensions in one byte of code, and values of a byte.
CODE_DIMS = 2
CODE_VALUES = 256
ROUNDS = 6
ROWS_AT_ONCE = 4096
# Shares of the true neighbours that are to lie in the lists read, and then among the
# vectors measured.
LIST_AIM = 0.975
RANK_AIM = 0.985
# Upper sizes of blocks of queries and of codes that meet in a task, the least size of a
# block of queries that is split for want of tasks, and the queries handled at once.
QUERY_BLOCK = 4096
ROW_BLOCK = 131072
LEAST_BLOCK = 256
QUERY_SLICE = 128
# Rows that a pair of blocks passes on at most: its queries times the rows kept for each.
PASSED_ON = 1 << 22
# Marks of queries and lists that a task holds.
PROBED = 1 << 26
# Up to so many lists, all are ranked for a query; of more, those of the nearest groups.
RANKED_LISTS = 4096


def _nearest(x: np.ndarray, centers: np.ndarray) -> np.ndarray:
    """Nearest center of each row; nearly equal ones are as good as each other."""
    x, centers = x.astype(np.float32), centers.astype(np.float32)
    out = np.empty(len(x), np.int64)
    size = (centers * centers).sum(axis=1) / 2
    for at in range(0, len(x), ROWS_AT_ONCE):
        gap = x[at:at + ROWS_AT_ONCE] @ -centers.T
        gap += size
        out[at:at + ROWS_AT_ONCE] = gap.argmin(axis=1)
    return out


def _means(x: np.ndarray, k: int, random: np.random.Generator) -> np.ndarray:
    """Means of ``k`` parts of ``x``, or its distinct rows if there are fewer."""
    # Rows with equal products with a random vector are taken to be copies.
    known = x[np.unique(x @ random.normal(size=x.shape[1]), return_index=True)[1]]
    if len(known) <= k:
        return known
    centers = known[random.choice(len(known), k, replace=False)]
    for _ in range(ROUNDS):
        label = _nearest(x, centers)
        size = np.bincount(label, minlength=k)
        order = np.argsort(label, kind="stable")
        held = np.flatnonzero(size)
        first = (np.cumsum(size) - size)[held]
        centers[held] = np.add.reduceat(x[order], first, axis=0) / size[held][:, None]
    return centers


@dataclass
class Quantizer:
    """Group centers, steps from them, and the values of each byte of code."""

    groups: np.ndarray
    steps: np.ndarray
    books: list[np.ndarray]

    @property
    def lists(self) -> int:
        return len(self.groups) * len(self.steps)

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """List and code of each row."""
        group = _nearest(x, self.groups)
        left = x - self.groups[group]
        step = _nearest(left, self.steps)
        left -= self.steps[step]
        code = np.zeros((len(x), len(self.books)), np.uint8)
        at = 0
        for i, book in enumerate(self.books):
            own = left[:, at:at + book.shape[1]]
            code[:, i] = _nearest(own, book)
            at += book.shape[1]
        return group * len(self.steps) + step, code

    def decode(self, number: np.ndarray, code: np.ndarray) -> np.ndarray:
        group, step = np.divmod(number, len(self.steps))
        return self.groups[group] + self.steps[step] + np.concatenate(
            [book[code[:, i]] for i, book in enumerate(self.books)], axis=1)

    def _ranked(self, q: np.ndarray, metric: str, groups: int) -> np.ndarray:
        """Lists of the ``groups`` nearest groups of each query, nearest list first."""
        own, steps = q @ self.groups.T, q @ self.steps.T
        sizes = (self.groups ** 2).sum(axis=1)[:, None] + (self.steps ** 2).sum(axis=1)[None, :] \
            + 2 * self.groups @ self.steps.T
        near = np.argsort(distances(q, self.groups, metric), axis=1, kind="stable")[:, :groups]
        product = np.take_along_axis(own, near, 1)[:, :, None] + steps[:, None, :]
        if metric == "cosine":
            gap = -product / (np.sqrt(np.maximum(sizes, 0))[near] + vx.EPSILON)
        else:
            gap = sizes[near] - 2 * product
        number = near[:, :, None] * len(self.steps) + np.arange(len(self.steps))
        order = np.argsort(gap.reshape(len(q), -1), axis=1, kind="stable")
        return np.take_along_axis(number.reshape(len(q), -1), order, 1)

    def near_lists(self, q: np.ndarray, metric: str, probes: int, need: int, sizes: np.ndarray) -> list[np.ndarray]:
        """The ``probes`` nearest lists with rows for each query; more, until they hold ``need`` rows."""
        all_groups = len(self.groups)
        groups = all_groups
        if self.lists > RANKED_LISTS:
            groups = min(all_groups, max(8, math.ceil(4 * probes / len(self.steps))))
        out = []
        for at in range(0, len(q), QUERY_SLICE):
            part = q[at:at + QUERY_SLICE]
            ranked = self._ranked(part, metric, groups)
            for i, row in enumerate(ranked):
                chosen = _until(row, probes, need, sizes)
                if chosen is None and groups < all_groups:
                    row = self._ranked(part[i:i + 1], metric, all_groups)[0]
                    chosen = _until(row, probes, need, sizes)
                out.append(row[sizes[row] > 0] if chosen is None else chosen)
        return out


def _until(ranked: np.ndarray, probes: int, need: int, sizes: np.ndarray) -> np.ndarray | None:
    """The first lists with rows: ``probes`` of them, and ``need`` rows; None if there are not as many."""
    held = ranked[sizes[ranked] > 0]
    at = int(np.searchsorted(np.cumsum(sizes[held]), need)) + 1
    last = max(probes, at)
    return held[:last] if last <= len(held) else None


def fit(x: np.ndarray, n_lists: int, seed: int) -> Quantizer:
    random = np.random.default_rng(seed)
    groups = _means(x, math.ceil(math.sqrt(n_lists)), random)
    left = x - groups[_nearest(x, groups)]
    steps = _means(left, math.ceil(n_lists / len(groups)), random)
    left -= steps[_nearest(left, steps)]
    left = left[:CODED_FROM]
    parts = np.array_split(left, math.ceil(x.shape[1] / CODE_DIMS), axis=1)
    return Quantizer(groups, steps, [_means(p, CODE_VALUES, random) for p in parts])


def measure(model: Quantizer, x: np.ndarray, n: int, k: int, metric: str) -> tuple[int, int]:
    """Lists to read and vectors to measure for ``k`` neighbours among ``n`` rows, of which ``x`` is a sample.

    As many neighbours in the sample stand for ``k`` neighbours in the whole as have the
    same share of the rows, one at least.
    """
    if len(x) < 2:
        return 1, max(k, 1)
    queries = x[:MEASURED]
    number, code = model.encode(x)
    sizes = np.bincount(number, minlength=model.lists)
    gaps = distances(queries, x, metric)
    gaps[np.arange(len(queries)), np.arange(len(queries))] = np.inf
    same = max(1, min(len(x) - 1, round(k * len(x) / n)))
    true = np.argsort(gaps, axis=1, kind="stable")[:, :same]
    ranked = model.near_lists(queries, metric, model.lists, len(x), sizes)
    turn = np.full((len(queries), model.lists), model.lists)
    for i, row in enumerate(ranked):
        turn[i, row] = np.arange(len(row))
    needed = np.sort(np.take_along_axis(turn, number[true], 1).ravel())
    probes = min(model.lists, int(needed[min(len(needed) - 1, int(LIST_AIM * len(needed)))]) + 1)
    # Ranks of the true neighbours by what the codes tell, among the rows of the lists read.
    rough = distances(queries, model.decode(number, code), metric)
    rough[turn[:, number] >= probes] = np.inf
    rough[np.arange(len(queries)), np.arange(len(queries))] = np.inf
    own = np.take_along_axis(rough, true, 1)
    ranks = np.sort(np.stack([np.searchsorted(np.sort(r), o) for r, o in zip(rough, own)])[np.isfinite(own)])
    rank = int(ranks[min(len(ranks) - 1, int(RANK_AIM * len(ranks)))]) + 1 if len(ranks) else 1
    return probes, max(k, math.ceil(rank * n / len(x)))


@dataclass(frozen=True)
class VectorIndex:
    """Rows stored by list with their codes; ``sizes`` are the rows of each list.

    ``settings`` holds, for (k, metric), the lists to read and the vectors to measure.
    """

    model: Quantizer
    rows: DataFrame
    sizes: np.ndarray
    settings: dict[tuple[int, str], tuple[int, int]] = field(default_factory=dict)

    @property
    def size(self) -> int:
        return int(self.sizes.sum())

    def settings_for(self, k: int, metric: str) -> tuple[int, int]:
        kind = "cosine" if metric == "cosine" else "l2sq"
        if (k, kind) not in self.settings:
            model, size = self.model, self.size

            def tell(x: np.ndarray) -> tuple[int, int]:
                return measure(model, x, size, k, kind)

            self.settings[(k, kind)] = _in_one_task(self.rows, size, tell) or (1, k)
        return self.settings[(k, kind)]


def _in_one_task(rows: DataFrame, n: int, work):
    """``work`` on the vectors of a sample of at most about ``SAMPLE`` rows; None without rows."""
    share = min(1.0, SAMPLE / max(n, 1))
    sample = rows.select("id", "embedding")
    if share < 1:
        sample = sample.where(F.pmod(F.xxhash64("id", F.lit("sample")), F.lit(1 << 30)) < int(share * (1 << 30)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [(b.column(0), matrix(b.column(1))) for b in batches if b.num_rows]
        if held:
            # An order of its own, since rows arrive as tasks finish.
            order = np.argsort(np.concatenate([c.to_numpy(zero_copy_only=False) for c, _ in held]), kind="stable")
            x = np.concatenate([m for _, m in held])[np.random.default_rng(0).permutation(order)]
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(work(x))], pa.binary())], names=["told"])

    found = sample.repartition(1).mapInArrow(run, "told binary").first()
    return pickle.loads(found["told"]) if found else None


def build_index(
    collection: DataFrame, n_lists: int | None = None, seed: int = 42, path: str | None = None,
    k: int = 10, metric: str = "l2sq",
) -> VectorIndex:
    """Index (id, stock_name, embedding) with about the square root of its rows as lists.

    Centers, steps and codes are fitted on a sample, and so are the settings for ``k``
    and ``metric``; every row is indexed.  The rows are written once, partitioned by
    group, to ``path`` or the shared folder; a group that holds much of the collection
    spans several files.
    """
    spark = collection.sparkSession
    rows = collection.where(F.col("embedding").isNotNull())
    n = rows.count()
    lists = n_lists or max(2, math.ceil(math.sqrt(n)))
    kind = "cosine" if metric == "cosine" else "l2sq"

    def learn(x: np.ndarray):
        model = fit(x, lists, seed)
        return (model.groups, model.steps, model.books), measure(model, x, n, k, kind)

    parts, told = _in_one_task(rows, n, learn) or ((np.zeros((1, 0)), np.zeros((1, 0)), []), (1, k))
    model = Quantizer(*parts)
    sent = spark.sparkContext.broadcast(model)
    added = [T.StructField("grp", T.IntegerType()), T.StructField("list", T.IntegerType()),
             T.StructField("code", T.BinaryType())]

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for batch in batches:
            if batch.num_rows:
                number, code = model.encode(matrix(batch.column("embedding")))
                yield pa.RecordBatch.from_arrays(batch.columns + [
                    pa.array(number // len(model.steps), pa.int32()), pa.array(number, pa.int32()),
                    pa.array([c.tobytes() for c in code], pa.binary()),
                ], batch.schema.names + [f.name for f in added])

    schema = T.StructType(rows.schema.fields + added)
    path = path or scratch_path(spark, "index")
    spread(rows).mapInArrow(encode, schema).hint("rebalance", "grp").sortWithinPartitions("grp", "list") \
        .write.partitionBy("grp").parquet(path)
    stored = spark.read.schema(schema).parquet(path)
    sizes = np.zeros(model.lists, np.int64)
    # One row per list, about the square root of the rows.
    counts = stored.groupBy("list").agg(F.count("*").alias("n")).toArrow()
    sizes[counts.column("list").to_numpy()] = counts.column("n").to_numpy()
    return VectorIndex(model, stored, sizes, {(k, kind): told})


def _bundles(of_group: np.ndarray) -> tuple[np.ndarray, list[int]]:
    """The bundle of each group, and into how many parts each bundle is cut.

    Groups that follow one another share a bundle of at most ``ROW_BLOCK`` rows; a larger
    group is a bundle of its own and cut.
    """
    bundle, parts, held = np.zeros(len(of_group), np.int64), [], ROW_BLOCK + 1
    for i, n in enumerate(of_group):
        if held + n > ROW_BLOCK:
            parts.append(max(1, math.ceil(int(n) / ROW_BLOCK)))
            held = 0
        held += int(n)
        bundle[i] = len(parts) - 1
    return bundle, parts


def _probed(asked: DataFrame, index: VectorIndex, bundle: np.ndarray, probes: int, need: int, metric: str) -> DataFrame:
    """``query_id, embedding, bundle, lists`` for each query and each bundle with lists to read."""
    sent = asked.sparkSession.sparkContext.broadcast((index.model, index.sizes, bundle))
    schema = T.StructType(asked.schema.fields + [
        T.StructField("bundle", T.IntegerType()), T.StructField("lists", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, sizes, bundle = sent.value
        for batch in batches:
            if not batch.num_rows:
                continue
            near = model.near_lists(matrix(batch.column("embedding")), metric, probes, need, sizes)
            row, which, lists = [], [], []
            for i, own in enumerate(near):
                own = np.sort(own)
                at = bundle[own // len(model.steps)]
                first = np.flatnonzero(np.diff(at, prepend=-1))
                for a, part in zip(first, np.split(own, first[1:]) if len(own) else []):
                    row.append(i)
                    which.append(int(at[a]))
                    lists.append(part.astype(np.int32).tobytes())
            yield pa.RecordBatch.from_arrays(
                [c.take(pa.array(row, pa.int64())) for c in batch.columns]
                + [pa.array(which, pa.int32()), pa.array(lists, pa.binary())], batch.schema.names + ["bundle", "lists"])

    return spread(asked).mapInArrow(run, schema)


class _Ranked:
    """The ``most`` nearest rows by rough distance of each query so far, nearest first; of equals the first."""

    def __init__(self, queries: int, most: int):
        self.gap = np.full((queries, most), np.inf, np.float32)
        self.at = np.full((queries, most), -1, np.int64)

    def add(self, who: np.ndarray, rough: np.ndarray, place: np.ndarray) -> None:
        """``rough`` has a row for each of the queries ``who`` and a column for each row; rows come in order of their place."""
        most = self.gap.shape[1]
        limit = self.gap[who, -1]
        if np.isfinite(limit).all():
            near = rough < limit[:, None]
        elif rough.shape[1] > most:
            near = rough <= np.minimum(limit, np.partition(rough, most - 1, axis=1)[:, most - 1])[:, None]
        else:
            near = rough <= limit[:, None]
        qi, ci = np.nonzero(near & np.isfinite(rough))
        if not len(qi):
            return
        touched, new = np.unique(qi, return_inverse=True)
        own = who[touched]
        query = np.concatenate([np.repeat(np.arange(len(own)), most), new])
        gap = np.concatenate([self.gap[own].ravel(), rough[qi, ci]])
        at = np.concatenate([self.at[own].ravel(), place[ci]])
        order = np.lexsort((at, gap, query))
        query = query[order]
        start = np.searchsorted(query, np.arange(len(own)))
        rank = np.arange(len(query)) - start[query]
        kept = rank < most
        self.gap[own[query[kept]], rank[kept]] = gap[order][kept]
        self.at[own[query[kept]], rank[kept]] = at[order][kept]


def _stored_rows(store, path: str, columns: list[str]) -> Iterator[tuple[int, pa.RecordBatch]]:
    """The rows of a file of the index batch by batch, with the number of the first."""
    import pyarrow.parquet as pq

    first = 0
    with store.open_input_file(path) as source:
        for batch in pq.ParquetFile(source).iter_batches(2 * ROWS_AT_ONCE, columns=columns):
            yield first, batch
            first += batch.num_rows


def _decoded(model: Quantizer, batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """List and decoded vector of each row; what is compared by codes is rough already, so single precision will do."""
    number = batch.column("list").to_numpy()
    codes = np.frombuffer(b"".join(batch.column("code").to_pylist()), np.uint8).reshape(len(number), -1)
    return number, model.decode(number, codes).astype(np.float32)


def _rank_codes(
    asked: DataFrame, index: VectorIndex, need: int, probes: int, rerank: int, metric: str, size: int
) -> DataFrame:
    """``query_id, d, rank, id, stock_name``: the ``need`` nearest of the best ``rerank`` rows of each query.

    Queries are stored once, by group, and a task takes at most ``size`` of them.  It reads
    the codes of the lists probed, keeps the best by code, and then reads their vectors to
    measure them: nothing but hits leaves it.  Where every row is to be reranked, it measures
    the rows as it ranks them.
    """
    spark = asked.sparkSession
    kind = "cosine" if metric == "cosine" else "l2sq"
    every = rerank >= index.size
    blocks = store_blocks(asked, "asked", size, lambda x, g=index.model.groups: (_nearest(x, g), np.zeros(len(x))))
    files = sorted(unquote(f) for f in index.rows.inputFiles())
    held = [(opened(f)[1], int(re.search(r"/grp=(\d+)/", f)[1])) for f in files]
    sent = spark.sparkContext.broadcast((index.model, index.sizes, held))
    folder, place = shared_dir(spark), (files or [""])[0]
    schema = _hit_schema(asked, index.rows.select("id", "stock_name", "embedding"), ranks=True)
    arrow = to_arrow_schema(schema)
    payload = ["id", "stock_name"]

    def run(unit: list[Block]) -> Iterator[pa.RecordBatch]:
        model, sizes, held = sent.value
        store, _ = opened(place)
        asked, q = read_all(folder, unit)
        small = q.astype(np.float32)
        state = Nearest(asked.column("query_id").combine_chunks(), q, need, metric, False)
        probed = np.zeros((len(q), model.lists), bool)
        for i, lists in enumerate(model.near_lists(q, kind, probes, need, sizes)):
            probed[i, lists] = True
        groups = set(np.flatnonzero(probed.any(axis=0).reshape(-1, len(model.steps)).any(axis=1)).tolist())
        read = [(n, path) for n, (path, group) in enumerate(held) if group in groups]
        if every:
            for _, path in read:
                for _, batch in _stored_rows(store, path, ["list", "code", *payload, "embedding"]):
                    number, x = _decoded(model, batch)

                    def ranked(of: slice, rows: slice, number=number, x=x) -> np.ndarray:
                        rough = distances(small[of], x[rows], metric)
                        rough[~probed[of][:, number[rows]]] = np.inf
                        return np.isfinite(rough)

                    state.add(pa.Table.from_batches([batch]).select(payload), matrix(batch.column("embedding")), ranked)
        else:
            best = _Ranked(len(q), rerank)
            for n, path in read:
                for first, batch in _stored_rows(store, path, ["list", "code"]):
                    number, x = _decoded(model, batch)
                    here = np.unique(number)
                    who = np.flatnonzero(probed[:, here].any(axis=1))
                    rows = np.flatnonzero(probed[:, here].any(axis=0)[np.searchsorted(here, number)])
                    for s in range(0, len(who) if len(rows) else 0, QUERY_SLICE):
                        some = who[s:s + QUERY_SLICE]
                        rough = distances(small[some], x[rows], metric)
                        rough[~probed[some][:, number[rows]]] = np.inf
                        best.add(some, rough, (n << 32) + first + rows)
            qi, rank = np.nonzero(best.at >= 0)
            at = best.at[qi, rank]
            order = np.argsort(at, kind="stable")
            qi, at = qi[order], at[order]
            for n, path in read:
                a, b = np.searchsorted(at, [n << 32, (n + 1) << 32])
                for first, batch in _stored_rows(store, path, [*payload, "embedding"]) if a < b else []:
                    lo, hi = a + np.searchsorted(at[a:b], [(n << 32) + first, (n << 32) + first + batch.num_rows])
                    state.add_pairs(
                        pa.Table.from_batches([batch]).select(payload), matrix(batch.column("embedding")),
                        qi[lo:hi], at[lo:hi] - (n << 32) - first)
        for hits in state.results(arrow):
            yield from hits.to_batches()

    return in_tasks(spark, list(packed(blocks, size)), run, schema)


def _rank_moved_codes(
    left: DataFrame, right: DataFrame, on: list[str], model: Quantizer, rerank: int, metric: str,
    exact: int | None = None,
) -> DataFrame:
    """``query_id, grp, id, rough``: the best ``rerank`` rows of each query in each pair of blocks.

    With ``exact``, every row is to be reranked and ``right`` has the vectors in ``_v``: of the
    rows ranked, those are passed on that are among the ``exact`` nearest by the vectors, near
    ties included, which the measure that follows decides.
    """
    sent = left.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType([
        T.StructField("query_id", left.schema["query_id"].dataType), T.StructField("grp", T.IntegerType()),
        T.StructField("id", right.schema["id"].dataType), T.StructField("rough", T.DoubleType())])
    arrow = to_arrow_schema(schema)

    def pair(asked: pa.Table, held: pa.Table) -> pa.Table:
        if not asked.num_rows or not held.num_rows:
            return arrow.empty_table()
        model = sent.value
        order = np.argsort(held.column("list").to_numpy(), kind="stable")
        held = held.take(pa.array(order)).combine_chunks()
        number = held.column("list").to_numpy()
        codes = np.frombuffer(b"".join(held.column("code").to_pylist()), np.uint8).reshape(len(number), -1)
        # What is compared here is rough already, so single precision will do.
        x = model.decode(number, codes).astype(np.float32)
        q = matrix(asked.column("embedding")).astype(np.float32)
        if exact:
            v, whole = matrix(held.column("_v")), matrix(asked.column("embedding"))
            size = (whole * whole).sum(1)[:, None] + (v * v).sum(1).max()
        lists = [np.frombuffer(b, np.int32) for b in asked.column("lists").to_pylist()]
        qi, ci, gap = [], [], []
        for at in range(0, len(q), QUERY_SLICE):
            own = lists[at:at + QUERY_SLICE]
            who = np.repeat(np.arange(len(own)), [len(o) for o in own])
            which = np.concatenate(own)
            turn = np.argsort(which, kind="stable")
            who, which = who[turn], which[turn]
            rough = np.full((len(own), len(number)), np.inf, np.float32)
            for n in np.unique(which):
                a, b = np.searchsorted(number, n), np.searchsorted(number, n, "right")
                if a < b:
                    mine = who[np.searchsorted(which, n):np.searchsorted(which, n, "right")]
                    rough[mine, a:b] = distances(q[at + mine], x[a:b], metric)
            if rough.shape[1] > rerank:
                near = np.argpartition(rough, rerank - 1, axis=1)[:, :rerank]
            else:
                near = np.broadcast_to(np.arange(rough.shape[1]), rough.shape)
            found = np.take_along_axis(rough, near, 1)
            ok = np.isfinite(found)
            if exact and near.shape[1] > exact:
                d = np.where(ok, np.take_along_axis(distances(whole[at:at + len(own)], v, metric), near, 1), np.inf)
                bound = np.partition(d, exact - 1, axis=1)[:, exact - 1:exact]
                ok &= d <= bound + 1e-9 * size[at:at + len(own)]
            a, b = np.nonzero(ok)
            qi.append(at + a)
            ci.append(near[a, b])
            gap.append(found[a, b])
        qi, ci = np.concatenate(qi), np.concatenate(ci)
        return pa.table([
            asked.column("query_id").take(pa.array(qi)), held.column("grp").take(pa.array(ci)),
            held.column("id").take(pa.array(ci)), pa.array(np.concatenate(gap).astype(np.float64))], schema=arrow)

    return left.groupBy(*on).cogroup(right.groupBy(*on)).applyInArrow(pair, schema)


def approx_topk(
    queries: DataFrame, index: VectorIndex, k: int = 10, probes: int | None = None,
    metric: str = "l2sq", skip_self: bool = False, rerank: int | None = None,
) -> DataFrame:
    """Like :func:`search.topk`, reading ``probes`` lists of codes and measuring ``rerank`` vectors a query.

    By default both are what the index was measured to need for ``k`` and ``metric``;
    :func:`recall` tells how many of the true neighbours are found.  More lists are read
    where those probed hold fewer than ``k`` rows.  Tasks take blocks of queries and read the
    index where it is stored.  Few queries of a large index, ids that come twice and an index
    that tasks cannot open go another way: a group larger than ``ROW_BLOCK`` is split by row
    id and its queries go to each part; only codes are moved to them.
    """
    if metric not in vx.METRICS:
        raise ValueError(f"metric must be one of {vx.METRICS}, not {metric!r}")
    if probes is None or rerank is None:
        lists, vectors = index.settings_for(k, metric)
        probes, rerank = probes or lists, rerank or vectors
    need = k + int(skip_self)
    rerank = max(rerank, k) + int(skip_self)
    asked = queries.select("query_id", F.col("embedding").cast("array<double>").alias("embedding")) \
        .where(F.col("embedding").isNotNull())
    if not index.size:
        asked = asked.where("false")
    n, cores = asked.count(), asked.sparkSession.sparkContext.defaultParallelism
    # Every row is reranked: the rough order decides nothing, and the vectors meet the queries.
    every = rerank >= index.size
    blocks = max(1, math.ceil(n / QUERY_BLOCK), min(cores, math.ceil(n / LEAST_BLOCK)),
                 math.ceil(n * min(need if every else rerank, ROW_BLOCK) / PASSED_ON))
    size = max(1, min(math.ceil(n / blocks), PROBED // index.model.lists))
    places = index.rows.inputFiles()[:1] + [shared_dir(asked.sparkSession)]
    if (blocks >= cores or index.size <= ROW_BLOCK) and all(in_reach(asked.sparkSession, p) for p in places) \
            and distinct_keys(asked, "query_id") and distinct_keys(index.rows, "grp", "id"):
        final = _rank_codes(asked, index, need, probes, rerank, metric, size)
        if skip_self:
            final = final.where(F.col("id") != F.col("query_id")).drop("rank")
    else:
        final = _moved(asked, index, need, probes, rerank, metric, skip_self, blocks, every)
    if "rank" not in final.columns:
        by_distance = Window.partitionBy("query_id").orderBy("d", "id")
        final = final.withColumn("rank", F.row_number().over(by_distance)).where(F.col("rank") <= k)
    return scored(final).select(
        "query_id", "rank", F.col("id").alias("code"), F.col("stock_name").alias("name"), "score", "distance")


def _moved(
    asked: DataFrame, index: VectorIndex, need: int, probes: int, rerank: int, metric: str, skip_self: bool,
    blocks: int, every: bool,
) -> DataFrame:
    """``query_id, id, stock_name, d`` of the rows measured, with codes moved to their queries."""
    # One number per group, of which there are about as many as the fourth root of the rows.
    bundle, counts = _bundles(index.sizes.reshape(-1, len(index.model.steps)).sum(axis=1))
    parts = F.get(F.array(*[F.lit(c) for c in counts]), F.col("bundle"))
    probed = _probed(asked, index, bundle, probes, need, "cosine" if metric == "cosine" else "l2sq")
    left = probed.select(
        "*", F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"),
        F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int").alias("block"))
    right = index.rows.select(
        "grp", "list", "id", "code", *([F.col("embedding").cast("array<double>").alias("_v")] if every else []),
        F.get(F.array(*[F.lit(int(b)) for b in bundle]), F.col("grp")).alias("bundle"),
    ).select(
        "*", F.pmod(F.xxhash64("id"), parts).cast("int").alias("part"),
        F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
    hits = _rank_moved_codes(left, right, ["bundle", "part", "block"], index.model, rerank, metric, need if every else None)
    by_rough = Window.partitionBy("query_id").orderBy("rough", "id")
    best = hits.withColumn("_n", F.row_number().over(by_rough)).where(F.col("_n") <= rerank)
    if skip_self:
        best = best.where(F.col("id") != F.col("query_id"))
    vectors = index.rows.select("grp", "id", "stock_name", F.col("embedding").cast("array<double>").alias("_v"))
    measured = best.select("query_id", "grp", "id").join(vectors, ["grp", "id"]).join(
        asked.withColumnRenamed("embedding", "_q"), "query_id")
    return measured.select("query_id", "id", "stock_name", vx.distance(F.col("_q"), F.col("_v"), metric).alias("d"))


def recall(approximate: DataFrame, exact: DataFrame) -> DataFrame:
    """Share of the exact hits that the approximate search found."""
    found = exact.select("query_id", "code").join(
        approximate.select("query_id", "code", F.lit(1).alias("hit")), ["query_id", "code"], "left"
    )
    return found.agg(F.round(F.count("hit") / F.count("*"), 4).alias("recall"))
