"""Nearest rows between two blocks of vectors, run inside a task."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from themeloom.functions.vectors import EPSILON

QUERY_SLICE = 512
ROW_SLICE = 8192
PAIR_SLICE = 65536
# Slack for the rounding of the matrix product; candidates are measured again.
SLACK = 1e-9


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """A list column as a matrix of doubles."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if len(column) == 0:
        return np.zeros((0, 0))
    flat = column.flatten().to_numpy(zero_copy_only=False).astype("float64", copy=False)
    return flat.reshape(len(column), -1)


def distances(q: np.ndarray, c: np.ndarray, metric: str) -> np.ndarray:
    """All distances by one matrix product (squared for both Euclidean metrics)."""
    product = q @ c.T
    if metric == "cosine":
        lengths = np.outer(np.linalg.norm(q, axis=1), np.linalg.norm(c, axis=1))
        return 1.0 - product / (lengths + EPSILON)
    return (q * q).sum(1)[:, None] + (c * c).sum(1)[None, :] - 2.0 * product


def _exact(q: np.ndarray, c: np.ndarray, metric: str) -> np.ndarray:
    """Row-by-row distances of two equally long matrices."""
    if metric == "cosine":
        lengths = np.linalg.norm(q, axis=1) * np.linalg.norm(c, axis=1)
        return 1.0 - (q * c).sum(1) / (lengths + EPSILON)
    gap = ((q - c) ** 2).sum(1)
    return np.sqrt(gap) if metric == "l2" else gap


def _exact_pairs(q, c, qi, ci, metric):
    out = np.empty(len(qi))
    for s in range(0, len(qi), PAIR_SLICE):
        part = slice(s, s + PAIR_SLICE)
        out[part] = _exact(q[qi[part]], c[ci[part]], metric)
    return out


def _slack(q: np.ndarray, c: np.ndarray, metric: str) -> float:
    if metric == "cosine":
        return SLACK
    return SLACK * (1.0 + float((q * q).sum(1).max()) + float((c * c).sum(1).max()))


def closest(rows: np.ndarray, centers: np.ndarray) -> np.ndarray:
    """Index of the nearest center per row; of equals the first."""
    out = np.empty(len(rows), dtype="int64")
    for s in range(0, len(rows), ROW_SLICE):
        part = rows[s:s + ROW_SLICE]
        rough = distances(part, centers, "l2sq")
        near = rough <= rough.min(1, keepdims=True) + _slack(part, centers, "l2sq")
        ri, ci = np.nonzero(near)
        gaps = _exact_pairs(part, centers, ri, ci, "l2sq")
        order = np.lexsort((ci, gaps, ri))
        first = np.r_[True, ri[order][1:] != ri[order][:-1]]
        out[s:s + ROW_SLICE] = ci[order][first]
    return out


@dataclass
class Nearest:
    """The ``k`` nearest rows seen so far for each query of a block.

    The state holds at most ``k`` rows per query.  Equal distances are settled
    by the row id, so copies of a vector never crowd memory or change a result.
    """

    ids: pa.Array
    vectors: np.ndarray
    k: int
    metric: str
    skip_self: bool

    def __post_init__(self):
        self.worst = np.full(len(self.vectors), np.inf)
        # Hits per slice of queries, by the first query of the slice.
        self.found: dict[int, pa.Table] = {}

    def add(self, rows: pa.Table, vectors: np.ndarray, allowed: Callable[[slice, slice], np.ndarray] | None = None) -> None:
        """Compare with further rows; ``allowed`` tells which of a slice of queries and one of rows may meet."""
        for s in range(0, len(vectors), ROW_SLICE):
            part = slice(s, s + ROW_SLICE)
            self._add_slice(rows.slice(s, ROW_SLICE), vectors[part], allowed and (lambda q, part=part: allowed(q, part)))

    def add_pairs(self, rows: pa.Table, vectors: np.ndarray, qi: np.ndarray, ci: np.ndarray) -> None:
        """Compare queries with rows pair by pair, in place of :meth:`add`."""
        if len(qi):
            gaps = _exact_pairs(self.vectors, vectors, qi, ci, self.metric)
            self._keep(0, len(self.vectors), qi, gaps, rows.take(pa.array(ci)))

    def _add_slice(self, rows: pa.Table, c: np.ndarray, allowed: Callable[[slice], np.ndarray] | None) -> None:
        own = None
        if self.skip_self:
            own = pc.index_in(rows.column("id"), value_set=self.ids)
            own = own.fill_null(-1).to_numpy()
        for s in range(0, len(self.vectors), QUERY_SLICE):
            q = self.vectors[s:s + QUERY_SLICE]
            rough = distances(q, c, self.metric)
            if allowed is not None:
                rough[~allowed(slice(s, s + QUERY_SLICE))] = np.inf
            if own is not None:
                hit = np.nonzero((own >= s) & (own < s + len(q)))[0]
                rough[own[hit] - s, hit] = np.inf
            limit = self.worst[s:s + QUERY_SLICE].copy()
            if self.metric == "l2":
                limit = limit * limit
            # A full list is bound enough.
            if rough.shape[1] > self.k and not np.isfinite(limit).all():
                limit = np.minimum(limit, np.partition(rough, self.k - 1, axis=1)[:, self.k - 1])
            slack = _slack(q, c, self.metric)
            near = (rough <= limit[:, None] + slack) & np.isfinite(rough)
            qi, ci = np.nonzero(near)
            if len(qi):
                gaps = _exact_pairs(q, c, qi, ci, self.metric)
                self._keep(s, len(q), qi, gaps, rows.take(pa.array(ci)))

    def _keep(self, s: int, n: int, qi: np.ndarray, gaps: np.ndarray, rows: pa.Table) -> None:
        everything = rows.append_column("qi", pa.array(qi, pa.int64())).append_column("d", pa.array(gaps))
        if s in self.found:
            everything = pa.concat_tables([self.found[s], everything])
        order = pc.sort_indices(everything, sort_keys=[
            ("qi", "ascending"), ("d", "ascending"), ("id", "ascending"),
        ])
        everything = everything.take(order)
        at = everything.column("qi").to_numpy()
        start = np.r_[0, np.nonzero(at[1:] != at[:-1])[0] + 1]
        rank = np.arange(len(at)) - np.repeat(start, np.diff(np.r_[start, len(at)]))
        kept = everything.filter(pa.array(rank < self.k)).combine_chunks()
        self.found[s] = kept
        # The last kept row of a full list bounds what may still come in.
        counts = np.bincount(kept.column("qi").to_numpy(), minlength=n)
        ends = np.cumsum(counts) - 1
        full = np.nonzero(counts >= self.k)[0]
        self.worst[s + full] = kept.column("d").to_numpy()[ends[full]]

    def results(self, schema: pa.Schema) -> Iterator[pa.Table]:
        """(query_id, d, id, ...) and, if asked for, ``rank`` in the column order of ``schema``, per slice."""
        for s, hits in self.found.items():
            qi = hits.column("qi").combine_chunks()
            named = hits.append_column("query_id", self.ids.take(pc.add(qi, s)))
            if "rank" in schema.names:
                # Hits lie by query and rank.
                own = qi.to_numpy()
                named = named.append_column("rank", pa.array(np.arange(len(own)) - np.searchsorted(own, own) + 1, pa.int32()))
            yield named.select(schema.names).cast(schema)

    def result(self, schema: pa.Schema) -> pa.Table:
        return pa.concat_tables([schema.empty_table(), *self.results(schema)])
