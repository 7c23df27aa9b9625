"""N-gram Jaccard join by MinHash banding.

A text is its set of word n-grams.  Bands of minimum hashes bring similar texts together
in buckets; the number of bands and rows is chosen so that a pair at the threshold shares
a bucket with probability ``recall`` or more.  Texts that are connected by buckets are
verified on their full n-gram sets.

Texts with equal sets are one node from the start.  A connected group of any size is cut
into blocks; a task compares two blocks and returns, for every node, how many texts it
links to, and a spanning forest of the links, so what it returns grows with the nodes and
not with the pairs.  The classes are the connected components of the verified links.

Defined results: words are separated by the six ASCII white space bytes and taken as they
are; a text of fewer than ``n`` words is one n-gram of all its words; a text without words
(or null) has no links and its own id as class; a row without id gets neither, and links
to nothing; repeated rows are copies of each other.  The id is an integer.  Other columns
are left aside.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from themeloom.llm.graph import components
from themeloom.llm.words import FACTORS, find_words, mix, sequence_hash, slices, window_hash, word_hashes
from themeloom.operators.scale import checked_broadcast
from themeloom.session import materialize

N = 5
THRESHOLD = 0.8
RECALL = 1 - 1e-6
HASHES = 200
# n-grams and nodes of a block; a task holds two blocks.
BLOCK_GRAMS = 1 << 18
BLOCK_NODES = 1024


def bands_for(threshold: float, recall: float, hashes: int) -> tuple[int, int]:
    """Bands and rows: the most rows whose bands reach ``recall`` with at most ``hashes``."""
    best = None
    for rows in range(1, hashes + 1):
        p = threshold ** rows
        bands = 1 if p >= recall else np.ceil(np.log1p(-recall) / np.log1p(-p))
        if bands * rows > hashes:
            break
        best = (int(bands), rows)
    if best is None:
        raise ValueError("too few hashes for this recall")
    return best


def gram_sets(part, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and hash of every different n-gram of a slice, sorted by both."""
    words = find_words(part)
    hashes = word_hashes(part.data, words)
    size = np.diff(words.first)
    count = np.where(size >= n, size - n + 1, np.minimum(size, 1))
    row = np.repeat(np.arange(part.rows), count)
    start = words.first[row] + np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
    end = np.minimum(start + n, words.first[row + 1])
    # A text of fewer words is one n-gram of its own kind.
    gram = np.empty(len(start), np.uint64)
    whole = end - start == n
    gram[whole] = window_hash(hashes, start[whole], n, 1)
    gram[~whole] = sequence_hash(hashes, start[~whole], end[~whole], 2)
    order = np.lexsort((gram, row))
    row, gram = row[order], gram[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (gram[1:] != gram[:-1])
    return row[new], gram[new]


def set_hashes(row, gram, rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Size and two order-free hashes of each set."""
    first = np.searchsorted(row, np.arange(rows + 1))
    out = [np.diff(first)]
    for factor in (FACTORS[2], FACTORS[3]):
        total = np.concatenate([[np.uint64(0)], np.cumsum(mix(gram * np.uint64(factor)), dtype=np.uint64)])
        out.append((total[first[1:]] - total[first[:-1]]).view(np.int64))
    return out[0], out[1], out[2]


def _signatures(n: int, bands: int, rows_per_band: int):
    seeds = np.random.default_rng(11).integers(1, 1 << 63, (bands * rows_per_band, 2), np.uint64) | np.uint64(1)
    schema = pa.schema([
        ("doc", pa.int64()), ("body", pa.int64()), ("n", pa.int32()), ("s1", pa.int64()), ("s2", pa.int64()),
        ("bands", pa.list_(pa.int64())),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch.column(1)):
                row, gram = gram_sets(part, n)
                size, s1, s2 = set_hashes(row, gram, part.rows)
                full = np.flatnonzero(size > 0)
                at = np.searchsorted(row, full)
                keys = np.zeros((len(full), bands), np.uint64)
                for i, (a, b) in enumerate(seeds if len(full) else ()):
                    # The upper half of a product mixes well enough for a minimum.
                    least = np.minimum.reduceat((gram ^ b) * a >> np.uint64(16), at)
                    band = i // rows_per_band
                    keys[:, band] = mix(keys[:, band] + least * np.uint64(FACTORS[i % 4]) + np.uint64(i))
                yield pa.RecordBatch.from_arrays([
                    *(batch.column(c).slice(part.first, part.rows).take(pa.array(full)) for c in (0, 2)),
                    pa.array(size[full], pa.int32()), pa.array(s1[full]), pa.array(s2[full]),
                    pa.ListArray.from_arrays(
                        pa.array(np.arange(0, len(full) * bands + 1, bands), pa.int32()),
                        pa.array(keys.view(np.int64).ravel())),
                ], schema=schema)

    return run


def _sets(n: int):
    schema = pa.schema([
        ("node", pa.int64()), ("component", pa.int64()), ("weight", pa.int64()), ("blocks", pa.int32()),
        ("n", pa.int32()), ("s1", pa.int64()), ("s2", pa.int64()), ("grams", pa.binary()),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch.column(0)):
                row, gram = gram_sets(part, n)
                size, s1, s2 = set_hashes(row, gram, part.rows)
                first = np.searchsorted(row, np.arange(part.rows + 1))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(c).slice(part.first, part.rows) for c in (1, 2, 3, 4)]
                    + [pa.array(size, pa.int32()), pa.array(s1), pa.array(s2)]
                    + [pa.array([gram[first[i]:first[i + 1]].tobytes() for i in range(part.rows)], pa.binary())],
                    schema=schema)

    return run


def shared_counts(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """Common n-grams of every set of ``a`` with every set of ``b``."""
    flat = np.concatenate([*a, *b])
    row = np.repeat(np.arange(len(a) + len(b)), [len(x) for x in (*a, *b)])
    _, name, often = np.unique(flat, return_inverse=True, return_counts=True)
    keep = often[name] > 1
    row, name = row[keep], name[keep]
    order = np.argsort(name, kind="stable")
    row, name = row[order], name[order]
    name = np.cumsum(np.append(False, name[1:] != name[:-1])) if len(name) else name
    out = np.zeros((len(a), len(b)), np.float32)
    width = max(256, (4 << 20) // (len(a) + len(b)))
    for low in range(0, int(name[-1]) + 1 if len(name) else 0, width):
        x, y = np.searchsorted(name, [low, low + width])
        dense = np.zeros((len(a) + len(b), width), np.float32)
        dense[row[x:y], name[x:y] - low] = 1
        out += dense[:len(a)] @ dense[len(a):].T
    return out


def forest(x: np.ndarray, y: np.ndarray, links: np.ndarray) -> tuple[list, list]:
    """Links that keep connected what the whole matrix connects."""
    up: dict = {}

    def top(v):
        while up.setdefault(v, v) != v:
            up[v] = up[up[v]]
            v = up[v]
        return v

    out_a, out_b = [], []
    for i in range(len(x)):
        for j in np.flatnonzero(links[i]):
            p, q = top(x[i]), top(y[j])
            if p != q:
                up[p] = q
                out_a.append(x[i])
                out_b.append(y[j])
    return out_a, out_b


def _verify(threshold: float):
    def run(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        _, i, j = key
        group = group.drop_duplicates("node").sort_values("node")
        left = group[group["block"] == i]
        right = left if i == j else group[group["block"] == j]
        a = [np.frombuffer(g, np.uint64) for g in left["grams"]]
        b = a if i == j else [np.frombuffer(g, np.uint64) for g in right["grams"]]
        empty = pd.DataFrame({"node": [], "links": [], "other": []})
        if not a or not b:
            return empty
        common = shared_counts(a, b)
        sizes = np.array([len(x) for x in a])[:, None] + np.array([len(x) for x in b])[None, :]
        # common / union >= threshold, without rounding on the edge of it.
        linked = common.astype(float) * (1 + threshold) >= threshold * sizes - 1e-6
        x, y = left["node"].to_numpy(), right["node"].to_numpy()
        linked &= x[:, None] != y[None, :]
        counts = pd.DataFrame({"node": x, "links": linked @ right["weight"].to_numpy()})
        if i != j:
            counts = pd.concat([
                counts, pd.DataFrame({"node": y, "links": linked.T @ left["weight"].to_numpy()})])
        counts["other"] = pd.NA
        p, q = forest(x, y, linked)
        out = pd.concat([counts[counts["links"] > 0], pd.DataFrame({"node": p, "links": 0, "other": q})])
        return out.astype({"node": "int64", "links": "int64", "other": "Int64"}) if len(out) else empty

    return run


def classes(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = N,
    threshold: float = THRESHOLD, recall: float = RECALL, hashes: int = HASHES,
) -> DataFrame:
    """One row per row of ``df``: ``id_col``, ``class_id`` and ``n_links``.

    ``n_links`` counts the other rows whose similarity is at least ``threshold``;
    ``class_id`` is the least id of all rows connected by links.
    """
    kind = df.schema[id_col].dataType.simpleString()
    rows, alone = _classes(df, id_col, text_col, n, threshold, recall, hashes)
    alone = alone.select("doc", F.col("doc").alias("class_id"), F.lit(0).cast("long").alias("n_links"))
    return rows.select("doc", "class_id", "n_links").unionByName(alone).select(
        F.col("doc").cast(kind).alias(id_col), "class_id", "n_links")


def _classes(df, id_col, text_col, n, threshold, recall, hashes) -> tuple[DataFrame, DataFrame]:
    """Rows with n-grams as ``doc, body, component, class_id, n_links``, and the others."""
    bands, rows_per_band = bands_for(threshold, recall, hashes)
    docs = df.select(
        F.col(id_col).cast("long").alias("doc"), F.col(text_col).cast("string").alias("text"),
        F.xxhash64(F.col(text_col).cast("string")).alias("body"))
    signed = materialize(
        docs.where("doc is not null").mapInArrow(
            _signatures(n, bands, rows_per_band),
            "doc long, body long, n int, s1 long, s2 long, bands array<long>")
        .withColumn("node", F.xxhash64("s1", "s2", "n")),
        "signatures")
    nodes = materialize(
        signed.groupBy("node").agg(
            F.min("doc").alias("doc"), F.count("*").alias("weight"), F.min("n").alias("n")), "nodes")
    # One row of each node carries the bands into the buckets.
    keyed = (
        signed.join(nodes.select("node", F.col("doc").alias("_first")), "node").where("doc = _first")
        .select("node", F.posexplode("bands").alias("band", "value"))
    )
    buckets = materialize(keyed, "bands")
    center = (
        buckets.groupBy("band", "value").agg(F.min("node").alias("center"), F.max("node").alias("most"))
        .where("center < most").select("band", "value", "center")
    )
    near = components(
        buckets.join(center, ["band", "value"]).select(F.col("node").alias("a"), F.col("center").alias("b")))
    members = materialize(near.join(nodes, "node"), "members")
    size = members.groupBy("component").agg(
        F.ceil(F.greatest(F.sum("n") / BLOCK_GRAMS, F.count("*") / BLOCK_NODES)).cast("int").alias("blocks"))
    wanted = materialize(
        members.join(size, "component").select("doc", "node", "component", "weight", "blocks"), "wanted")
    sets = (
        # Texts stay where they are while the nodes to look at are few.
        docs.join(checked_broadcast(wanted), "doc").select("text", "node", "component", "weight", "blocks")
        .mapInArrow(
            _sets(n),
            "node long, component long, weight long, blocks int, n int, s1 long, s2 long, grams binary")
        .where(F.col("node") == F.xxhash64("s1", "s2", "n"))
        .withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    )
    faced = sets.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "node", "component", "weight", "grams", "block",
        F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))
    found = materialize(
        faced.groupBy("component", "i", "j").applyInPandas(
            _verify(threshold), "node long, links long, other long"),
        "verified")
    links = found.where("other is null").groupBy("node").agg(F.sum("links").alias("links"))
    joined = components(found.where("other is not null").select(F.col("node").alias("a"), F.col("other").alias("b")))
    told = materialize(
        nodes.join(links, "node", "left").join(joined, "node", "left").select(
            "node", "doc", F.coalesce("component", "node").alias("component"),
            (F.col("weight") - 1 + F.coalesce("links", F.lit(0))).alias("n_links")), "nodes")
    least = told.groupBy("component").agg(F.min("doc").alias("class_id"))
    told = told.join(least, "component").select("node", "component", "class_id", "n_links")
    rows = signed.select("doc", "body", "node").join(told, "node").select(
        "doc", "body", "component", "class_id", "n_links")
    alone = docs.where(
        F.col("doc").isNull() | F.col("text").isNull() | ~F.col("text").rlike("[^\\x20\\x09-\\x0D]"))
    return rows, alone.select("doc", "body")


def one_of_each(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = N,
    threshold: float = THRESHOLD, recall: float = RECALL, hashes: int = HASHES,
) -> DataFrame:
    """``df`` with one row of each class, that of the least id; of repeated rows, one.

    Rows without id or words stay.
    """
    rows, _ = _classes(df, id_col, text_col, n, threshold, recall, hashes)
    first = rows.groupBy("component").agg(F.min(F.struct("doc", "body")).alias("kept")).select("kept.*")
    at = df.select("*", F.col(id_col).cast("long").alias("_doc"), F.xxhash64(F.col(text_col).cast("string")).alias("_body"))
    kept = at.join(
        first.select(F.col("doc").alias("_kept"), F.col("body").alias("_text")),
        (F.col("_doc") == F.col("_kept")) & (F.col("_body") == F.col("_text")),
    ).dropDuplicates(["_doc", "_body"]).select(*df.columns)
    text = F.col(text_col).cast("string")
    others = df.where(F.col(id_col).isNull() | text.isNull() | ~text.rlike("[^\\x20\\x09-\\x0D]"))
    return kept.unionByName(others)
