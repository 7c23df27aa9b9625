"""Language ID by nearest centroid.

A text is a TF-IDF vector of hashed byte trigrams of its letters, of length one.  A
language has several centroids, found by clustering a bounded sample of its labelled
texts.  The prediction is the language of the centroid with the largest cosine, which
is the score.  A text farther from every centroid than labelled texts of similar size
usually are, by a margin, is rejected.

Document frequencies cover all training texts; the sample (``per_language`` different
texts of each language, picked by a hash) only places the centroids and the limits.

Defined results: a null text or one without a letter is ``und`` with score 0 and
rejected; a text too short for a trigram gets the language of the first centroid in
order, score 0; with nothing to learn from, everything is ``und``; repeated rows give
repeated results; other columns are left aside.  Ties go to the first language by name.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from themeloom.llm.bpe import _id_type
from themeloom.llm.words import Slice, slices
from themeloom.operators.scale import checked_broadcast
from themeloom.session import materialize

BUCKETS = 8192
CENTROIDS = 4
PER_LANGUAGE = 600
# A text is rejected below this part of the median cosine of labelled texts of its size,
# so that a few odd texts among them do not move the limit.  Texts of fewer different
# trigrams than 2^JUDGED_FROM say too little to be rejected.
MARGIN = 0.25
JUDGED_FROM = 5
SIZE_BANDS = 24

# A byte as trigrams see it: lower case letters, bytes of other alphabets, one blank.
_SEEN = np.full(256, 32, np.uint8)
_SEEN[97:123] = np.arange(97, 123)
_SEEN[65:91] = np.arange(97, 123)
_SEEN[128:] = np.arange(128, 256)


@dataclass
class Model:
    idf: np.ndarray
    languages: list[str]
    centroids: np.ndarray
    owner: np.ndarray
    limits: np.ndarray


def counts(part: Slice) -> np.ndarray:
    """Trigram counts, one row per text."""
    seen = _SEEN[part.data]
    if len(seen) > 1:
        # Capitals of the Latin-1 letters become small ones.
        capital = (seen[:-1] == 0xC3) & (seen[1:] >= 0x80) & (seen[1:] <= 0x9E)
        seen[1:][capital] += 32
    n = len(seen)
    if n < 3:
        return np.zeros((part.rows, BUCKETS), np.float32)
    wide = seen.astype(np.uint32)
    code = wide[:-2] << 16 | wide[1:-1] << 8 | wide[2:]
    row = np.repeat(np.arange(part.rows), np.diff(part.bounds))
    keep = (row[:-2] == row[2:]) & (seen[1:-1] != 32)
    bucket = (code[keep] * np.uint32(2654435761)) >> np.uint32(32 - BUCKETS.bit_length() + 1)
    flat = np.bincount(row[:-2][keep] * BUCKETS + bucket, minlength=part.rows * BUCKETS)
    return flat.reshape(part.rows, BUCKETS).astype(np.float32)


def unit_vectors(found: np.ndarray, idf: np.ndarray) -> np.ndarray:
    found = np.log1p(found) * idf
    length = np.sqrt((found * found).sum(axis=1, keepdims=True))
    return found / np.maximum(length, 1e-12)


def size_band(found: np.ndarray) -> np.ndarray:
    """Band of a text by its number of different trigrams, in powers of two."""
    return np.minimum(np.log2(1 + (found > 0).sum(axis=1)).astype(int), SIZE_BANDS - 1)


def _few(column: pa.Array) -> Iterator[Slice]:
    return slices(column, max_rows=128)


def document_frequencies(df: DataFrame, text_col: str) -> tuple[np.ndarray, int]:
    """Texts per trigram bucket, and all texts; what reaches the driver has a fixed size."""
    schema = pa.schema([("bucket", pa.int32()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, rows = np.zeros(BUCKETS, np.int64), 0
        for batch in batches:
            for part in _few(batch.column(0)):
                total += (counts(part) > 0).sum(axis=0)
                rows += part.rows
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([
            pa.array(np.append(at, -1), pa.int32()), pa.array(np.append(total[at], rows)),
        ], schema=schema)

    sums = (
        df.select(F.col(text_col).alias("_text")).mapInArrow(run, "bucket int, n long")
        .groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    )
    found, rows = np.zeros(BUCKETS), 0
    for bucket, n in sums:
        if bucket < 0:
            rows = n
        else:
            found[bucket] = n
    return found, rows


def cluster(vectors: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Centroids of unit vectors by cosine; starts are far from those before.

    A start is not the farthest text but one farther than nine in ten, and clusters of a
    few texts are dropped: odd texts get no centroid of their own.
    """
    chosen = [0]
    best = vectors @ vectors[0]
    while len(chosen) < min(k, len(vectors)):
        far = int(np.argsort(best, kind="stable")[len(best) // 10])
        if best[far] > 1 - 1e-6:
            break
        chosen.append(far)
        best = np.maximum(best, vectors @ vectors[far])
    centers = vectors[chosen]
    for _ in range(rounds):
        label = (vectors @ centers.T).argmax(axis=1)
        sums = np.zeros_like(centers)
        np.add.at(sums, label, vectors)
        length = np.sqrt((sums * sums).sum(axis=1, keepdims=True))
        centers = np.where(length > 0, sums / np.maximum(length, 1e-12), centers)
    size = np.bincount((vectors @ centers.T).argmax(axis=1), minlength=len(centers))
    return centers[size >= min(size.max(), max(3, len(vectors) // 20))]


def fit(
    df: DataFrame, text_col: str = "text", lang_col: str = "lang",
    per_language: int = PER_LANGUAGE, centroids: int = CENTROIDS,
) -> Model | None:
    """Learn from the labelled rows of ``df``; ``None`` if there are none."""
    rows = df.select(
        F.col(text_col).cast("string").alias("_text"), F.col(lang_col).cast("string").alias("_lang")
    ).where("_text is not null and _lang is not null")
    # Copies of a text are one text here, known by its hash; they all would be picked or left.
    hashed = rows.withColumn("_hash", F.xxhash64("_text"))
    sizes = materialize(
        hashed.select("_lang", "_hash").distinct().groupBy(F.col("_lang").alias("_of")).agg(F.count("*").alias("_n")), "sizes")
    if sizes.isEmpty():
        return None
    found, total = document_frequencies(rows, "_text")
    idf = (np.log((1 + total) / (1 + found)) + 1).astype(np.float32)
    # The hash picks about per_language different texts of each language where they lie.
    share = F.least(F.lit(1 << 30), (F.lit((1 << 30) * 1.2 * per_language) / F.col("_n")).cast("long"))
    picked = (
        hashed.select("_lang", "_text", F.pmod("_hash", F.lit(1 << 30)).alias("_pick"))
        .join(checked_broadcast(sizes), F.col("_lang") == F.col("_of"))
        .where(F.col("_pick") < share).select("_lang", "_text", "_pick").distinct()
    )

    def one_language(key, group):
        import pandas as pd

        group = group.sort_values("_pick").head(per_language)
        column = pa.array(group["_text"], pa.string())
        found = np.concatenate([counts(p) for p in _few(column)])
        found = found[found.any(axis=1)]
        if not len(found):
            return pd.DataFrame({"_lang": [], "centers": [], "usual": []})
        vectors = unit_vectors(found, idf)
        centers = cluster(vectors, centroids)
        best, band = (vectors @ centers.T).max(axis=1), size_band(found)
        usual = [float(np.median(best[band == b])) if (band == b).any() else np.nan for b in range(SIZE_BANDS)]
        return pd.DataFrame({"_lang": [key[0]], "centers": [centers.astype("<f4").tobytes()], "usual": [usual]})

    learned = (
        picked.groupBy("_lang")
        .applyInPandas(one_language, "_lang string, centers binary, usual array<double>")
        .collect()
    )
    learned = sorted(learned, key=lambda r: r["_lang"])
    if not learned:
        return None
    blocks = [np.frombuffer(bytes(r["centers"]), "<f4").reshape(-1, BUCKETS) for r in learned]
    usual = np.array([r["usual"] for r in learned], float)
    # The usual cosine at a size or nearly that size.
    seen = np.pad(np.fmin.reduce(usual, axis=0), (1, 2), constant_values=np.nan)
    near = np.fmin.reduce([seen[i:i + SIZE_BANDS] for i in range(4)], axis=0)
    # A size never seen is judged as the next smaller one; below the smallest there is no limit.
    for band in range(1, SIZE_BANDS):
        if np.isnan(near[band]):
            near[band] = near[band - 1]
    limits = np.where(np.isnan(near), 0, near) * MARGIN
    limits[:JUDGED_FROM] = 0
    return Model(
        idf, [r["_lang"] for r in learned], np.concatenate(blocks),
        np.repeat(np.arange(len(blocks)), [len(b) for b in blocks]), limits,
    )


def has_letter(part: Slice) -> np.ndarray:
    """Per text, whether it has a letter of any alphabet."""
    plain = ((part.data | 32) >= 97) & ((part.data | 32) <= 122)
    seen = np.concatenate([[0], np.cumsum(plain)])
    out = seen[part.bounds[1:]] > seen[part.bounds[:-1]]
    for i in np.flatnonzero(~out):
        raw = part.data[part.bounds[i]:part.bounds[i + 1]]
        if (raw >= 128).any():
            out[i] = any(map(str.isalpha, raw.tobytes().decode(errors="replace")))
    return out


def judge(model: Model | None, part: Slice) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Language, score and rejection of each text of a slice."""
    known, score = has_letter(part), np.zeros(part.rows)
    lang, rejected = np.full(part.rows, "und", object), np.ones(part.rows, bool)
    if model is not None:
        found = counts(part)
        cosines = unit_vectors(found, model.idf) @ model.centroids.T
        best = cosines.argmax(axis=1)
        score = np.where(known, np.clip(cosines[np.arange(part.rows), best], 0, 1), 0).astype(float)
        lang = np.where(known, np.array(model.languages, object)[model.owner[best]], lang)
        rejected = ~known | (score < model.limits[size_band(found)])
    return lang, score, rejected


def predict(
    df: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``id_col``, ``lang_pred``, ``score`` and ``rejected`` of every text."""
    kind, arrow_kind = _id_type(df, id_col)
    schema = pa.schema([
        ("_id", arrow_kind), ("lang_pred", pa.string()), ("score", pa.float64()), ("rejected", pa.bool_()),
    ])
    # Plain values, so that tasks need no copy of the package to read them.
    sent = df.sparkSession.sparkContext.broadcast(model and vars(model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value and Model(**sent.value)
        for batch in batches:
            for part in _few(batch.column(1)):
                lang, score, rejected = judge(own, part)
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(part.first, part.rows), pa.array(lang, pa.string()),
                    pa.array(score), pa.array(rejected),
                ], schema=schema)

    return (
        df.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"))
        .mapInArrow(run, f"_id {kind}, lang_pred string, score double, rejected boolean")
        .withColumnRenamed("_id", id_col)
    )


def accepted(df: DataFrame, model: Model | None, text_col: str = "text") -> DataFrame:
    """The rows of ``df``, all columns, whose text is not rejected."""
    # Plain values, so that tasks need no copy of the package to read them.
    sent = df.sparkSession.sparkContext.broadcast(model and vars(model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value and Model(**sent.value)
        for batch in batches:
            rows = batch.select(range(1, batch.num_columns))
            for part in _few(batch.column(0)):
                keep = ~judge(own, part)[2]
                yield rows.slice(part.first, part.rows).filter(pa.array(keep))

    return df.select(F.col(text_col).cast("string").alias("__text"), *df.columns).mapInArrow(run, df.schema)
