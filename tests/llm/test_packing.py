import zlib
from array import array
from functools import lru_cache

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from themeloom.llm import packing, queries

PATH = public_tokenizers.path("word_bpe_49k.json")


def packed(counts, patterns):
    got = np.zeros_like(counts)
    for items, times in patterns:
        assert times > 0 and sum(x * n for x, n in items) <= len(counts) - 1
        for x, n in items:
            got[x] += n * times
    assert np.array_equal(got, counts)
    return packing.sequences(patterns)


def fewest(lengths, size):
    """Exact number of sequences, by subsets."""
    n = len(lengths)

    @lru_cache(None)
    def best(mask):
        if mask == (1 << n) - 1:
            return 1, 0
        out = (n + 1, 0)
        for k in range(n):
            if mask >> k & 1:
                continue
            used, room = best(mask | 1 << k)
            room = (used, room + lengths[k]) if room + lengths[k] <= size else (used + 1, lengths[k])
            out = min(out, room)
        return out

    return best(0)[0] if n else 0


def test_patterns_hold_all_pieces_and_few_sequences():
    rng = np.random.default_rng(3)
    optimal = 0
    for _ in range(60):
        size = int(rng.integers(8, 30))
        lengths = rng.integers(1, size + 1, rng.integers(0, 10)).tolist()
        counts = np.bincount(lengths, minlength=size + 1) if lengths else np.zeros(size + 1, np.int64)
        simple, found, exact = packed(counts, packing.best_fit(counts)), packed(counts, packing.complete(counts)), fewest(tuple(lengths), size)
        assert packing.lower_bound(counts) <= exact <= found <= simple
        optimal += found == exact
    assert optimal >= 58


def test_large_instance_reaches_the_bound():
    rng = np.random.default_rng(1)
    counts = np.bincount(np.clip(rng.lognormal(6.6, 1, 100_000), 1, 2048).astype(int), minlength=2049)
    assert packed(counts, packing.complete(counts)) == packing.lower_bound(counts)


def verify(rows, texts, capacity):
    """Pieces restore every document; sequences have no gap and no overlap."""
    library = Tokenizer.from_file(PATH)
    want = sorted(
        (i, p, at, len(ids[at:at + capacity]), zlib.crc32(array("I", ids[at:at + capacity]).tobytes()))
        for i, t in texts
        for ids in [library.encode(t or "", add_special_tokens=False).ids + [0]]
        for p, at in enumerate(range(0, len(ids), capacity))
    )
    assert sorted(tuple(r)[:5] for r in rows) == want
    places = {}
    for r in rows:
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for own in places.values():
        end = 0
        for offset, length in sorted(own):
            assert offset == end
            end += length
        assert end <= capacity
    return len(places)


def test_odd_texts(spark):
    texts = [(1, None), (2, ""), (3, "word " * 100), (3, "word " * 100), (4, "a b c"), (None, "x"), (5, "q" * 3000)]
    df = spark.createDataFrame([(*t, 1, 2) for t in texts], "doc_id long, text string, length int, task int")
    rows = packing.pack(df, PATH, capacity=16, with_ids=True).collect()
    for r in rows:
        assert len(r["ids"]) == 4 * r["length"]
    # A row without id is a row like others; sorting needs a number.
    rows = packing.pack(df.na.fill(-1, ["doc_id"]), PATH, capacity=16).collect()
    verify(rows, [(-1 if i is None else i, t) for i, t in texts], 16)
    assert packing.pack(df, PATH, capacity=16).where("doc_id is null").count() == 1
    assert packing.pack(df.limit(0), PATH).count() == 0


@pytest.mark.parametrize("capacity", [2048])
def test_query(spark, sf, capacity):
    texts = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = queries.op5_packing(spark, sf)
    assert got.dtypes == [("doc_id", "bigint"), ("piece", "int"), ("start", "bigint"), ("length", "bigint"),
                          ("ids_crc32", "bigint"), ("sequence_id", "bigint"), ("offset", "bigint")]
    rows = got.collect()
    used = verify(rows, texts, capacity)
    counts = np.bincount([r["length"] for r in rows], minlength=capacity + 1)
    assert used <= packing.lower_bound(counts) + 1
