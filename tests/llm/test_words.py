import numpy as np
import pyarrow as pa

from pyspark.sql import functions as F

from themeloom.llm import jaccard, lines, lm, substrings, words


def thue_morse(n):
    return [bin(i).count("1") % 2 for i in range(n)]


A = "".join("ab"[b] for b in thue_morse(1024))
B = "".join("ba"[b] for b in thue_morse(1024))


def test_no_equal_hashes_by_structure():
    one = np.array([7, 9], np.uint64)[thue_morse(1024)]
    two = np.array([9, 7], np.uint64)[thue_morse(1024)]
    both, starts, ends = np.concatenate([one, two]), np.array([0, 1024]), np.array([1024, 2048])
    # The candidate hash has them equal, the others must not.
    a, b = words.span_hash(both, starts, ends, words.FACTORS[0])
    assert a == b
    for family in range(4):
        for found in (words.sequence_hash(both, starts, ends, family), words.window_hash(both, starts, 1024, family),
                      words.field_hash(both, starts, ends, family)):
            assert found[0] != found[1]


def test_equal_spans_have_equal_hashes_wherever_they_are():
    r = np.random.default_rng(2)
    values = r.integers(0, 1 << 63, 5000, np.uint64)
    values[3000:3100] = values[100:200]
    starts, ends = np.array([100, 3000, 101]), np.array([200, 3100, 201])
    for found in (words.field_hash(values, starts, ends, 0), words.window_hash(values, starts, 100, 0)):
        assert found[0] == found[1] != found[2]
    in_turn = words.sequence_hash(values, np.array([0, 100, 3000]), np.array([100, 200, 3100]), 0)
    assert in_turn[1] == in_turn[2] != in_turn[0]
    empty = np.zeros(0, np.int64)
    assert len(words.sequence_hash(values, empty, empty, 0)) == len(words.field_hash(values, empty, empty, 0)) == 0


def documents(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def test_words_of_letters_that_collide_by_structure(spark):
    got = {r.doc_id: r.n_links for r in jaccard.classes(documents(spark, A, B)).collect()}
    assert got == {0: 0, 1: 0}
    tail = " ".join(f"w{i}" for i in range(49))
    got = {r.doc_id: r.n_removed for r in substrings.dedup(documents(spark, f"{A} {tail}", f"{B} {tail}")).collect()}
    assert got == {0: 0, 1: 0}
    kept = lines.dedup(documents(spark, A, B, A, "x y", "z"))
    assert all(r.n_dropped == 0 for r in kept.collect())
    scored = lm.score(documents(spark, A, B), F.col("doc_id") == 0).collect()
    assert {r.doc_id: r.n_known for r in scored} == {0: 2, 1: 1}


def test_sequences_of_words_that_collide_by_structure(spark):
    a, b = (" ".join(["un", "deux"][x ^ y] for x in thue_morse(2048)) for y in (0, 1))
    docs = documents(spark, a, b)
    want = []
    seen = set()
    for text in (a, b):
        own = text.split(" ")
        gone = set()
        windows = [tuple(own[i:i + 50]) for i in range(len(own) - 49)]
        for i, w in enumerate(windows):
            if w in seen:
                gone |= set(range(i, i + 50))
        seen |= set(windows)
        want.append(len(gone))
    got = {r.doc_id: r.n_removed for r in substrings.dedup(docs).collect()}
    assert got == {0: want[0], 1: want[1]}
    assert all(r.n_dropped == 0 for r in lines.dedup(documents(spark, a, b, "x", "y")).collect())
    column = pa.array([a, b])
    part = next(words.slices(column))
    assert len(set(lines.Lines(part, 3).content)) == 2
