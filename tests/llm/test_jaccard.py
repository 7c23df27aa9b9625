import random
import re

import numpy as np
import pytest

from themeloom.llm import graph, jaccard, queries


def grams(text, n):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    return frozenset(tuple(w[i:i + n]) for i in range(max(1, len(w) - n + 1))) if w else frozenset()


def brute(rows, n=5, threshold=0.8):
    """Class and links of each row by comparing sets that share an n-gram."""
    sets = [grams(t, n) for _, t in rows]
    by = {}
    for k, s in enumerate(sets):
        for g in s:
            by.setdefault(g, []).append(k)
    up, links = list(range(len(rows))), [0] * len(rows)

    def top(v):
        while up[v] != v:
            v = up[v]
        return v

    for k, s in enumerate(sets):
        if rows[k][0] is None:
            continue
        for m in {m for g in s for m in by[g]}:
            if m != k and rows[m][0] is not None and len(s & sets[m]) / len(s | sets[m]) >= threshold:
                links[k] += 1
                up[max(top(k), top(m))] = min(top(k), top(m))
    brute.parts = len({top(k) for k, (i, t) in enumerate(rows) if i is not None and sets[k]})
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[top(k)] = min(i, least.get(top(k), i))
    return sorted(((i, least.get(top(k)) if i is not None else None, links[k])
                   for k, (i, _) in enumerate(rows)), key=repr)


def copies(seed, groups, size):
    r = random.Random(seed)
    vocab = [f"w{i}" for i in range(500)]
    rows = []
    for _ in range(groups):
        base = r.choices(vocab, k=r.choice([6, 40, 200]))
        for _ in range(size):
            w = list(base)
            for _ in range(r.randint(0, max(1, len(w) // 30))):
                w[r.randrange(len(w))] = r.choice(vocab)
            rows.append((len(rows), " ".join(w)))
    return rows


def test_classes_and_links_equal_brute_force(spark, monkeypatch):
    rows = copies(1, 12, 12)
    rows += [(1000, None), (1001, ""), (1002, " \n"), (1003, "one two"), (1004, "one two"), (1005, "one"),
             (None, rows[0][1]), (1006, "w1 " * 40_000), (3, rows[3][1]), (3, rows[40][1])]
    df = spark.createDataFrame([(*x, 1, "c") for x in rows], "doc_id long, text string, node int, component string")
    want = brute(rows)
    assert sorted(map(tuple, jaccard.classes(df).collect()), key=repr) == want
    # Small blocks, so that groups are compared block by block.
    monkeypatch.setattr(jaccard, "BLOCK_NODES", 4)
    assert sorted(map(tuple, jaccard.classes(df).collect()), key=repr) == want
    kept = jaccard.one_of_each(df)
    assert kept.columns == df.columns
    got = sorted((tuple(r)[:2] for r in kept.collect()), key=repr)
    assert {c for _, c, _ in want if c is not None} == {i for i, _ in got if i is not None}
    # One row of each class, and the four rows without an id or words.
    brute(rows)
    assert len(got) == brute.parts + 4


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id int, text string")
    assert jaccard.classes(df).count() == 0
    assert jaccard.one_of_each(df).count() == 0


def test_bands_reach_the_recall():
    for threshold, recall in ((0.8, 1 - 1e-6), (0.5, 0.95)):
        bands, rows = jaccard.bands_for(threshold, recall, 200)
        assert bands * rows <= 200 and 1 - (1 - threshold ** rows) ** bands >= recall


def test_counts_and_forest():
    r = np.random.default_rng(5)
    a = [np.unique(r.integers(0, 50, 30).astype(np.uint64)) for _ in range(9)]
    b = [np.unique(r.integers(0, 50, 30).astype(np.uint64)) for _ in range(7)]
    want = [[len(np.intersect1d(x, y)) for y in b] for x in a]
    assert np.array_equal(jaccard.shared_counts(a, b), want)


@pytest.mark.parametrize("seed", [1, 2])
def test_components(spark, seed):
    r = random.Random(seed)
    pairs = [(i, i + 1) for i in range(0, 60)] + [(r.randint(100, 160), r.randint(100, 160)) for _ in range(25)]
    r.shuffle(pairs)
    up = {}

    def top(v):
        while up.setdefault(v, v) != v:
            v = up[v]
        return v

    for x, y in pairs:
        up[max(top(x), top(y))] = min(top(x), top(y))
    got = {tuple(x) for x in graph.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    want = {(v, top(v)) for p in pairs if p[0] != p[1] for v in p}
    assert got == want


def test_query_equals_brute_force(spark, sf):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert sorted(map(tuple, queries.op9_jaccard(spark, sf).collect()), key=repr) == brute(rows)
