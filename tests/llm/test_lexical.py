import math
import re
from collections import Counter

import duckdb
import numpy as np
import pandas as pd
import pytest

from themeloom.llm import lexical, queries

UPPER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def terms(text):
    return [t.translate(UPPER) for t in re.findall("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", text or "")]


def brute(docs, items, k):
    counts = [(i, Counter(terms(t))) for i, t in docs]
    counts = [(i, c, sum(c.values())) for i, c in counts if c]
    n_docs, total = len(counts), sum(n for *_, n in counts)
    df = Counter(t for _, c, _ in counts for t in c)
    out = []
    for item, text in set(items):
        asked = terms(text)
        scored = []
        for i, c, n in counts:
            m = 25 + 75 * n * n_docs // total
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m))
                    for t in asked if c[t])
            if s > 0:
                scored.append((-s, i is None, i))
        out += [(item, r + 1, i, -s) for r, (s, _, i) in enumerate(sorted(scored, key=lambda x: (x[0], x[1], x[2] or 0))[:k])]
    return sorted(out, key=repr)


def corpus(seed):
    r = np.random.default_rng(seed)
    words = [f"w{i}" for i in range(40)] + ["é", "Ünï", "日本", "X9", "the", "The"]
    p = 1 / np.arange(1, len(words) + 1)
    docs = [(int(i), " ".join(r.choice(words, int(r.integers(0, 40)), p=p / p.sum()))) for i in range(700)]
    docs += [(1000 + i, docs[5][1] + " w39 w39") for i in range(400)]
    docs += [(None, "w39 the X9"), (None, "w39 the X9"), (7, docs[7][1]), (7, "w38 w38"), (2000, None), (2001, ""),
             (2002, "--- ... "), (2003, "the " * 30_000 + "w39"), (-5, "w39,w38;W39")]
    items = [(int(i), " ".join(r.choice(words, int(r.integers(0, 9))))) for i in range(30)]
    items += [(1, items[1][1]), (2, "w1 w1 W1-w2"), (None, "the"), (40, None), (41, "unknown here"), (42, ""), (43, "w39 " * 50)]
    return docs, items


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_brute_force(spark, seed, monkeypatch):
    docs, items = corpus(seed)
    a = spark.createDataFrame([(*x, 1) for x in docs], "doc_id long, text string, score int").repartition(4)
    b = spark.createDataFrame([(*x, 2) for x in items], "item_id long, text string, rank int")
    want = brute(docs, items, 10)
    assert sorted((tuple(x) for x in lexical.rank(a, b).collect()), key=repr) == want
    # Small buckets, a first search that sees few vectors, and several rounds of items give the same.
    monkeypatch.setattr(lexical, "BUCKET_ROWS", 16)
    monkeypatch.setattr(lexical, "LEAST_ROWS", 4)
    monkeypatch.setattr(lexical, "FIRST_ROWS", 20)
    assert sorted((tuple(x) for x in lexical.rank(a, b, item_bytes=300).collect()), key=repr) == want


def test_empty_tables_and_other_names(spark):
    a = spark.createDataFrame([(1, "a b"), (2, "b c")], "k int, body string")
    b = spark.createDataFrame([("x", "B")], "name string, ask string")
    names = dict(id_col="k", text_col="body", item_col="name", item_text_col="ask")
    got = lexical.rank(a, b, **names)
    assert [tuple(x)[:3] for x in got.orderBy("rank").collect()] == [("x", 1, 1), ("x", 2, 2)]
    assert got.dtypes == [("name", "string"), ("rank", "int"), ("k", "int"), ("score", "bigint")]
    assert lexical.rank(a.limit(0), b, **names).count() == 0
    assert lexical.rank(a, b.limit(0), **names).count() == 0


def test_bounds_prune_and_lose_nothing():
    r = np.random.default_rng(3)
    terms_, rows = 60, 3000
    dense = np.where(r.random((rows, terms_)) < 0.15, (r.random((rows, terms_)) ** 4 * 1e6).astype(np.int64) + 1, 0)
    dense = dense[(dense > 0).any(axis=1)]
    norm = np.sqrt((dense.astype(float) ** 2).sum(axis=1))
    dense, norm = dense[np.argsort(-norm)], np.sort(norm)[::-1]
    spans = list(lexical.buckets(norm))
    assert [a for a, _ in spans] == [0, *(b for _, b in spans[:-1])] and spans[-1][1] == len(norm)
    rescored = 0
    for seed in range(20):
        own = np.random.default_rng(seed)
        term = np.sort(own.choice(terms_, 6, replace=False))
        query = np.zeros(terms_, np.int64)
        query[term] = own.integers(1, 4, 6)
        exact = dense @ query
        least = float(np.sort(exact)[-10])
        found = []
        for a, b in spans:
            row, column = np.nonzero(dense[a:b])
            first = np.searchsorted(row, np.arange(b - a + 1))
            bucket = lexical.Bucket(norm[a:b], first, column, dense[a:b][row, column], terms_)
            near = bucket.candidates(term, query[term], least)
            rescored += len(near)
            assert not len(near) or (bucket.scores(near, query) == exact[a:b][near]).all()
            found += list(a + near)
        assert set(np.flatnonzero(exact >= least)) <= set(found)
    assert rescored < 0.2 * 20 * len(norm)


def test_query_equals_sql(spark, sf):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    theirs, ours = con.execute(lexical.SQL).df(), queries.op12_lexical(spark, sf).toPandas()
    key = ["item_id", "rank"]
    pd.testing.assert_frame_equal(
        ours.sort_values(key, ignore_index=True), theirs[ours.columns].sort_values(key, ignore_index=True), check_dtype=False)
