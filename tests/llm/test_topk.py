import math

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from themeloom.llm import queries, topk


def brute(rows, k, scale=1024, every=3):
    good = {}
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            good.setdefault(i, set()).add(tuple(math.floor(scale * float(np.float32(x))) for x in v))
    flat = [(i, v) for i, vs in good.items() for v in vs]
    out = set()
    for q, w in flat:
        if q % every == 0:
            best = {(-sum(a * b for a, b in zip(v, w)), i) for i, v in flat if i != q and len(v) == len(w)}
            out |= {(q, r + 1, i, -s) for r, (s, i) in enumerate(sorted(best)[:k])}
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_brute_force(spark, seed, monkeypatch):
    monkeypatch.setattr(topk, "TREE_ROWS", 200)
    r = np.random.default_rng(seed)
    centers = r.normal(size=(6, 8))
    rows = [(i, [float(x) for x in centers[i % 6] + 0.1 * r.normal(size=8)]) for i in range(700)]
    rows += [(1000 + i, rows[0][1]) for i in range(150)] + [(3, rows[3][1]), (3, rows[3][1])]
    rows += [(2001, None), (2002, [None] * 8), (2003, [float("nan")] * 8), (2004, [float("inf")] * 8), (None, rows[1][1]),
             (2007, [1.0, 2.0]), (2010, [0.5, -3.0]), (2013, []), (2016, [0.0] * 8), (2019, [1.0] * 5)]
    df = spark.createDataFrame([(*x, 1) for x in rows], "vec_id long, embedding array<float>, rank int").repartition(3)
    got = [tuple(x) for x in topk.top(df, F.col("vec_id") % 3 == 0, k=5).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(rows, 5)
    # Several rounds of queries give the same.
    monkeypatch.setattr(topk, "ROUND_BYTES", 4096)
    assert {tuple(x) for x in topk.top(df, F.col("vec_id") % 3 == 0, k=5).collect()} == set(got)


def test_few_rows_large_numbers_and_empty_table(spark):
    rows = [(0, [1e30, 1.0]), (1, [1e30, -1.0]), (2, [-1e30, 0.0])]
    df = spark.createDataFrame(rows, "vec_id int, embedding array<double>")
    got = sorted(map(tuple, topk.top(df, F.col("vec_id") == 0).collect()))
    assert [x[:3] for x in got] == [(0, 1, 1), (0, 2, 2)] and got[0][3] == 2**63 - 1
    assert topk.top(df.limit(0), F.col("vec_id") == 0).count() == 0
    assert topk.top(df.where("vec_id = 0"), F.col("vec_id") == 0).count() == 0


def test_tree_covers_its_points_and_prunes():
    r = np.random.default_rng(0)
    points = np.floor(1024 * (r.integers(0, 8, (2000, 1)) + 0.01 * r.normal(size=(2000, 16))))
    tree = topk.CoverTree(points)
    assert sorted(tree.order) == list(range(2000))
    for c, radius, (a, b), below in zip(tree.center, tree.radius, tree.span, tree.children):
        own = points[tree.order[a:b]]
        assert np.sqrt(((own - c) ** 2).sum(axis=1)).max() <= radius + 1e-6
        assert not below or sorted(tree.span[n] for n in below)[0][0] == a and sum(
            tree.span[n][1] - tree.span[n][0] for n in below) == b - a
    seen = []
    real, topk.products = topk.products, lambda a, b: seen.append(len(a) * len(b)) or real(a, b)
    try:
        queries_ = topk.CoverTree(points[:64])
        topk.search(queries_, np.arange(64), tree, [np.array([i]) for i in range(2000)], topk.Best(64, 10))
    finally:
        topk.products = real
    assert sum(seen) < 0.6 * 64 * 2000


def test_query_equals_sql(spark, sf):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{sf}/embeddings.parquet'")
    theirs = con.execute(topk.SQL).df()
    ours = queries.op3_topk(spark, sf).toPandas()
    key = ["query_id", "rank"]
    pd.testing.assert_frame_equal(
        ours.sort_values(key, ignore_index=True), theirs[ours.columns].sort_values(key, ignore_index=True), check_dtype=False)


def test_query_equals_sql_with_repeated_rows_and_odd_vectors(spark, folder):
    rows = [(i % 120 * 5, [float(i % 7), float(i % 3) - 1]) for i in range(300)] + [(None, [1.0, 2.0]), (7, None), (100, [1.0])]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").coalesce(1).write.parquet(f"{folder}/embeddings.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{folder}/embeddings.parquet/*.parquet'")
    theirs = sorted(con.execute(topk.SQL).fetchall())
    assert sorted(map(tuple, queries.op3_topk(spark, folder).collect())) == theirs
