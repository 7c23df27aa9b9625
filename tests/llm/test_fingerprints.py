import hashlib

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from themeloom.llm import fingerprints, queries


@pytest.mark.parametrize("rows", [300, 3000])
def test_next_of_every_row(spark, monkeypatch, rows):
    monkeypatch.setattr(fingerprints, "BUCKET_ROWS", 3)
    ids = [i * i % 10_007 * 3 for i in range(rows)] + [None, None, 5, 5, 10**15, -(10**15)]
    table = [(i, f"t{k}", "x") for k, i in enumerate(ids)]
    df = spark.createDataFrame(table, "id long, text string, _x string")
    tie = {r[0]: r[1] for r in df.select("text", F.xxhash64("text")).collect()}
    order = sorted(table, key=lambda r: (r[0] is not None, r[0] or 0, tie[r[1]]) if r[0] is not None else (False, tie[r[1]] % 1, 0))
    known = [r for r in order if r[0] is not None]
    got = {r["text"]: r["next"] for r in fingerprints.with_next(df, "id", "text", "next").collect()}
    assert len(got) == len(table)
    for a, b in zip(known, known[1:]):
        assert got[a[1]] == b[1]
    # Rows without id come first, in some order, and close the ring.
    seen, at = [], known[-1][1]
    for _ in table:
        at = got[at]
        seen.append(at)
    assert sorted(seen) == sorted(t for _, t, _ in table) and seen[-1] == known[-1][1]


def test_roots_and_likeness(spark):
    a = "one two three four\nfive six\n\nseven eight nine ten"
    rows = [(1, a, a), (2, a, a.replace("six", "sex")), (3, a, ""), (4, "", ""), (5, "\n", "\n\n"), (6, a, a.replace("\n\n", "\n")),
            (7, "x" * 100_000, "x" * 100_001), (8, "a b " * 30_000, "a b " * 30_000 + "c")]
    df = spark.createDataFrame([(*r, "c") for r in rows], "id long, a string, b string, pieces string")
    trees = fingerprints.with_tree(fingerprints.with_tree(df, "a", "x"), "b", "y")
    got = {r["id"]: r for r in trees.select("id", F.col("x.root").alias("p"), F.col("y.root").alias("q"),
                                            fingerprints.likeness("x", "y").alias("near")).collect()}
    for i, p, q in rows:
        assert (got[i]["p"] == got[i]["q"]) == (p == q)
        assert 0 <= got[i]["near"] <= 1 and (got[i]["near"] == 1 or p != q)
    assert got[1]["near"] == 1 and got[2]["near"] == 4 / 5 and got[3]["near"] == 0 and got[4]["near"] == 1
    assert got[5]["near"] == 0 and got[6]["near"] == 1.0


def test_edits_are_located(spark):
    df = spark.createDataFrame(
        [(1, "a\nb\n\nc\nd", "a\nB\n\nc\nd"), (2, "same", "same"), (3, None, "new"), (None, "p\nq", "p")],
        "id long, old string, new string")
    got = {tuple(r) for r in fingerprints.locate_edits(df, "id", "old", "new").collect()}
    assert got == {(1, "before", 0, 1, "b"), (1, "after", 0, 1, "B"), (3, "before", 0, 0, ""), (3, "after", 0, 0, "new"),
                   (None, "before", 0, 1, "q")}


def test_odd_tables(spark):
    df = spark.createDataFrame([(7, None, 1)], "doc_id int, text string, next int")
    row = fingerprints.edited_by_next(df).collect()[0]
    assert row["edited"] == "" and row["text"] == "" and row["next"] == ""
    assert fingerprints.edited_by_next(df.limit(0)).count() == 0


def test_query_equals_sql_and_plain_python(spark, sf):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    theirs = con.execute(fingerprints.SQL).df()
    frame = queries.op4_fingerprints(spark, sf)
    assert "Python" not in frame._jdf.queryExecution().toString()
    ours = frame.toPandas()
    pd.testing.assert_frame_equal(
        ours.sort_values("doc_id", ignore_index=True), theirs[ours.columns].sort_values("doc_id", ignore_index=True),
        check_dtype=False)
    docs = sorted((r["doc_id"], r["text"] or "") for r in spark.read.parquet(f"{sf}/documents.parquet").collect())
    for k, (i, text) in enumerate(docs):
        n = len(text) // 4
        edited = text[:len(text) - n] + docs[(k + 1) % len(docs)][1][:n]
        row = ours[ours["doc_id"] == i].iloc[0]
        assert row["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest() and row["n_chars"] == len(text)
    assert ours["near_edited"].mean() > 0.6 and ours["near_next"].mean() < 0.2
