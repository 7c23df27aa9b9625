import hashlib
import random
import re

import pytest

from themeloom.llm import queries, substrings


def brute(rows, window):
    """Kept words of each (id, text), by a plain dictionary of windows."""
    words = [(i, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in rows]
    first = {}
    for i, ws in words:
        if i is not None:
            for p in range(len(ws) - window + 1):
                key = tuple(ws[p:p + window])
                first[key] = min(first.get(key, i), i)
    out = []
    for i, ws in words:
        gone = [False] * len(ws)
        if i is not None:
            for p in range(len(ws) - window + 1):
                if first[tuple(ws[p:p + window])] < i:
                    gone[p:p + window] = [True] * window
        out.append((i, len(ws), sum(gone), " ".join(w for w, g in zip(ws, gone) if not g)))
    return out


def rows_of(df):
    return sorted(((r[0], r[1], r[2], r[3]) for r in df.collect()), key=repr)


@pytest.mark.parametrize("window", [4, 50])
def test_equals_brute_force(spark, window):
    r = random.Random(window)
    vocab = [f"w{i}" for i in range(40)] + ["é", "日本"]
    base = [" ".join(r.choices(vocab, k=r.randint(0, 5 * window))) for _ in range(12)]
    rows = []
    for i in range(60):
        ws = " ".join(r.choices(base, k=r.randint(1, 3))).split()
        a = r.randint(0, max(0, len(ws) - 1))
        ws = ws[a:] + r.choices(vocab, k=r.randint(0, 3)) + ws[:a]
        rows.append((i * 3 % 61, r.choice([" ", "\n", " \t"]).join(ws)))
    rows += [
        (100, "a " * 300), (101, "a " * 200), (102, "a b " * 150), (103, "b a " * 100), (99, "a " * 260),
        (104, None), (105, ""), (None, base[0] * 3), (106, rows[0][1]), (106, rows[0][1]),
        (106, rows[1][1]), (107, " ".join(r.choices(vocab, k=30_000))), (1, rows[5][1]),
    ]
    df = spark.createDataFrame([(*x, "z", 1) for x in rows], "doc_id long, text string, doc string, key int")
    assert rows_of(substrings.dedup(df, window=window)) == sorted(brute(rows, window), key=repr)


def test_layout_keeps_white_space(spark):
    rows = [(1, "  a b\tc d\n e"), (2, " x\n\na b\tc d y \n"), (3, " q  r ")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["text"] for r in substrings.without_repeats(df, window=4).collect()}
    assert got == {1: rows[0][1], 2: " x\n\ny \n", 3: " q  r "}
    assert substrings.dedup(df.limit(0)).count() == 0


def test_query_equals_brute_force(spark, sf):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    want = {(i, n, g, hashlib.sha256(k.encode()).hexdigest()) for i, n, g, k in brute(docs, 50)}
    assert {tuple(r) for r in queries.op10_substrings(spark, sf).collect()} == want
    assert any(w[2] for w in want)
