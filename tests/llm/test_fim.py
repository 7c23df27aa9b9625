import hashlib
import re

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from themeloom.llm import fim, queries


def brute(key, text):
    text = text or ""
    units = re.findall("[A-Za-z]+|[^A-Za-z]", text)
    digest = hashlib.sha256(f"1:{'' if key is None else key}".encode()).hexdigest()
    h = [int(digest[8 * i:8 * i + 8], 16) for i in range(4)]
    n = len(units)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    pre, mid, suf = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(m in text for m in fim.MARKERS) or h[2] % 100 >= 90:
        return key, text, n, "plain", None, None, text
    if h[3] % 100 < 20:
        return key, text, n, "spm", len(pre), len(mid), f"<S>{suf}<P>{pre}<M>{mid}"
    return key, text, n, "psm", len(pre), len(mid), f"<P>{pre}<S>{suf}<M>{mid}"


def random_texts():
    r = np.random.default_rng(5)
    letters = list("abzAZ <>PSM\n\t09é日😀ñ̀\0")
    return ["".join(r.choice(letters, int(r.integers(0, 60)))) for _ in range(300)]


@pytest.mark.parametrize("rows_per_batch", ["7", "10000"])
def test_equals_brute_force_and_restores(spark, rows_per_batch):
    texts = random_texts() + [
        None, "", " ", "x", "<P>", "a<P>b", "<S", "S><M", "<", "日" * 70_000 + "abc", "ab " * 60_000, "word" * 50_000,
        "é" * 40_000 + "x 1" * 20_000, "<M", ">P<S", "same", "same"]
    rows = list(enumerate(texts)) + [(None, "no id at all"), (None, None), (3, texts[3]), (-7, "below zero, too")]
    df = spark.createDataFrame([(*x, 1, "o") for x in rows], "doc_id long, text string, n int, output string").repartition(3)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows_per_batch)
    try:
        out = fim.transform(df).withColumn("back", fim.restore(F.col("output"), F.col("form")))
        got = [tuple(x) for x in out.collect()]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sorted((x[:-1] for x in got), key=repr) == sorted((brute(*x) for x in rows), key=repr)
    assert all(x[-1] == x[1] for x in got)
    assert {x[3] for x in got} == {"plain", "psm", "spm"}


def test_names_parameters_and_empty_table(spark):
    df = spark.createDataFrame([("a", "one two")], "k string, body string")
    got = fim.transform(df, "k", "body", transformed=100, suffix_first=100, markers=("[p]", "[s]", "[m]")).first()
    assert got.form == "spm" and got.output.startswith("[s]") and got.k == "a"
    assert fim.transform(df.limit(0), "k", "body").count() == 0


def test_sets_select_every_rank():
    r = np.random.default_rng(1)
    for values in (
        np.arange(200_000), np.sort(r.choice(300_000, 150_000, replace=False)), np.array([0]), np.array([65_535, 65_536]),
        np.concatenate([np.arange(10_000), np.arange(70_000, 70_010), np.sort(r.choice(65_536, 30_000, False)) + 200_000]),
        np.sort(r.choice(1 << 22, 500, replace=False)), np.zeros(0, np.int64),
    ):
        held = fim.BoundarySet(values.astype(np.int64))
        order = r.permutation(len(values))
        assert len(held) == len(values) and (held.select(order) == values[order]).all()
    forms = [type(fim.container(v)).__name__ for v in (
        np.arange(1000), np.arange(0, 2000, 2), np.sort(r.choice(65_536, 30_000, False)))]
    assert forms == ["RunContainer", "ArrayContainer", "BitmapContainer"]


def test_query_equals_sql(spark, sf):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    theirs, ours = con.execute(fim.SQL).df(), queries.op11_fim(spark, sf).toPandas()
    pd.testing.assert_frame_equal(
        ours.sort_values("doc_id", ignore_index=True), theirs[ours.columns].sort_values("doc_id", ignore_index=True),
        check_dtype=False)
