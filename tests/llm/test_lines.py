import duckdb
import pandas as pd

from themeloom.llm import lines, queries


def run(spark, rows, **how):
    df = spark.createDataFrame([(*r, 1, "c") for r in rows], "doc_id long, text string, row int, content string")
    return sorted(((r["doc_id"], r["n_lines"], r["n_dropped"], r["kept"])
                   for r in lines.dedup(df, **how).collect()), key=repr)


def test_templates_recur_and_clean_lines_stay(spark):
    rows = [(i, f"own line number {i}x of text {'abcdefghij'[i]}\nUser id{i} logged in from host{i % 3} at {i}:00\n"
                f"All rights reserved.\n\nlast {'abcdefghij'[i]}") for i in range(10)]
    got = run(spark, rows)
    assert got[0] == (0, 5, 0, rows[0][1])
    for (i, n, dropped, kept), row in zip(got[1:], rows[1:]):
        want = row[1].split("\n")
        assert (i, n) == (row[0], 5)
        assert "All rights" not in kept and kept.split("\n")[-1] == want[-1]
        assert "logged in" not in kept
        assert "" in kept.split("\n")


def test_odd_texts(spark):
    line = "the same words here"
    rows = [(1, line), (2, line + "\n"), (3, "\n" + line), (4, f"a\n{line}"), (5, f"{line}\n\nb\n"), (6, None), (7, ""),
            (8, "1 2 3\n1 2 3"), (9, "4 5 6"), (10, "7 8 9"), (None, line), (4, f"a\n{line}"), (11, "w " * 50_000),
            (12, f"{line}\n{line}")]
    assert run(spark, rows) == sorted([
        (1, 1, 0, line), (2, 2, 1, ""), (3, 2, 1, ""), (4, 2, 1, "a"), (5, 4, 1, "\nb\n"), (6, 0, 0, None),
        (7, 1, 0, ""), (8, 2, 0, "1 2 3\n1 2 3"), (9, 1, 0, "4 5 6"), (10, 1, 0, "7 8 9"), (None, 1, 1, ""),
        (4, 2, 1, "a"), (11, 1, 0, "w " * 50_000), (12, 2, 2, ""),
    ], key=repr)
    # Two documents are too few, however often each has the line.
    assert run(spark, [(1, line), (2, f"{line}\n{line}"), (2, f"{line}\n{line}")])[1][2] == 0
    assert run(spark, []) == []


def test_identical_lines_of_many_fields_recur_in_the_pipeline(spark):
    rows = [(i, f"Page 3 of 10\nown {'abcdef'[i]}\nUpdated 2024-05-01\n{i} {i} {i}\nCopyright  2024 v{i // 2}") for i in range(6)]
    rows += [(6, "Copyright 2024"), (7, "x\nCopyright 2024\nPage 3 of 11"), (8, "\tCopyright 2024 "), (9, None)]
    rows += [(7, "x\nCopyright 2024\nPage 3 of 11")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, row int")
    got = sorted(((r["doc_id"], r["text"]) for r in lines.without_recurring(df).collect()), key=repr)
    want = [rows[0]] + [(i, f"own {'abcdef'[i]}\n{i} {i} {i}\nCopyright  2024 v{i // 2}") for i in range(1, 6)]
    # Three documents have the line of 2024 alone, two those of one version: these stay.
    assert got == sorted([*want, (6, "Copyright 2024"), *[(7, "x\nPage 3 of 11")] * 2, (8, ""), (9, None)], key=repr)


def test_query_equals_sql(spark, sf):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    theirs = con.execute(lines.SQL).df()
    ours = queries.op7_lines(spark, sf).toPandas()
    key = list(theirs.columns)
    pd.testing.assert_frame_equal(
        ours[key].sort_values("doc_id", ignore_index=True), theirs.sort_values("doc_id", ignore_index=True))
    assert ours["n_dropped"].sum() > 0


def test_query_equals_sql_with_repeated_ids(spark, folder):
    line = "all rights of this page are reserved"
    rows = [(1, f"{line}\nPage 3 of 10"), (1, f"{line}\nother"), (1, f"{line}\nother"), (2, f"x\n{line}\nPage 3 of 10"), (None, line),
            (None, f"{line}\nPage 3 of 10"), (3, None), (4, ""), (5, "Page 4 of 10"), (6, "w " * 1024)]
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(f"{folder}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet/*.parquet'")
    theirs = [tuple(r) for r in con.execute(f"SELECT doc_id, n_lines, n_dropped, kept_sha256 FROM ({lines.SQL})").fetchall()]
    got = [tuple(r) for r in queries.op7_lines(spark, folder).select("doc_id", "n_lines", "n_dropped", "kept_sha256").collect()]
    assert sorted(got, key=repr) == sorted(theirs, key=repr) and sum(r[2] for r in got) == 5


def test_one_scan_gives_the_lines_of_every_use(spark):
    # The texts are read once for the seen lines and the lines with fields; a repeated row is one.
    docs = spark.createDataFrame([(1, 10, "a b\nid 7 x\na b"), (1, 10, "a b\nid 7 x\na b"), (2, 20, None),
                                  (None, 30, "")], "doc long, row long, text string")
    got = lines.scan(docs).collect()
    assert sorted(r.kind for r in got) == [lines.SEEN] * 2 + [lines.FIELDS]
    seen = [r for r in got if r.kind == lines.SEEN]
    assert {(r.doc, r.row) for r in seen} == {(1, 10)} and sorted(r.once for r in seen) == [1, 1]
    (field,) = [r for r in got if r.kind == lines.FIELDS]
    assert (field.doc, field.row, field.leaf, field.once) == (1, 10, None, None)
