import base64
import hashlib

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from themeloom.llm import queries, warc
from themeloom.session import scratch_path

ROWS = [
    (1, "http://a/b c", "<p>é</p>\r\n\r\nWARC/1.1\nfiledesc://x 1 2 3 4"), (2, None, None), (3, "", ""),
    (4, "http://a/%41", "same"), (5, "http://a/ü", "same"), (5, "http://a/ü", "same"), (6, "http://b", "x" * 300_000),
    (7, "http://c", "\n\n\n"), (8, "http://d", "x" * 300_000),
]


@pytest.mark.parametrize("version", [1, 2])
def test_archives_round_trip(spark, version):
    df = spark.createDataFrame([(*r, "c") for r in ROWS], "id long, url string, html string, payload string")
    arc, out = scratch_path(spark, "arc"), scratch_path(spark, "warc")
    warc.write_arc(df, arc, version, F.concat_ws("#", "url", "id"), F.col("html"), F.lit("20240203040506"), archive_bytes=400)
    warc.convert(spark, arc, out, archive_bytes=1000)
    rows = warc.read_warc(spark, out).collect()
    assert len(rows) == len(ROWS) and len({r["record_id"] for r in rows}) == len(ROWS)
    by_id = {r["record_id"]: r for r in rows}
    want = sorted((f"{u}#{i}" if u is not None else str(i), (h or "").encode()) for i, u, h in ROWS)
    got = []
    for r in rows:
        source = by_id[r["refers_to_id"]] if r["record_type"] == "revisit" else r
        assert source["record_type"] == "response" and r["refers_to_uri"] in (None, source["uri"])
        assert r["payload_digest"] == source["payload_digest"]
        assert base64.b32encode(hashlib.sha1(bytes(source["payload"])).digest()).decode() == r["payload_digest"]
        assert r["date"] == "2024-02-03T04:05:06Z" and r["payload_bytes"] == len(source["payload"])
        got.append((r["uri"], bytes(source["payload"])))
    assert sorted(got) == want
    assert sum(r["record_type"] == "revisit" for r in rows) == 2 + 1 + 1
    # Only large payloads count if the limit says so.
    other = scratch_path(spark, "warc")
    warc.convert(spark, arc, other, min_bytes=5)
    assert warc.read_warc(spark, other, False).where("record_type = 'revisit'").count() == 1


def test_empty_table(spark):
    df = spark.createDataFrame([], "id long, html string")
    arc, out = scratch_path(spark, "arc"), scratch_path(spark, "warc")
    warc.write_arc(df, arc, 1, F.col("id"), F.col("html"))
    warc.convert(spark, arc, out)
    assert warc.read_warc(spark, out).count() == 0


def test_bad_archives_are_refused():
    head = b"filedesc://x 0.0.0.0 20000101000000 text/plain 76\n1 0 x\n" + warc.FIELDS[1].encode() + b"\n"
    head = head.replace(b" 76\n", f" {len(head.split(chr(10).encode(), 1)[1])}\n".encode())
    good = head + b"\nhttp://a 1.2.3.4 20000101000000 text/html 3\nabc\n"
    assert [(f["IP-address"], b) for _, f, b in warc.arc_records(good)] == [("1.2.3.4", b"abc")]
    for bad in (head + b"\nhttp://a 1.2.3.4 20000101000000 text/html 30\nabc\n", head + b"\nhttp://a text/html 3\nabc\n"):
        with pytest.raises(ValueError):
            list(warc.arc_records(bad))


def test_query_equals_sql(spark, sf):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{sf}/pages.parquet'")
    theirs = con.execute(warc.SQL).df()
    ours = queries.op2_warc(spark, sf).toPandas()[list(theirs.columns)]
    pd.testing.assert_frame_equal(
        ours.sort_values("page_id", ignore_index=True), theirs.sort_values("page_id", ignore_index=True), check_dtype=False)


def test_query_equals_sql_with_repeated_rows_and_no_ids(spark, folder):
    import duckdb

    rows = [(1, "u", "same"), (1, "u", "same"), (2, "u", "same"), (None, "u", "same"), (None, "v", "lone"), (None, "v", "lone"),
            (3, "u", None), (4, None, ""), (5, "u", "own")]
    spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1).write.parquet(f"{folder}/pages.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{folder}/pages.parquet/*.parquet'")
    names = "page_id, payload_bytes, payload_digest, record_type, refers_to"
    theirs = con.execute(f"SELECT {names} FROM ({warc.SQL})").fetchall()
    got = [tuple(r) for r in queries.op2_warc(spark, folder).selectExpr(*names.split(", ")).collect()]
    assert sorted(got, key=repr) == sorted(map(tuple, theirs), key=repr)
