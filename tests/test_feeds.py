"""Feed rules against sequential models of the same rules, and the stores around them."""

import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from themeloom.operators import feeds
from themeloom.operators.scale import running_max
from themeloom.sources import feeds as landed
from themeloom.sources import tables
from themeloom.sources.files import write_files
from themeloom.streaming.feeds import compact, read_state, stream_feed

NOTE = "industry_id string, title string, keyword string, content string, create_time string, " \
       "update_time string, browsers_count bigint"
EVENT = "article_id string, date string, title string, content string, grade bigint, " \
        "themes array<string>, create_time string"


def notes(spark, rows, seq=True):
    """Rows of (key, version, title)."""
    data = [
        ((i,) if seq else ()) + (k, t, "", "", "", v, 0) for i, (k, v, t) in enumerate(rows)
    ]
    return spark.createDataFrame(data, ("seq bigint, " if seq else "") + NOTE)


def apply_notes(stored, batch):
    """The rule, one row after the other."""
    have = {k: (v, t) for k, v, t in stored}
    added = updated = 0
    for k, v, t in batch:
        if k not in have:
            have[k] = (v, t)
            added += 1
        elif v > have[k][0]:
            have[k] = (v, t)
            updated += 1
    return have, added, updated


ROW = st.tuples(st.sampled_from(["", "a", "b", "c"]), st.sampled_from(["", "1", "2", "3"]), st.sampled_from("xyz"))


@settings(max_examples=12, deadline=None)
@given(stored=st.dictionaries(st.sampled_from(["", "a", "b"]), st.tuples(st.sampled_from(["", "1", "2"]), st.just("old"))),
       batch=st.lists(ROW, min_size=1, max_size=12))
def test_newer_wins(spark, stored, batch):
    old = [(k, v, t) for k, (v, t) in stored.items()]
    have, added, updated = apply_notes(old, batch)
    existing, fresh = notes(spark, old, seq=False), notes(spark, batch)
    merged = feeds.upsert_newer(existing, fresh).collect()
    assert {r.industry_id: (r.update_time, r.title) for r in merged} == have
    assert len(merged) == len(have)
    report = feeds.change_report(existing, fresh, "industry").first()
    assert (report.added, report.updated, report.total) == (added, updated, len(have))
    assert report.blank_keys == sum(k == "" for k, _, _ in batch)


@settings(max_examples=8, deadline=None)
@given(batch=st.lists(st.tuples(st.sampled_from(["", "a", "b", "c"]), st.sampled_from("xyz")), min_size=1, max_size=10))
def test_first_stays(spark, batch):
    existing = spark.createDataFrame([("a", "d", "old", "", None, [], "")], EVENT)
    fresh = spark.createDataFrame(
        [(i, k, "d", t, "", None, [], "") for i, (k, t) in enumerate(batch)], "seq bigint, " + EVENT
    )
    have = {"a": "old"}
    for k, t in batch:
        have.setdefault(k, t)
    merged = feeds.insert_absent(existing, fresh).collect()
    assert {r.article_id: r.title for r in merged} == have
    report = feeds.change_report(existing, fresh, "timeline").first()
    assert (report.added, report.updated, report.total) == (len(have) - 1, 0, len(have))


def test_stored_feed_loads_last_of_repeats(spark):
    rows = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("b", 3, "z")], "industry_id string, pos int, t string")
    assert sorted(r.t for r in feeds.load_rule(rows, "industry", "pos").collect()) == ["y", "z"]


def test_ranges_of_a_running_maximum_are_even(spark):
    """A third of the rows in one burst of close numbers, and a third under one key elsewhere."""
    rows = spark.range(30_000).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 500)).alias("k"),
        F.when(F.col("id") % 3 == 1, (F.lit(7) * feeds.PAGE_STRIDE) + F.col("id")).otherwise(F.col("id") * feeds.PAGE_STRIDE).alias("seq"),
        (F.col("id") * 7919 % 10007).cast("string").alias("v"))
    got = running_max(rows, "k", "seq", "v", "before").toPandas().sort_values(["k", "seq"])
    want = got.groupby("k")["v"].transform(lambda v: v.cummax().shift() if len(v) else v)
    same = (got["before"] == want) | (got["before"].isna() & want.isna())
    assert same.all() and len(got) == 30_000


def test_running_max_of_a_dominant_key(spark):
    n = 20_000
    rows = spark.range(n).select(
        F.when(F.col("id") % 3 == 0, F.col("id") % 50).otherwise(-1).cast("string").alias("k"),
        F.col("id").alias("seq"),
        F.lpad(F.pmod(F.xxhash64("id"), F.lit(100000)).cast("string"), 6, "0").alias("v"),
    )
    # Order numbers are sparse and large, as those of pages are.
    rows = rows.withColumn("seq", F.col("seq") * (1 << 40))
    got = running_max(rows, "k", "seq", "v", "before").orderBy("seq").collect()
    best, seen = {}, 0
    for r in got:
        assert r.before == best.get(r.k)
        best[r.k] = max(best.get(r.k, ""), r.v)
        seen += 1
    assert seen == n


def test_reduction_before_the_shuffle(spark):
    """A dominant key is cut down to one row per task before it moves."""
    plan = feeds.reduce_batch(notes(spark, [("", "1", "x")] * 3), "industry")
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert text.count("WindowGroupLimit") == 2


def envelopes(spark, *rows):
    return spark.createDataFrame(list(rows), "name string, value string")


def test_movers_flatten(spark):
    info = {"time": None, "num": "2", "day": 3, "edition": 1, "shares_range": 1.5, "reason": "r", "expound": "", "is_crawl": 0}
    body = {"errCode": "0", "data": [
        "note", 5, None,
        {"name": "empty", "count": 0, "list": []},
        {"name": "counted", "count": 3, "list": []},
        {"reason": "why", "count": 2, "list": [
            {"code": "000001", "name": "A", "article": {"action_info": info}}, {"name": "no article"},
        ]},
    ]}
    raw = landed.usable(landed.judge(envelopes(spark, ("2024-01-05", json.dumps(body))), "action"), "action")
    rows = feeds.flatten_actions(raw).orderBy("field_pos", "stock_pos").collect()
    assert [(r.field_name, r.field_reason, r.code, r.name) for r in rows] == [
        ("counted", "", None, None), ("", "why", "000001", "A"), ("", "why", "", "no article"),
    ]
    assert rows[1].time == "" and rows[1].num == "2" and rows[1].day == "3" and rows[1].shares_range == "1.5"
    assert rows[2].day is None and rows[2].reason == ""
    summary = feeds.action_day_summary(feeds.flatten_actions(raw)).first()
    assert (summary.n_fields, summary.n_stocks, summary.names) == (2, 2, "counted")


def test_bad_envelopes_are_told_apart(spark):
    judged = landed.judge(envelopes(
        spark, ("2024-01-01", '{"data":null}'), ("2024-01-02", '{"errCode":"0","data":[]}'),
        ("2024-01-03", "oops"), ("2024-01-04", '{"data":[{"count":1}]}'), ("x", '{"data":[{"count":1}]}'),
    ), "action")
    assert {r.name: r.reason for r in judged.collect()} == {
        "2024-01-01": "unreadable", "2024-01-02": "no data", "2024-01-03": "unreadable",
        "2024-01-04": None, "x": "no date",
    }


def test_notes_need_a_page(spark):
    body = '{"errCode":"0","data":{"hasNext":false,"result":[]}}'
    rows = landed.judge(envelopes(spark, ("1", body), ("first", body), ("2", '{"errCode":7,"data":{}}')), "industry")
    assert {r.name: r.reason for r in rows.collect()} == {"1": None, "first": "no page", "2": "error code"}


def page(number, more, ids, code=0):
    items = [{"industry_id": i, "update_time": "1"} for i in ids]
    return str(number), json.dumps({"errCode": code, "data": {"hasNext": more, "result": items}})


@pytest.mark.parametrize("pages, expected", [
    ([page(1, True, "ab"), page(2, False, "c")], "abc"),
    ([page(1, True, "a"), page(2, True, "b", code=401), page(3, False, "c")], "a"),
    ([page(1, True, "a"), page(2, False, "b"), page(3, False, "c")], "ab"),
    ([page(10, False, "z"), page(9, True, "y")], "yz"),
])
def test_paging_ends(spark, pages, expected):
    raw = landed.usable(landed.judge(envelopes(spark, *pages), "industry"), "industry")
    rows = feeds.flatten_industry(raw).orderBy("seq").collect()
    assert "".join(r.industry_id for r in rows) == expected
    assert all(r.title == "" and r.browsers_count == 0 for r in rows)


def test_timeline_flatten(spark):
    body = {"errCode": "0", "data": [
        {"list": [{"article_id": "1", "timeline": {"date": "2024-01-01", "theme_list": [{"name": "x"}, {"name": ""}, {}]}}]},
        {"list": None}, {},
        {"list": [{"title": "bare"}]},
    ]}
    raw = landed.usable(landed.judge(envelopes(spark, ("1", json.dumps(body))), "timeline"), "timeline")
    rows = feeds.flatten_timeline(raw).orderBy("seq").collect()
    assert [(r.article_id, r.date, r.themes, r.title) for r in rows] == [
        ("1", "2024-01-01", ["x"], ""), ("", "", [], "bare"),
    ]
    span = feeds.timeline_span(feeds.flatten_timeline(raw)).first()
    assert (span.n_events, span.first_date, span.last_date) == (2, "2024-01-01", "2024-01-01")


def test_snapshot_needs_its_totals(spark, folder):
    tables.write_snapshot(notes(spark, [("a", "1", "x")], seq=False), folder)
    # A version whose totals are missing was not finished, and is passed over.
    notes(spark, [("b", "1", "x")], seq=False).write.parquet(f"{folder}/v=000000002/items")
    assert [r.industry_id for r in tables.read_snapshot(spark, folder).collect()] == ["a"]
    tables.write_snapshot(notes(spark, [("c", "1", "x")], seq=False), folder)
    assert [r.industry_id for r in tables.read_snapshot(spark, folder).collect()] == ["c"]
    assert tables.snapshot_meta(spark, folder).first().total == 1


def test_dated_table(spark, folder):
    def day(d, v):
        return spark.createDataFrame([(d, v)], "date string, v int").withColumn("date", F.col("date").cast("date"))

    def stored():
        return {str(r.date): r.v for r in spark.read.parquet(folder).collect()}

    assert tables.read_by_date(spark, folder, day("2024-01-01", 1).schema).count() == 0
    tables.write_by_date(day("2024-01-01", 1), folder)
    tables.write_by_date(day("2024-01-01", 2).union(day("2024-01-02", 2)), folder)
    assert stored() == {"2024-01-01": 1, "2024-01-02": 2}
    tables.write_by_date(day("2024-01-02", 3), folder, force=True)
    assert stored() == {"2024-01-01": 1, "2024-01-02": 3}


def test_stream_equals_batch_and_can_be_repeated(spark, folder):
    def land(name, ids):
        write_files(envelopes(spark, page(name, True, ids)).select(
            F.concat("name", F.lit(".json")).alias("name"), F.col("value").alias("content")
        ), f"{folder}/landing")

    land(1, "ab")
    stream_feed(spark, f"{folder}/landing", folder, "industry", files_per_batch=1)
    first = {r.industry_id for r in compact(spark, folder, "industry").collect()}
    assert first == {"a", "b"}
    land(2, "bc")
    land(3, "d")
    stream_feed(spark, f"{folder}/landing", folder, "industry", files_per_batch=1)
    before = sorted(r.industry_id for r in read_state(spark, folder, "industry").collect())
    after = sorted(r.industry_id for r in compact(spark, folder, "industry").collect())
    assert before == after == list("abcd")
    assert compact(spark, folder, "industry").count() == 4


def test_daily_runs_add_up(spark, folder):
    """Deltas and compaction give what applying all batches in turn would give."""
    from themeloom.plans.jobs import refresh_feed
    from themeloom.sources import state

    days = [
        [("a", "1", "x"), ("b", "2", "x")], [("a", "1", "tie"), ("c", "1", "y")],
        [("a", "3", "z"), ("b", "1", "old")], [("c", "2", "w"), ("", "1", "v"), ("", "2", "u")],
    ]
    have: dict = {}
    for rows in days:
        want, added, updated = apply_notes([(k, v, t) for k, (v, t) in have.items()], rows)
        report = refresh_feed(notes(spark, rows), folder, "industry", compact_after=1).first()
        assert (report.added, report.updated, report.total) == (added, updated, len(want))
        now = state.read_state(spark, folder, "industry").collect()
        assert {r.industry_id: (r.update_time, r.title) for r in now} == want
        have = want
    assert len(state.pending(spark, folder)) <= 1
    assert tables.snapshot_meta(spark, folder).first().total >= 3
    assert refresh_feed(notes(spark, days[0]).where("false"), folder, "industry") is None


def test_streamed_parts_of_a_date_stay_apart(spark, folder):
    def land(name, *names):
        body = {"data": [{"name": n, "count": 1} for n in names]}
        write_files(envelopes(spark, (f"{name}.json", json.dumps(body))).withColumnRenamed("value", "content"), f"{folder}/in")
        stream_feed(spark, f"{folder}/in", folder, "action")

    land("2024-01-05", "a")
    land("2024-01-05_1", "b", "c")
    rows = spark.read.parquet(f"{folder}/action")
    assert sorted((r.part, r.field_name) for r in rows.collect()) == [(0, "a"), (1, "b"), (1, "c")]
    summary = feeds.action_day_summary(rows).first()
    assert (summary.n_fields, summary.names) == (3, "a, b, c")


def test_few_and_many_keys_give_the_same(spark, monkeypatch):
    from themeloom.operators import scale

    def rows(items, seq):
        data = [((i,) if seq else ()) + (k, t, "", "", "", v, 0) for i, (k, v, t) in enumerate(items)]
        return spark.createDataFrame(data, ("seq bigint, " if seq else "") + NOTE)

    old = rows([(None, "1", "old"), ("a", "1", "old"), ("z", "1", "old"), ("z", "2", "again")], seq=False)
    new = rows([(None, "2", "new"), (None, "3", "newer"), ("a", "0", "older"), ("b", "1", "new")], seq=True)

    def outcome():
        merged = sorted((r.industry_id or "", r.update_time, r.title) for r in feeds.upsert_newer(old, new).collect())
        return merged, tuple(feeds.change_report(old, new, "industry").first())

    few = outcome()
    monkeypatch.setattr(scale.checked_broadcast, "__defaults__", (0,))
    assert outcome() == few
    assert few[0] == [("", "3", "newer"), ("a", "1", "old"), ("b", "1", "new"), ("z", "1", "old"), ("z", "2", "again")]
    assert few[1][0] == 1


def test_counts_of_fields_without_stocks(spark):
    entries = ['{"name": "missing"}', '{"name": "zero", "count": 0}', '{"name": "null", "count": null}',
               '{"name": "float", "count": 3.0}', '{"name": "none", "count": 0.0}', '{"name": "whole", "count": 2}']
    raw = spark.createDataFrame([("2024-01-02", 0, entries)], "date string, part int, data array<string>")
    got = [r.field_name for r in feeds.action_fields(raw).orderBy("field_pos").collect()]
    assert got == ["null", "float", "whole"]


def test_unreadable_days_are_failures(spark, folder):
    from themeloom.plans.jobs import job_backfill

    day = json.dumps({"errCode": "0", "data": [{"name": "f", "count": 1, "list": [{"code": "sh600001", "name": "n"}]}]})
    files = {"2024-01-01": day, "2024-01-02": "<html></html>", "2024-01-03": '{"errCode": "401"}',
             "2024-01-04": '{"errCode": "0", "data": []}'}
    write_files(spark.createDataFrame(list(files.items()), "name string, content string").select(
        F.concat("name", F.lit(".json")).alias("name"), "content"), f"{folder}/landing/action")
    got = job_backfill(spark, f"{folder}/landing", f"{folder}/store", "2024-01-01", "2024-01-05").collect()
    assert {str(r.date)[-2:]: r.status for r in got} == {
        "01": "success", "02": "failed", "03": "failed", "04": "success", "05": "failed"}


def test_a_fresh_checkpoint_adds_and_never_hides(spark, folder):
    """After a compaction, batches that count from 0 again still arrive."""
    def land(name, items):
        body = json.dumps({"errCode": "0", "data": {"hasNext": False, "result": items}})
        write_files(spark.createDataFrame([(f"{name}.json", body)], "name string, content string"), f"{folder}/{name}")

    def item(key, at):
        return {"industry_id": key, "title": at, "update_time": at}

    land("1", [item("a", "1")])
    stream_feed(spark, f"{folder}/1", folder, "industry")
    compact(spark, folder, "industry")
    land("2", [item("a", "2"), item("b", "1")])
    for _ in range(2):
        stream_feed(spark, f"{folder}/2", folder, "industry", progress=f"{folder}/other")
    got = {r.industry_id: r.update_time for r in read_state(spark, folder, "industry").collect()}
    assert got == {"a": "2", "b": "1"}
    compact(spark, folder, "industry")
    assert {r.industry_id for r in read_state(spark, folder, "industry").collect()} == {"a", "b"}


def land_pages(spark, folder, *pages):
    rows = envelopes(spark, *pages)
    write_files(rows.select(F.concat("name", F.lit(".json")).alias("name"), F.col("value").alias("content")), folder)


@pytest.mark.parametrize("order, compacted", [("4321", True), ("3142", False)])
def test_stream_ends_a_run_at_a_bad_page_in_any_order(spark, folder, order, compacted):
    """Pages beyond a bad one do not count, also if they were taken in before it."""
    pages = {
        "1": ("r-1", *page(1, True, "ab")[1:]), "2": ("r-2", *page(2, True, "b")[1:]),
        "3": ("r-3", json.dumps({"errCode": 401})), "4": ("r-4", *page(4, False, "bcd")[1:])}
    for n in order:
        land_pages(spark, f"{folder}/in", pages[n])
        stream_feed(spark, f"{folder}/in", folder, "industry")
        if compacted:
            compact(spark, folder, "industry")
    batch = landed.usable(landed.judge(envelopes(spark, *pages.values()), "industry"), "industry")
    want = {r.industry_id for r in feeds.flatten_industry(batch).collect()}
    assert want == {"a", "b"}
    assert {r.industry_id for r in read_state(spark, folder, "industry").collect()} == want


def test_runs_of_pages_are_closed_by_the_next(spark, folder):
    from themeloom.sources import state

    land_pages(spark, f"{folder}/in", ("r1-1", page(1, True, "a")[1]), ("r1-5", page(5, True, "z")[1]))
    stream_feed(spark, f"{folder}/in", folder, "industry")
    compact(spark, folder, "industry")
    # Page 2 might still be bad, so nothing is folded.
    assert len(state.pending(spark, f"{folder}/industry")) == 1
    land_pages(spark, f"{folder}/in", ("r2-1", page(1, False, "b")[1]))
    stream_feed(spark, f"{folder}/in", folder, "industry")
    compact(spark, folder, "industry")
    assert state.pending(spark, f"{folder}/industry") == []
    assert {r.industry_id for r in read_state(spark, folder, "industry").collect()} == {"a", "z", "b"}


def test_a_refresh_reads_the_touched_buckets_only(spark, folder, monkeypatch):
    from themeloom.plans.jobs import refresh_feed
    from themeloom.sources import state

    monkeypatch.setattr(state, "ROWS_PER_BUCKET", 10)
    whole = [(f"k{i}", "1", "x") for i in range(1000)]
    assert refresh_feed(notes(spark, whole), folder, "industry", compact_after=0).first().total == 1000
    stored = tables.read_snapshot(spark, folder)
    keys = spark.createDataFrame([("k7",), ("k8",), ("new",)], "industry_id string")
    touched = tables.read_buckets(spark, folder, keys)
    assert len(touched.inputFiles()) == len(stored.inputFiles()) and touched.count() < 60
    read = touched.select(F.input_file_name()).distinct().count()
    assert read <= 3 and len(stored.inputFiles()) >= 100
    # Nothing but the touched buckets is read; the total is added up.
    monkeypatch.setattr(state, "read_state", None)
    report = refresh_feed(notes(spark, [("k7", "2", "y"), ("k8", "0", "y"), ("new", "1", "y")]), folder, "industry").first()
    assert (report.added, report.updated, report.total) == (1, 1, 1001)
    report = refresh_feed(notes(spark, [("new", "2", "y"), ("newer", "1", "y")]), folder, "industry").first()
    assert (report.added, report.updated, report.total) == (1, 1, 1002)


def test_old_versions_and_folded_deltas_go(spark, folder):
    from themeloom.plans.jobs import refresh_feed
    from themeloom.sources import state
    from themeloom.sources.storage import children

    for i in range(6):
        refresh_feed(notes(spark, [(f"k{i}", "1", "x"), ("same", str(i), "x")]), folder, "industry", compact_after=0)
    assert len([c for c in children(spark, folder) if c.startswith("v=")]) == tables.KEPT_VERSIONS
    assert len(children(spark, f"{folder}/deltas")) <= 1 and len(children(spark, f"{folder}/notes")) <= 1
    now = {r.industry_id: r.update_time for r in state.read_state(spark, folder, "industry").collect()}
    assert len(now) == 7 and now["same"] == "5" and state.total(spark, folder, "industry") == 7


def test_marks_of_a_stream_stay_few(spark, folder):
    from themeloom.sources import state
    from themeloom.sources.storage import children

    for i in range(5):
        body = json.dumps({"errCode": "0", "data": [{"list": [{"article_id": str(i)}]}]})
        land_pages(spark, f"{folder}/in", (str(i + 1), body))
        stream_feed(spark, f"{folder}/in", folder, "timeline")
        compact(spark, folder, "timeline")
    path = f"{folder}/timeline"
    assert len(children(spark, f"{path}/taken")) <= 2 and len(children(spark, f"{path}/folded")) == 1
    run, batch_id = children(spark, f"{path}/folded")[0].rsplit("-", 1)
    # A batch that was folded is not taken again, also after its marks went.
    assert state.number_of(spark, path, run, int(batch_id)) is None and state.number_of(spark, path, run, 0) is None
    assert read_state(spark, folder, "timeline").count() == 5


def test_collections_keep_two_versions(spark, folder):
    from themeloom.sources.storage import children

    for i in range(4):
        rows = spark.createDataFrame([(str(i), [1.0])], "id string, embedding array<double>")
        tables.write_collection(rows, folder)
    assert len(children(spark, folder)) == 2 and tables.read_collection(spark, folder).first().id == "3"
