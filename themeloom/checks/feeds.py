"""Movers from orders and lineitem; notes and timeline from events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from themeloom.checks.base import Registry, code, code_sql, table
from themeloom.operators import feeds, universe
from themeloom.plans import jobs
from themeloom.session import materialize, scratch_path
from themeloom.sources import feeds as landed
from themeloom.sources import tables
from themeloom.sources.files import write_files
from themeloom.streaming.feeds import compact, read_state, stream_feed

R = Registry()
QUERIES, ORACLE = R.queries, R.oracle

SPLIT = "2024-01-16"


def at():
    return F.lit("2024-01-31 00:00:00").cast("timestamp")


# Responses hold this many orders or events, as a page does, so none grows with the tables.
BLOCK = 2000

# Movers: a date per order year, in parts; two fields per order and a note that is none.


def _stock(key, name, info, detailed):
    article = F.when(F.lit(detailed), F.struct(info.alias("action_info")))
    return F.struct(
        code(key).alias("code"), F.concat(F.lit(name), key).alias("name"), article.alias("article")
    )


def mover_envelopes(spark: SparkSession, sf: str) -> DataFrame:
    """(name, value): responses per order year and block of order keys.

    The first field of an order has two stocks, of which the second lacks its
    details.  The second field has none, and is to be skipped unless it has a
    count.
    """
    info = F.struct(
        F.when(F.col("o_orderstatus") == "O", F.date_format("o_orderdate", "HH:mm")).alias("time"),
        F.lit("").alias("num"),
        F.col("o_totalprice").alias("shares_range"),
        F.col("o_orderpriority").alias("reason"),
    )
    stocks = F.array(
        _stock("o_custkey", "C", info, True), _stock("o_orderkey", "K", info, False)
    )
    field = F.struct(
        F.when(F.col("o_orderstatus") != "P", F.concat(F.lit("O"), "o_orderkey")).alias("name"),
        F.col("o_orderpriority").alias("reason"), F.lit(2).alias("count"), stocks.alias("list"),
    )
    bare = F.struct(
        F.lit("bare").alias("name"), F.when(F.col("o_orderstatus") == "F", 3).otherwise(0).alias("count"),
        F.filter(stocks, lambda _: F.lit(False)).alias("list"),
    )
    texts = F.concat_ws(",", F.to_json(field), F.to_json(bare), F.lit('"note"'))
    return (
        table(spark, sf, "orders")
        .groupBy(F.trunc("o_orderdate", "year").alias("day"), F.floor(F.col("o_orderkey") / BLOCK).alias("part"))
        .agg(F.array_sort(F.collect_list(F.struct("o_orderkey", texts.alias("j")))).alias("f"))
        .select(
            F.concat_ws("_", F.col("day").cast("string"), F.col("part").cast("string")).alias("name"),
            F.concat(F.lit('{"errCode":"0","data":['), F.array_join(F.col("f.j"), ","), F.lit("]}")).alias("value"),
        )
    )


DAY = "CAST(date_trunc('year', o_orderdate) AS DATE)"
ACTIONS = f"""placed AS (
    SELECT *, {DAY} AS date, (o_orderkey // {BLOCK}) * 4294967296 + 3 * (row_number() OVER (
      PARTITION BY {DAY}, o_orderkey // {BLOCK} ORDER BY o_orderkey) - 1) AS place FROM orders),
  actions AS (
    SELECT date, place AS field_pos, CASE WHEN o_orderstatus <> 'P' THEN 'O' || o_orderkey ELSE '' END AS field_name,
      o_orderpriority AS field_reason, 0 AS stock_pos, {code_sql('o_custkey')} AS code, 'C' || o_custkey AS name,
      CASE WHEN o_orderstatus = 'O' THEN strftime(o_orderdate, '%H:%M') ELSE '' END AS time,
      CAST(o_totalprice AS VARCHAR) AS shares_range, o_orderpriority AS reason
    FROM placed
    UNION ALL
    SELECT date, place, CASE WHEN o_orderstatus <> 'P' THEN 'O' || o_orderkey ELSE '' END,
      o_orderpriority, 1, {code_sql('o_orderkey')}, 'K' || o_orderkey, '', NULL, '' FROM placed
    UNION ALL
    SELECT date, place + 1, 'bare', '', NULL, NULL, NULL, NULL, NULL, NULL FROM placed WHERE o_orderstatus = 'F')"""
ACTION_COLUMNS = (
    "date", "field_pos", "field_name", "field_reason", "stock_pos", "code", "name", "time",
    "shares_range", "reason",
)
PICK = ", ".join(ACTION_COLUMNS)


def actions(spark, sf) -> DataFrame:
    judged = landed.judge(mover_envelopes(spark, sf), "action")
    return feeds.flatten_actions(landed.usable(judged, "action"))


def _land(rows: DataFrame, label: str) -> str:
    """Write (name, value) envelopes as JSON files of a fresh folder."""
    root = scratch_path(rows.sparkSession, label)
    write_files(rows.select(F.concat("name", F.lit(".json")).alias("name"), F.col("value").alias("content")), root)
    return root


@R.add("p9_flatten_actions", f"WITH {ACTIONS} SELECT {PICK} FROM actions")
def flatten_actions(spark, sf):
    return actions(spark, sf).select(*ACTION_COLUMNS)


SUMMARY = """summary AS (
  SELECT date, count(DISTINCT field_pos) AS n_fields, count(code) AS n_stocks,
    count(DISTINCT field_pos) FILTER (field_name <> '') AS named FROM actions GROUP BY date),
  top_names AS (
    SELECT date, string_agg(field_name, ', ' ORDER BY field_pos) AS names FROM (
      SELECT DISTINCT date, field_pos, field_name FROM actions WHERE field_name <> ''
      QUALIFY dense_rank() OVER (PARTITION BY date ORDER BY field_pos) <= 5)
    GROUP BY date)"""
DAY_SUMMARY = """SELECT date, n_fields, n_stocks,
    coalesce(names, '') || CASE WHEN named > 5 THEN '...' ELSE '' END AS names
  FROM summary LEFT JOIN top_names USING (date)"""


@R.add("a4_action_day_summary", f"WITH {ACTIONS}, {SUMMARY} {DAY_SUMMARY}")
def action_day_summary(spark, sf):
    return feeds.action_day_summary(actions(spark, sf))


def _with_bad_files(spark, sf) -> DataFrame:
    """The responses, with an empty, a null and a broken one per nation beside them."""
    bad = table(spark, sf, "nation").select(
        F.concat(F.lit("bad-"), "n_nationkey").alias("name"),
        F.when(F.col("n_regionkey") == 0, '{"errCode":"0","data":[]}')
        .when(F.col("n_regionkey") == 1, '{"errCode":"401","data":null}')
        .otherwise("<html>").alias("value"),
    )
    return mover_envelopes(spark, sf).unionByName(bad)


@R.add("s3_read_feed", f"""
    SELECT CAST({DAY} AS VARCHAR) || '_' || (o_orderkey // {BLOCK}) AS name, 'accepted' AS outcome,
      CAST(3 * count(*) AS INTEGER) AS entries FROM orders GROUP BY {DAY}, o_orderkey // {BLOCK}
    UNION ALL
    SELECT 'bad-' || n_nationkey, CASE WHEN n_regionkey <= 1 THEN 'no data' ELSE 'unreadable' END, NULL
    FROM nation""")
def read_feed(spark, sf):
    good, bad = landed.read_feed(spark, _land(_with_bad_files(spark, sf), "action"), "action")
    return good.select(
        F.concat_ws("_", F.col("date").cast("string"), F.col("part").cast("string")).alias("name"),
        F.lit("accepted").alias("outcome"),
        F.size("data").alias("entries"),
    ).unionByName(bad.select("name", F.col("reason").alias("outcome"), F.lit(None).cast("int").alias("entries")))


@R.add("s5_write_by_date", f"""WITH {ACTIONS}
    SELECT {PICK.replace('field_reason', "CASE WHEN year(date) = 1996 THEN 'forced' ELSE field_reason END AS field_reason")}
    FROM actions""")
def write_by_date(spark, sf):
    path = scratch_path(spark, "dated")
    rows = actions(spark, sf).select(*ACTION_COLUMNS)
    early = rows.where(F.year("date") <= 1996)
    tables.write_by_date(early, path)
    # Dates already there are skipped, so this changes nothing before 1997.
    later = rows.withColumn("field_reason", F.when(F.year("date") <= 1996, "skipped").otherwise(F.col("field_reason")))
    tables.write_by_date(later, path)
    forced = early.where(F.year("date") == 1996).withColumn("field_reason", F.lit("forced"))
    tables.write_by_date(forced, path, force=True)
    return tables.read_by_date(spark, path, rows.schema).select(*ACTION_COLUMNS)


@R.add("u2_date_spine", """
    SELECT CAST(unnest(generate_series(min(o_orderdate), max(o_orderdate), INTERVAL 1 DAY)) AS DATE) AS date
    FROM orders""")
def date_spine(spark, sf):
    # Bounds in the wrong order are swapped.
    ends = table(spark, sf, "orders").agg(
        F.max("o_orderdate").cast("string").alias("a"), F.min("o_orderdate").cast("string").alias("b")
    ).first()
    return universe.date_spine(spark, ends.a, ends.b)


@R.add("j7_missing_dates", """
    SELECT DISTINCT CAST(l_shipdate AS DATE) AS date FROM lineitem
    WHERE CAST(l_shipdate AS DATE) NOT IN (SELECT CAST(o_orderdate AS DATE) FROM orders)""")
def missing_dates(spark, sf):
    wanted = table(spark, sf, "lineitem").select(F.to_date("l_shipdate").alias("date")).distinct()
    have = table(spark, sf, "orders").select(F.to_date("o_orderdate").alias("date")).distinct()
    return universe.missing_dates(wanted, have)


# Industry notes: a page per block of events, an item per event.

def _version(c):
    """A version that goes up and down with the events of a user."""
    return F.lpad(F.floor(F.col(c) * 10).cast("string"), 8, "0")


VERSION_SQL = "lpad(CAST(CAST(floor(value * 10) AS BIGINT) AS VARCHAR), 8, '0')"


def note_pages(spark: SparkSession, sf: str) -> DataFrame:
    """(name, value): notes without an id for errors, the last page says so."""
    events = table(spark, sf, "events")
    item = F.struct(
        F.when(F.col("event_type") != "error", F.col("user_id").cast("string")).alias("industry_id"),
        F.col("event_type").alias("title"),
        F.col("props").alias("keyword"),
        F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("create_time"),
        _version("value").alias("update_time"),
        F.col("event_id").alias("browsers_count"),
    )
    pages = events.groupBy(F.floor(F.col("event_id") / BLOCK).alias("page")).agg(
        F.array_sort(F.collect_list(F.struct("event_id", item.alias("item")))).alias("i")
    )
    last = events.agg(F.floor(F.max("event_id") / BLOCK)).scalar()
    return pages.withColumn("last", last).select(
        F.col("page").cast("string").alias("name"),
        F.to_json(F.struct(F.lit(0).alias("errCode"), F.struct(
            (F.col("page") < F.col("last")).alias("hasNext"), F.col("i.item").alias("result")
        ).alias("data"))).alias("value"),
    )


NOTES = f"""notes AS (
  SELECT CASE WHEN event_type <> 'error' THEN CAST(user_id AS VARCHAR) ELSE '' END AS industry_id,
    event_type AS title, props AS keyword, '' AS content,
    strftime(ts, '%Y-%m-%d %H:%M:%S') AS create_time, {VERSION_SQL} AS update_time,
    event_id AS browsers_count, ts,
    (event_id // {BLOCK}) * 4294967296
      + row_number() OVER (PARTITION BY event_id // {BLOCK} ORDER BY event_id) - 1 AS seq
  FROM events)"""
NOTE_PICK = "industry_id, title, keyword, content, create_time, update_time, browsers_count"


def notes(spark, sf) -> DataFrame:
    judged = landed.judge(note_pages(spark, sf), "industry")
    return feeds.flatten_industry(landed.usable(judged, "industry"))


@R.add("p10_flatten_industry", f"WITH {NOTES} SELECT seq, {NOTE_PICK} FROM notes")
def flatten_industry(spark, sf):
    return notes(spark, sf)


WINNERS = f"""stored AS (
  SELECT * FROM notes WHERE ts < '{SPLIT}'
  QUALIFY row_number() OVER (PARTITION BY industry_id ORDER BY update_time DESC, seq) = 1),
  batch AS (SELECT * FROM notes WHERE ts >= '{SPLIT}'),
  winners AS (
    SELECT {NOTE_PICK} FROM (SELECT * REPLACE (-1 AS seq) FROM stored UNION ALL SELECT * FROM batch)
    QUALIFY row_number() OVER (PARTITION BY industry_id ORDER BY update_time DESC, seq) = 1)"""


def _note_halves(spark, sf):
    rows = materialize(notes(spark, sf), "notes")
    early = F.col("create_time") < SPLIT
    return feeds.upsert_newer(None, rows.where(early)).drop("seq"), rows.where(~early)


@R.add("j9_upsert_newer", f"WITH {NOTES}, {WINNERS} SELECT {NOTE_PICK} FROM winners")
def upsert_newer(spark, sf):
    stored, batch = _note_halves(spark, sf)
    return feeds.in_feed_order(feeds.upsert_newer(stored, batch), "industry").drop("seq")


CHANGES = """ordered AS (
    SELECT industry_id AS k, update_time AS v, -1 AS seq, true AS old FROM stored
    UNION ALL SELECT industry_id, update_time, seq, false FROM batch),
  seen AS (
    SELECT *, max(v) OVER (PARTITION BY k ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b
    FROM ordered)"""
CHANGE_COUNTS = """SELECT count(*) FILTER (NOT old AND b IS NULL) AS added,
    count(*) FILTER (NOT old AND v > b) AS updated, count(DISTINCT k) AS total,
    count(*) FILTER (NOT old AND k = '') AS blank_keys FROM seen"""


@R.add("a11_change_report", f"WITH {NOTES}, {WINNERS}, {CHANGES} {CHANGE_COUNTS}")
def change_report(spark, sf):
    stored, batch = _note_halves(spark, sf)
    return feeds.change_report(stored, batch, "industry")


@R.add("s6_write_snapshot", f"""WITH {NOTES}, {WINNERS}
    SELECT industry_id, update_time, count(*) OVER () AS total, '2024-01-31' AS collected_on FROM winners""")
def write_snapshot(spark, sf):
    path = scratch_path(spark, "snapshot")
    stored, batch = _note_halves(spark, sf)
    tables.write_snapshot(stored, path, at())
    merged = feeds.upsert_newer(tables.read_snapshot(spark, path), batch).drop("seq")
    tables.write_snapshot(merged, path, at())
    meta = tables.snapshot_meta(spark, path)
    return tables.read_snapshot(spark, path).select(
        "industry_id", "update_time"
    ).withColumn("total", meta.select("total").scalar()).withColumn(
        "collected_on", meta.select(F.to_date("collected_at").cast("string")).scalar()
    )


# Timeline: a response per block of events, grouped by hour.

def timeline_pages(spark: SparkSession, sf: str) -> DataFrame:
    events = table(spark, sf, "events")
    event = F.struct(
        F.when(F.col("event_type") != "error", F.col("user_id").cast("string")).alias("article_id"),
        F.col("event_type").alias("title"),
        F.col("props").alias("content"),
        F.struct(
            F.when(F.col("value") >= 5, F.to_date("ts").cast("string")).alias("date"),
            F.dayofmonth("ts").cast("bigint").alias("grade"),
            F.array(
                F.struct(F.col("event_type").alias("name")), F.struct(F.lit("").alias("name")),
                F.struct(F.concat(F.lit("u"), "user_id").alias("name")),
            ).alias("theme_list"),
        ).alias("timeline"),
    )
    # Each response has one group per hour of the day.
    hours = events.groupBy(F.floor(F.col("event_id") / BLOCK).alias("page"), F.hour("ts").alias("h")).agg(
        F.array_sort(F.collect_list(F.struct("event_id", event.alias("e")))).alias("i")
    )
    return hours.groupBy("page").agg(
        F.array_sort(F.collect_list(F.struct("h", F.struct(F.col("i.e").alias("list")).alias("g")))).alias("gs")
    ).select(
        F.col("page").cast("string").alias("name"),
        F.to_json(F.struct(F.lit("0").alias("errCode"), F.col("gs.g").alias("data"))).alias("value"),
    )


TIMELINE = f"""timeline AS (
  SELECT CASE WHEN event_type <> 'error' THEN CAST(user_id AS VARCHAR) ELSE '' END AS article_id,
    CASE WHEN value >= 5 THEN CAST(CAST(ts AS DATE) AS VARCHAR) ELSE '' END AS date,
    event_type AS title, props AS content, CAST(day(ts) AS BIGINT) AS grade,
    event_type || ',u' || user_id AS themes, '' AS create_time,
    (event_id // {BLOCK}) * 4294967296
      + row_number() OVER (PARTITION BY event_id // {BLOCK} ORDER BY hour(ts), event_id) - 1 AS seq
  FROM events)"""
LINE_PICK = "article_id, date, title, content, grade, themes, create_time"


def timeline(spark, sf) -> DataFrame:
    judged = landed.judge(timeline_pages(spark, sf), "timeline")
    return feeds.flatten_timeline(landed.usable(judged, "timeline"))


def _line_flat(rows: DataFrame) -> DataFrame:
    return rows.withColumn("themes", F.array_join("themes", ","))


@R.add("p11_flatten_timeline", f"WITH {TIMELINE} SELECT seq, {LINE_PICK} FROM timeline")
def flatten_timeline(spark, sf):
    return _line_flat(timeline(spark, sf))


def _line_halves(spark, sf):
    rows = materialize(timeline(spark, sf), "timeline")
    early = F.col("grade") < 16
    return feeds.insert_absent(None, rows.where(early)).drop("seq"), rows.where(~early)


FIRST = f"""firsts AS (
  SELECT {LINE_PICK} FROM timeline QUALIFY row_number() OVER (PARTITION BY article_id ORDER BY seq) = 1)"""


@R.add("j10_insert_absent", f"""WITH {TIMELINE} SELECT {LINE_PICK} FROM timeline
    QUALIFY row_number() OVER (PARTITION BY article_id ORDER BY grade >= 16, seq) = 1""")
def insert_absent(spark, sf):
    stored, batch = _line_halves(spark, sf)
    return _line_flat(feeds.in_feed_order(feeds.insert_absent(stored, batch), "timeline").drop("seq"))


@R.add("a11_change_report_timeline", f"""WITH {TIMELINE}
    SELECT count(DISTINCT article_id) FILTER (grade >= 16 AND article_id NOT IN (
        SELECT article_id FROM timeline WHERE grade < 16)) AS added,
      CAST(0 AS BIGINT) AS updated, count(DISTINCT article_id) AS total,
      count(*) FILTER (grade >= 16 AND article_id = '') AS blank_keys FROM timeline""")
def change_report_timeline(spark, sf):
    stored, batch = _line_halves(spark, sf)
    return feeds.change_report(stored, batch, "timeline")


@R.add("a5_timeline_span", f"""WITH {TIMELINE}
    SELECT count(*) AS n_events, min(date) FILTER (date <> '') AS first_date,
      max(date) FILTER (date <> '') AS last_date FROM timeline""")
def timeline_span(spark, sf):
    return feeds.timeline_span(timeline(spark, sf))


# Jobs and streams.

def _streamed(spark, sf, pages, kind):
    state = scratch_path(spark, "stream")
    landing = _land(pages(spark, sf), kind)
    stream_feed(spark, landing, state, kind)
    # A second run finds nothing new.
    stream_feed(spark, landing, state, kind)
    return state


@R.add("f1_stream_industry", f"""WITH {NOTES} SELECT {NOTE_PICK} FROM notes
    QUALIFY row_number() OVER (PARTITION BY industry_id ORDER BY update_time DESC, seq) = 1""")
def stream_industry(spark, sf):
    state = _streamed(spark, sf, note_pages, "industry")
    return compact(spark, state, "industry")


@R.add("f1_stream_timeline", f"WITH {TIMELINE}, {FIRST} SELECT * FROM firsts")
def stream_timeline(spark, sf):
    return _line_flat(read_state(spark, _streamed(spark, sf, timeline_pages, "timeline"), "timeline"))


@R.add("f1_stream_actions", f"WITH {ACTIONS} SELECT {PICK} FROM actions")
def stream_actions(spark, sf):
    state = _streamed(spark, sf, mover_envelopes, "action")
    return spark.read.parquet(f"{state}/action").select(*ACTION_COLUMNS)


def _land_all(spark, sf) -> str:
    root = scratch_path(spark, "landing")
    for kind, rows in (("action", mover_envelopes), ("industry", note_pages), ("timeline", timeline_pages)):
        write_files(rows(spark, sf).select(
            F.concat("name", F.lit(".json")).alias("name"), F.col("value").alias("content")
        ), f"{root}/{kind}")
    return root


@R.add("b5_job_daily_refresh", f"""WITH {ACTIONS}, {SUMMARY}, {NOTES}, {TIMELINE}
    SELECT 'action' AS feed, n_fields AS a, n_stocks AS b, names AS c FROM ({DAY_SUMMARY})
    WHERE date = DATE '1997-01-01'
    UNION ALL
    SELECT 'industry', count(DISTINCT industry_id), (
        SELECT count(*) FILTER (update_time > b) FROM (SELECT update_time, max(update_time) OVER (
          PARTITION BY industry_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b
          FROM notes)), CAST(count(*) FILTER (industry_id = '') AS VARCHAR) FROM notes
    UNION ALL
    SELECT 'timeline', count(DISTINCT article_id), 0, CAST(count(*) FILTER (article_id = '') AS VARCHAR) FROM timeline
    UNION ALL
    SELECT 'span', count(*), NULL, min(date) FILTER (date <> '') || max(date) FILTER (date <> '') FROM timeline""")
def job_daily_refresh(spark, sf):
    done = jobs.job_daily_refresh(spark, _land_all(spark, sf), scratch_path(spark, "store"), "1997-01-01", at())
    reports = [
        done[k].select(F.lit(k).alias("feed"), F.col("added").alias("a"), F.col("updated").alias("b"),
                       F.col("blank_keys").cast("string").alias("c"))
        for k in ("industry", "timeline")
    ]
    summary = done["action"].select(
        F.lit("action").alias("feed"), F.col("n_fields").alias("a"), F.col("n_stocks").alias("b"), F.col("names").alias("c")
    )
    span = done["span"].select(
        F.lit("span").alias("feed"), F.col("n_events").alias("a"), F.lit(None).cast("bigint").alias("b"),
        F.concat("first_date", "last_date").alias("c"),
    )
    return summary.unionByName(reports[0]).unionByName(reports[1]).unionByName(span)


@R.add("b6_job_backfill", f"""WITH {ACTIONS},
    days AS (SELECT CAST(unnest(generate_series(DATE '1994-12-01', DATE '2001-12-31', INTERVAL 1 DAY)) AS DATE) AS date)
    SELECT date, CASE WHEN o.d IS NULL THEN 'failed' ELSE 'success' END AS status, coalesce(n, 0) AS n_rows
    FROM days LEFT JOIN (SELECT DISTINCT {DAY} AS d FROM orders) o ON o.d = date
      LEFT JOIN (SELECT date, count(*) AS n FROM actions GROUP BY date) USING (date)""")
def job_backfill(spark, sf):
    landing, store = scratch_path(spark, "landing"), scratch_path(spark, "store")
    write_files(mover_envelopes(spark, sf).select(
        F.concat("name", F.lit(".json")).alias("name"), F.col("value").alias("content")
    ), f"{landing}/action")
    jobs.job_backfill(spark, landing, store, "1996-12-31", "1994-12-01")
    outcome = jobs.job_backfill(spark, landing, store, "1994-12-01", "2001-12-31")
    rows = spark.read.parquet(f"{store}/action").groupBy("date").agg(F.count("*").alias("n_rows"))
    return outcome.join(rows, "date", "left").withColumn("n_rows", F.coalesce("n_rows", F.lit(0)))
