"""Market-event feeds: flattening, keyed upserts and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from themeloom.functions.text import nonempty, present
from themeloom.operators.scale import checked_broadcast, once, running_max
from themeloom.schemas import ACTION_FIELD

INDUSTRY_FIELDS = (
    "industry_id", "title", "keyword", "content", "create_time", "update_time", "browsers_count",
)
TIMELINE_FIELDS = ("article_id", "date", "title", "content", "grade", "themes", "create_time")
KEYS = {"industry": "industry_id", "timeline": "article_id"}
VERSIONS = {"industry": "update_time", "timeline": None}
# Order of a row within a feed: page number in the high half, position in the low.
PAGE_STRIDE = 1 << 32
COUNT = "map<string,string>"
# Stored rows come before every row of a batch.
STORED_SEQ = -1


def _text(c: Column | str) -> Column:
    return F.coalesce(c if isinstance(c, Column) else F.col(c), F.lit(""))


def part_of(field_pos: Column) -> Column:
    """The part of its date that a field came in."""
    return F.floor(field_pos / PAGE_STRIDE).cast("int")


def action_fields(raw: DataFrame) -> DataFrame:
    """(date, field_pos, field_name, field_reason, stocks) from valid envelopes.

    ``raw`` has (date, part, data ARRAY<STRING>); a date may come in parts.
    Entries that are no objects are skipped, and so are fields without stocks
    whose count is missing or equals 0; a null count is not 0.  ``field_pos`` orders the fields of a date by their part
    and their place in it.
    """
    # As a map of texts, a missing count differs from a null one, and 3.0 is kept.
    both = F.struct(
        F.from_json("entry", ACTION_FIELD.simpleString()).alias("f"), F.from_json("entry", COUNT).alias("counts"))
    count, has_count = F.element_at("e.counts", "count"), F.map_contains_key("e.counts", "count")
    counted = has_count & (F.coalesce(count.try_cast("double"), F.lit(1.0)) != 0)
    listed = F.coalesce(F.size(F.col("e.f.list")), F.lit(0))
    entries = raw.select(
        "date", "part", F.posexplode_outer("data").alias("pos", "entry")
    ).where(F.ltrim(F.col("entry")).startswith("{"))
    return (
        once(entries, "e", both)
        .where((listed > 0) | counted)
        .select("date", (F.col("part").cast("bigint") * PAGE_STRIDE + F.col("pos")).alias("field_pos"), "e.f")
        .select(
            "date", "field_pos",
            _text("f.name").alias("field_name"),
            _text("f.reason").alias("field_reason"),
            F.col("f.list").alias("stocks"),
        )
    )


def flatten_actions(raw: DataFrame) -> DataFrame:
    """One row per stock of each field; a field without stocks keeps one row."""
    info = F.col("stock.article.action_info")
    here = F.col("stock").isNotNull()
    return (
        action_fields(raw)
        .select("date", "field_pos", "field_name", "field_reason",
                F.posexplode_outer("stocks").alias("stock_pos", "stock"))
        .select(
            "date", "field_pos", "field_name", "field_reason", "stock_pos",
            F.when(here, _text("stock.code")).alias("code"),
            F.when(here, _text("stock.name")).alias("name"),
            *[F.when(here, _text(info[c])).alias(c) for c in ("time", "num")],
            *[info[c].alias(c) for c in ("day", "edition", "shares_range")],
            *[F.when(here, _text(info[c])).alias(c) for c in ("reason", "expound")],
            info["is_crawl"].alias("is_crawl"),
        )
    )


def flatten_industry(raw: DataFrame) -> DataFrame:
    """Industry notes of all pages in order; ``raw`` has (page, data), and ``run`` if that is to be kept."""
    item = F.col("item")
    run = [c for c in raw.columns if c == "run"]
    items = raw.select(*run, "page", F.posexplode_outer("data.result").alias("pos", "item"))
    return items.where(F.col("pos").isNotNull()).select(
        *run,
        (F.col("page").cast("bigint") * PAGE_STRIDE + F.col("pos")).alias("seq"),
        *[_text(item[c]).alias(c) for c in INDUSTRY_FIELDS[:-1]],
        F.coalesce(item["browsers_count"], F.lit(0)).alias("browsers_count"),
    )


def flatten_timeline(raw: DataFrame) -> DataFrame:
    """Timeline events of all groups in order; ``raw`` has (page, data)."""
    event = F.col("event")
    line = F.col("event.timeline")
    held = F.filter("data", lambda g: g["list"].isNotNull())
    listed = F.flatten(F.transform(held, lambda g: g["list"]))
    events = raw.select("page", F.posexplode(listed).alias("pos", "event"))
    names = F.transform(line["theme_list"], lambda t: t["name"])
    themes = F.filter(names, lambda n: F.coalesce(n, F.lit("")) != "")
    return events.select(
        (F.col("page").cast("bigint") * PAGE_STRIDE + F.col("pos")).alias("seq"),
        _text(event["article_id"]).alias("article_id"),
        _text(line["date"]).alias("date"),
        _text(event["title"]).alias("title"),
        _text(event["content"]).alias("content"),
        line["grade"].alias("grade"),
        F.coalesce(themes, F.array().cast("array<string>")).alias("themes"),
        _text(line["create_time"]).alias("create_time"),
    )


def _first_per_key(rows: DataFrame, key: str, *order: Column) -> DataFrame:
    """The first row of each key.  Every task keeps one row per key before the
    shuffle, so a key with very many rows is cheap to settle."""
    w = Window.partitionBy(key).orderBy(*order)
    return rows.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def _ranking(kind: str) -> list[Column]:
    version = VERSIONS[kind]
    newest = [F.desc(version)] if version else []
    return newest + [F.asc("seq")]


def load_rule(stored: DataFrame, kind: str, pos: str) -> DataFrame:
    """A stored feed with one row per key: the last of repeated keys counts."""
    return _first_per_key(stored, KEYS[kind], F.desc(pos)).drop(pos)


def reduce_batch(batch: DataFrame, kind: str) -> DataFrame:
    """The row of each key that can still win against what is stored."""
    return _first_per_key(batch, KEYS[kind], *_ranking(kind))


def reduce_pages(batch: DataFrame, kind: str) -> DataFrame:
    """The row of each key, run and page that can still win, whichever pages will count."""
    page = F.floor(F.col("seq") / PAGE_STRIDE)
    w = Window.partitionBy(KEYS[kind], "run", page).orderBy(*_ranking(kind))
    return batch.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def reduce_deltas(deltas: DataFrame, kind: str) -> DataFrame:
    """The winner of each key over numbered batches; an earlier ``batch`` goes first."""
    order = [*_ranking(kind)[:-1], F.asc("batch"), F.asc("seq")]
    return _first_per_key(deltas, KEYS[kind], *order).drop("batch")


def upsert(existing: DataFrame | None, batch: DataFrame, kind: str) -> DataFrame:
    """A feed after a batch, by the rule of its kind."""
    if existing is None:
        return reduce_batch(batch, kind)
    stored = existing.drop("seq").withColumn("seq", F.lit(STORED_SEQ).cast("bigint"))
    touched, rest = _by_batch_keys(stored, batch, KEYS[kind])
    winners = reduce_batch(touched.unionByName(batch), kind)
    return winners.unionByName(rest)


def _by_batch_keys(stored: DataFrame, batch: DataFrame, key: str):
    """Stored rows with a key of the batch, and the others; null is a key as well.

    A batch with few keys is told apart without moving the stored table, so only
    the touched rows are shuffled.  With more keys the same is a shuffle join.
    """
    keys = checked_broadcast(batch.select(F.col(key).alias("_touched")).distinct())
    same = F.col(key).eqNullSafe(F.col("_touched"))
    return stored.join(keys, same, "left_semi"), stored.join(keys, same, "left_anti")


def upsert_newer(existing: DataFrame | None, batch: DataFrame) -> DataFrame:
    """Industry notes after a batch: newer versions replace, ties keep the older.

    Applying rows one after the other keeps the running maximum of the version,
    hence the winner is the greatest version, first seen among equals.
    ``existing`` holds one row per key; ``batch`` carries ``seq``, its order, and
    is read several times, so it should be a table rather than a long plan.
    """
    return upsert(existing, batch, "industry")


def insert_absent(existing: DataFrame | None, batch: DataFrame) -> DataFrame:
    """Timeline after a batch: stored keys stay, of new keys the first row counts."""
    return upsert(existing, batch, "timeline")


def in_feed_order(rows: DataFrame, kind: str) -> DataFrame:
    """Newest update first, or earliest date first, with the key as last resort."""
    if kind == "industry":
        return rows.orderBy(F.desc("update_time"), "seq", "industry_id")
    return rows.orderBy(F.asc("date"), "seq", "article_id")


def change_report(
    existing: DataFrame | None, batch: DataFrame, kind: str, total_before: int | None = None
) -> DataFrame:
    """(added, updated, total, blank_keys) of an upsert.

    A row is an addition if its key was never seen, and an update if it is newer
    than everything seen before it.  Rows that share the empty key are counted
    separately as well, since they hide missing keys.  With ``total_before``, the rows
    of the feed, ``existing`` needs to have those with keys of the batch only.
    """
    key, version = KEYS[kind], VERSIONS[kind]
    at = F.col(version) if version else F.lit("")
    columns = [F.col(key).alias("k"), _text(at).alias("v"), F.col("seq").cast("bigint").alias("seq")]
    rows = batch.select(*columns, F.lit(False).alias("stored"))
    others = F.lit(0).cast("bigint")
    if existing is not None:
        old = existing.drop("seq").withColumn("seq", F.lit(STORED_SEQ))
        if total_before is None:
            old, rest = _by_batch_keys(old, batch, key)
            others = rest.agg(F.count("*")).scalar()
        rows = old.select(*columns, F.lit(True).alias("stored")).unionByName(rows)
    if version is None:
        # Nothing is ever updated, so counting keys is enough.
        per_key = rows.groupBy("k").agg(
            F.max("stored").alias("stored"),
            F.count_if(~F.col("stored") & (F.col("k") == "")).alias("blank"),
        )
        report = per_key.agg(
            F.count_if(~F.col("stored")).alias("added"),
            F.lit(0).cast("bigint").alias("updated"),
            F.count("*").alias("total"),
            F.coalesce(F.sum("blank"), F.lit(0)).alias("blank_keys"),
        )
    else:
        seen = running_max(rows, "k", "seq", "v", "before")
        fresh = ~F.col("stored")
        first = F.col("before").isNull()
        report = seen.agg(
            F.count_if(fresh & first).alias("added"),
            F.count_if(fresh & (F.col("v") > F.col("before"))).alias("updated"),
            F.count_if(first).alias("total"),
            F.count_if(fresh & (F.col("k") == "")).alias("blank_keys"),
        )
    if total_before is None:
        return report.withColumn("total", F.col("total") + others)
    return report.withColumn("total", F.lit(total_before).cast("bigint") + F.col("added"))


def action_day_summary(actions: DataFrame) -> DataFrame:
    """Per date: fields, stocks, and the first five field names.

    Fields are reduced before dates, and only five names per date reach the
    step that joins them, so a busy date is no bottleneck.
    """
    fields = actions.groupBy("date", "field_pos").agg(
        F.count("code").alias("stocks"), F.min("field_name").alias("field_name")
    )
    counts = fields.groupBy("date").agg(
        F.count("*").alias("n_fields"),
        F.sum("stocks").alias("n_stocks"),
        F.count_if(present(F.col("field_name"))).alias("named"),
    )
    w = Window.partitionBy("date").orderBy("field_pos")
    leading = (
        fields.where(present(F.col("field_name")))
        .withColumn("rn", F.row_number().over(w)).where("rn <= 5")
        .groupBy("date")
        .agg(F.array_sort(F.collect_list(F.struct("rn", "field_name"))).alias("top"))
    )
    names = F.array_join(F.col("top.field_name"), ", ")
    return counts.join(leading, "date", "left").select(
        "date", "n_fields", "n_stocks",
        F.concat(_text(names), F.when(F.col("named") > 5, "...").otherwise("")).alias("names"),
    )


def timeline_span(events: DataFrame) -> DataFrame:
    """Event count with the earliest and latest non-empty date."""
    date = nonempty(F.col("date"))
    return events.agg(
        F.count("*").alias("n_events"), F.min(date).alias("first_date"), F.max(date).alias("last_date")
    )
