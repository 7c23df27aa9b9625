"""Concept pages, board membership and item/value rows."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from themeloom.functions import text as tx
from themeloom.operators.scale import once
from themeloom.session import materialize


def _row_event(part):
    """One table row as (kind, name, short, full); kind is null if it means nothing."""
    attrs = F.regexp_extract(part, tx.ROW_TAG, 1)
    body = F.regexp_extract(part, tx.ROW_BODY, 1)
    full = attrs.contains(tx.FULL_ROW)
    name = tx.drop_tags(F.regexp_extract(body, tx.NAME_CELL, 1))
    short = tx.strip(tx.plain_spaces(tx.drop_tags(F.regexp_extract(body, tx.SHORT_CELL, 1))))
    return F.struct(
        F.when(full, "full").when(name != "", "name").alias("kind"),
        F.when(~full, name).alias("name"),
        F.when(full, tx.html_text(body)).otherwise(short).alias("text"),
    )


def page_concepts(pages: DataFrame, *rest: str) -> DataFrame:
    """(code, concepts_ths) from concept pages (code, html), one list per page.

    The columns ``rest`` pass through.

    Only name rows and full-text rows count.  A name row yields a concept if the
    next counting row is a full-text row, or if there is none; its description
    is that full text or, failing that, its own short text.  All of it happens
    within the row of the page, so nothing is shuffled.
    """
    parts = F.filter(
        F.split(F.regexp_extract("html", tx.REGION, 1), tx.ROW_START),
        lambda p: p.startswith("<tr"),
    )
    meaning = F.filter(F.transform(parts, _row_event), lambda e: e["kind"].isNotNull())
    events = once(pages.select("code", *rest, "html"), "events", meaning)
    paired = events.select(
        "code", *rest,
        F.zip_with(
            "events",
            F.slice("events", F.lit(2), F.greatest(F.size("events"), F.lit(1))),
            lambda here, after: F.struct(here.alias("here"), after.alias("after")),
        ).alias("pairs"),
    )
    kept = F.filter(
        "pairs",
        lambda p: (p["here"]["kind"] == "name")
        & (p["after"]["kind"].isNull() | (p["after"]["kind"] == "full")),
    )
    return paired.select("code", *rest, F.transform(kept, lambda p: F.struct(
        p["here"]["name"].alias("name"),
        F.coalesce(tx.nonempty(p["after"]["text"]), p["here"]["text"]).alias("description"),
    )).alias("concepts_ths"))


def extract_concepts(pages: DataFrame) -> DataFrame:
    """(code, pos, name, description): the concepts of the pages, one per row."""
    rows = page_concepts(pages).select("code", F.posexplode_outer("concepts_ths").alias("pos", "c"))
    return rows.where(F.col("pos").isNotNull()).select("code", "pos", "c.name", "c.description")


def extract_industry(pages: DataFrame) -> DataFrame:
    return pages.select("code", tx.industry_of(F.col("html")).alias("industry"))


def html_text(pages: DataFrame, html: str = "html") -> DataFrame:
    """The pages with a ``text`` column of readable text."""
    return pages.withColumn("text", tx.html_text(F.col(html)))


def invert_membership(membership: DataFrame) -> DataFrame:
    """Board membership seen from the stocks: (code, concept_pos, concept, copies).

    Order within a stock is ``concept_pos``.  Repeated rows are counted before
    the shuffle and kept as ``copies``, so a stock or a row that makes up much
    of the input costs no task more than its share.
    """
    return (
        membership.select(
            tx.strip(F.col("code").cast("string")).alias("code"),
            "concept_pos",
            tx.strip(F.col("concept")).alias("concept"),
        )
        .where((F.col("code") != "") & (F.col("concept") != ""))
        .groupBy("code", "concept_pos", "concept")
        .agg(F.count("*").alias("copies"))
    )


def concept_lists(inverted: DataFrame) -> DataFrame:
    """One row per stock: ``concepts`` in board order and their ``copies``.

    A list has at most one entry per board, however often rows repeat.
    """
    entries = F.array_sort(F.collect_list(F.struct("concept_pos", "concept", "copies")))
    return (
        inverted.groupBy("code").agg(entries.alias("e"))
        .select("code", F.col("e.concept").alias("concepts"), F.col("e.copies").alias("copies"))
    )


def latest_items(rows: DataFrame) -> DataFrame:
    """(code, key, value) from item/value rows; of equal keys the last counts."""
    return (
        rows.select(
            "code", "pos", tx.strip(F.col("key")).alias("key"), tx.strip(F.col("value")).alias("value")
        )
        .where((F.col("key") != "") & (F.col("value") != ""))
        .groupBy("code", "key")
        .agg(F.max_by("value", "pos").alias("value"))
    )


def kv_to_map(rows: DataFrame) -> DataFrame:
    """(code, info) with one map per stock; a map holds each item name once."""
    return (
        latest_items(rows).groupBy("code")
        .agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("key", "value")))).alias("info"))
    )


def drop_contained_concepts(concepts: DataFrame) -> DataFrame:
    """Distinct (code, concept) without concepts that lie inside a longer one of their code.

    Every concept is read once against an automaton of all names, which finds the names
    inside it in one pass over its letters, however long it is and however many there
    are.  The names are sent to the tasks, at most about ``NAME_BYTES`` of them at once; a
    larger vocabulary goes in rounds.  What was found is matched by equality on (code,
    concept), so work grows with the rows and not with their square.
    """
    distinct = materialize(concepts.select("code", "concept").distinct(), "concepts")
    names = distinct.select("concept").where(F.col("concept").isNotNull()).distinct()
    size = names.agg(F.sum(F.octet_length("concept") + NAME_COST)).first()[0] or 0
    rounds = max(1, math.ceil(size / NAME_BYTES))
    inside = None
    for i in range(rounds):
        part = names if rounds == 1 else names.where(F.pmod(F.xxhash64("concept"), F.lit(rounds)) == i)
        found = _names_inside(distinct, part)
        inside = found if inside is None else inside.unionByName(found)
    return distinct.join(inside, ["code", "concept"], "left_anti")


# Bytes of names that an automaton is built from at once, and what each name adds to its own.
NAME_BYTES = 32 << 20
NAME_COST = 64


def _names_inside(rows: DataFrame, names: DataFrame) -> DataFrame:
    """(code, concept): the ``names`` that lie inside a longer concept of a code."""
    sent = rows.sparkSession.sparkContext.broadcast(names.toArrow().column("concept").to_pylist())
    schema = rows.select("code", "concept").schema

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        known = ahocorasick.Automaton(ahocorasick.STORE_LENGTH)
        for name in sent.value:
            if name:
                known.add_word(name)
        known.make_automaton()
        # The empty name lies inside every other.
        nothing = {""} & set(sent.value)
        for batch in batches:
            at, found = [], []
            for i, concept in enumerate(batch.column(1).to_pylist()):
                if not concept:
                    continue
                own = set(nothing)
                if len(known):
                    own |= {concept[end + 1 - n:end + 1] for end, n in known.iter(concept) if n < len(concept)}
                at += [i] * len(own)
                found += own
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(at, pa.int64())), pa.array(found, pa.string())], ["code", "concept"])

    return rows.select("code", "concept").mapInArrow(find, schema).distinct()
