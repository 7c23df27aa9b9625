"""Merging the drafts of several sources into one record per stock."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from themeloom.functions.text import nonempty
from themeloom.schemas import CONCEPT, QUOTE_FIELDS

# Source names, and the folders below the drafts that are no source.
BOARD_SOURCE = "eastmoney"
WEB_SOURCE = "ths"
QUOTE_SOURCE = "tencent"
SOURCES = (BOARD_SOURCE, QUOTE_SOURCE, WEB_SOURCE)
MERGED_DIR = "merged"

NO_TEXT_LIST = "array<string>"
TEXT_MAP = "map<string,string>"
# Place of sources that no ranking names.
UNRANKED = 2**31 - 1


def stamp(df: DataFrame, source: str, at: Column | None = None) -> DataFrame:
    """Add the provenance struct; ``at`` defaults to now."""
    when = F.current_timestamp() if at is None else at
    return df.withColumn(
        "_meta",
        F.struct(
            F.lit(source).alias("source"),
            F.col("code").alias("stock_code"),
            F.date_format(when, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("collected_at"),
        ),
    )


def _override(base: Column, top: Column) -> Column:
    """Map union where ``top`` wins."""
    kept = F.map_filter(base, lambda k, _: ~F.map_contains_key(top, k))
    return F.map_concat(kept, top)


def latest_drafts(drafts: DataFrame) -> DataFrame:
    """(code, source, draft): the latest draft of each code and source.

    A draft has the fields that are taken from its source.  A code with very many drafts
    of one source is reduced in every task before the shuffle.
    """
    quote = F.map_filter(
        F.map_from_arrays(
            F.array(*[F.lit(f) for f in QUOTE_FIELDS]), F.array(*[F.col(f) for f in QUOTE_FIELDS])
        ),
        lambda _, v: F.coalesce(v, F.lit("")) != "",
    )
    extra = F.coalesce("extra", F.create_map().cast(TEXT_MAP))
    body = ("extra", "concepts", "info", "concepts_ths", "industry", "quote")
    slim = drafts.where(F.col("source") != MERGED_DIR).select(
        "code", "source", "name", "concepts", "info", "concepts_ths", "industry",
        extra.alias("extra"), quote.alias("quote"), F.coalesce("_meta.collected_at", F.lit("")).alias("at"),
    ).withColumn("_body", F.xxhash64(F.to_json(F.struct(*body))))

    def of(source: str, *fields: str) -> list[Column]:
        return [F.when(F.col("source") == source, F.col(f)).alias(f) for f in fields]

    draft = F.struct(
        "name", "extra", *of(BOARD_SOURCE, "concepts", "info"), *of(WEB_SOURCE, "concepts_ths", "industry"),
        *of(QUOTE_SOURCE, "quote"))
    return slim.groupBy("code", "source").agg(F.max_by(draft, F.struct("at", "name", "_body")).alias("draft"))


def merge_drafts(drafts: DataFrame, source_rank: Sequence[str] | None = None) -> DataFrame:
    """One record per code from all drafts.

    ``source_rank`` lists the sources, most trusted first; others follow by name.  Drafts
    are reduced to one per code and source first; those of a code, as many as it has
    sources, are then folded in the order of trust.  The plan does not depend on the
    number of sources.
    """
    order = [s for s in source_rank or [] if s != MERGED_DIR]
    place = F.lit(UNRANKED)
    if order:
        named = F.create_map(*[F.lit(x) for i, s in enumerate(order) for x in (s, i)])
        place = F.coalesce(F.element_at(named, F.col("source")), place)
    grouped = latest_drafts(drafts).groupBy("code").agg(
        F.array_sort(F.collect_list(F.struct(place.alias("place"), "source", "draft")), _by_trust).alias("drafts"))
    no_map = F.create_map().cast(TEXT_MAP)

    def of(source: str, field: str, default: Column) -> Column:
        own = F.filter("drafts", lambda d: d["source"] == source)
        return F.coalesce(F.get(own, F.lit(0))["draft"][field], default)

    names = F.filter(F.transform("drafts", lambda d: nonempty(d["draft"]["name"])), lambda n: n.isNotNull())
    extra = F.aggregate("drafts", no_map, lambda held, d: _override(held, F.coalesce(d["draft"]["extra"], no_map)))
    return grouped.select(
        "code",
        F.coalesce(F.get(names, F.lit(0)), F.lit("")).alias("name"),
        of(BOARD_SOURCE, "concepts", F.array().cast(NO_TEXT_LIST)).alias("concepts_eastmoney"),
        of(WEB_SOURCE, "concepts_ths", F.array().cast(f"array<{CONCEPT.simpleString()}>"))
        .alias("concepts_ths"),
        of(WEB_SOURCE, "industry", F.lit("")).alias("industry"),
        _override(of(BOARD_SOURCE, "info", no_map), of(QUOTE_SOURCE, "quote", no_map)).alias("info"),
        F.transform("drafts", lambda d: d["source"]).alias("sources"),
        extra.alias("extra"),
    )


def _by_trust(a: Column, b: Column) -> Column:
    """Most trusted first, then by name; a code has each source once."""
    first = (a["place"] < b["place"]) | ((a["place"] == b["place"]) & (a["source"] < b["source"]))
    return F.when(first, -1).otherwise(1)


def assemble_documents(merged: DataFrame) -> DataFrame:
    """(code, name, content): a text per record in a fixed order of parts.

    Heading, industry, web concepts with their descriptions, then boards; parts
    without content are left out.
    """
    described = F.transform(
        "concepts_ths",
        lambda c: F.when(
            F.coalesce(c["description"], F.lit("")) != "",
            F.concat(F.lit("- "), c["name"], F.lit(": "), c["description"]),
        ).otherwise(F.concat(F.lit("- "), c["name"])),
    )
    boards = F.array_join("concepts_eastmoney", "、")
    parts = F.array_compact(F.array(
        F.concat(F.lit("# "), F.col("name"), F.lit(" ("), F.col("code"), F.lit(")")),
        F.when(F.col("industry") != "", F.concat(F.lit("所属行业: "), F.col("industry"))),
        F.when(
            F.size("concepts_ths") > 0,
            F.concat(F.lit("## 核心题材\n"), F.array_join(described, "\n")),
        ),
        F.when(F.size("concepts_eastmoney") > 0, F.concat(F.lit("## 所属板块\n"), boards)),
    ))
    return merged.select("code", "name", F.array_join(parts, "\n\n").alias("content"))


def concept_counts(merged: DataFrame) -> DataFrame:
    """Concepts per stock and source; a board that lists a stock several times counts as often."""
    copies = F.from_json(F.element_at("extra", "concept_copies"), "array<int>")
    boards = F.size("concepts_eastmoney")
    repeated = F.when(F.size(copies) == boards, F.aggregate(copies, F.lit(0), lambda n, x: n + x))
    return merged.withColumn("n_boards", F.coalesce(repeated, boards)).select(
        "code", "n_boards", F.size("concepts_ths").alias("n_web"),
        (F.col("n_boards") + F.size("concepts_ths")).alias("n_concepts"),
    )


def concept_totals(merged: DataFrame) -> DataFrame:
    """Stocks and concepts per source over all records."""
    counts = concept_counts(merged)
    return counts.agg(
        F.count("*").alias("n_stocks"),
        F.coalesce(F.sum("n_boards"), F.lit(0)).alias("n_boards"),
        F.coalesce(F.sum("n_web"), F.lit(0)).alias("n_web"),
    )


def outcome_counts(attempts: DataFrame) -> DataFrame:
    """Success, empty and no-data counts per source run.

    ``attempts`` has (source, landed BOOLEAN, n_concepts INT): whether the source
    delivered anything for a stock, and how many concepts it found (null for a
    source that has none to find).
    """
    landed = F.coalesce("landed", F.lit(False))
    return attempts.groupBy("source").agg(
        F.count_if(landed & F.coalesce(F.col("n_concepts") > 0, F.lit(True))).alias("success"),
        F.count_if(landed & (F.col("n_concepts") == 0)).alias("empty"),
        F.count_if(~landed).alias("no_data"),
    )
