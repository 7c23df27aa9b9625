"""Document fingerprints: Merkle trees over paragraphs and sections.

A text is cut at empty lines into sections and at line feeds into paragraphs.  A
paragraph's node is the hash of its text, a section's that of its paragraphs' nodes, and
the root that of its sections' nodes.  Nothing is lost in cutting, so roots are equal if
and only if texts are.  Where two roots differ, the nodes found in one tree only lead to
the edited paragraphs.  Below the paragraphs lie pieces of two words, so that likeness
also sees what a changed paragraph keeps: it is the share of the larger tree's different
pieces that both trees have.

All of it is DataFrame functions.

Defined results: a null text is an empty text; equal roots have likeness 1, texts without
words and different roots 0; repeated rows give repeated results; extra columns stay
where a function adds columns, and are left aside by ``edited_by_next``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from themeloom.operators.scale import once

# Words of a piece; a longer run without white space is cut every LONGEST characters.
LONGEST = 40
WORD = f"[^\\x09-\\x0D\\x20]{{1,{LONGEST}}}"
PIECE = f"{WORD}(?:[\\x09\\x0B-\\x0D\\x20]+{WORD})?"
# Cells of ids with about as many rows, and rows of a bucket within a cell.
CELLS = 256
BUCKET_ROWS = 1000


def paragraph_nodes(section: Column) -> Column:
    return F.transform(F.split(section, "\n", -1), lambda p: F.sha2(p, 256))


def section_nodes(text: Column) -> Column:
    return F.transform(
        F.split(text, "\n\n", -1), lambda s: F.sha2(F.concat_ws(",", paragraph_nodes(s)), 256))


def root(text: Column) -> Column:
    """Hash of the whole tree."""
    return F.sha2(F.concat_ws(",", section_nodes(text)), 256)


def pieces(text: Column) -> Column:
    """Hashes of the different pieces below the paragraphs."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(PIECE), F.lit(0)), lambda p: F.xxhash64(p)))


def with_tree(df: DataFrame, text: str, name: str) -> DataFrame:
    """Add ``name``: a struct of ``root`` and ``pieces``, computed once a row."""
    return once(df, name, F.struct(root(F.col(text)).alias("root"), pieces(F.col(text)).alias("pieces")))


def likeness(a: str, b: str) -> Column:
    """Likeness of two trees of ``with_tree``, from 0 to 1."""
    most = F.greatest(F.size(f"{a}.pieces"), F.size(f"{b}.pieces"))
    return (
        F.when(F.col(f"{a}.root") == F.col(f"{b}.root"), 1.0)
        .when(most == 0, 0.0)
        .otherwise(F.size(F.array_intersect(f"{a}.pieces", f"{b}.pieces")) / most)
    )


def locate_edits(df: DataFrame, key: str, before: str, after: str) -> DataFrame:
    """Paragraphs that only one of two texts has: ``key, side, section, paragraph, text``.

    Sections found on both sides are left without looking inside.  ``side`` is "before"
    or "after"; sections and paragraphs count from 0.
    """
    def sections(column: str, side: str) -> DataFrame:
        return df.select(
            F.col(key).alias("_key"), F.lit(side).alias("side"),
            F.posexplode(F.split(F.coalesce(F.col(column).cast("string"), F.lit("")), "\n\n", -1)).alias("section", "_s"),
        ).withColumn("_node", F.sha2(F.concat_ws(",", paragraph_nodes(F.col("_s"))), 256))

    def other(nodes: DataFrame) -> DataFrame:
        turned = F.when(F.col("side") == "before", "after").otherwise("before")
        return nodes.select("_key", turned.alias("side"), "_node").distinct()

    def only_one_side(nodes: DataFrame) -> DataFrame:
        o = other(nodes).select(F.col("_key").alias("_k"), F.col("side").alias("_o"), F.col("_node").alias("_n"))
        same = F.col("_key").eqNullSafe(F.col("_k")) & (F.col("side") == F.col("_o")) & (F.col("_node") == F.col("_n"))
        return nodes.join(o, same, "left_anti")

    changed = only_one_side(sections(before, "before").unionByName(sections(after, "after")))
    paragraphs = changed.select(
        "_key", "side", "section", F.posexplode(F.split("_s", "\n", -1)).alias("paragraph", "text"),
    ).withColumn("_node", F.sha2("text", 256))
    return only_one_side(paragraphs).select(F.col("_key").alias(key), "side", "section", "paragraph", "text")


def with_next(df: DataFrame, order: str, value: str, out: str) -> DataFrame:
    """Add ``out``: ``value`` of the next row by ``order``, the first row's after the last.

    ``order`` is an integer column; null comes first and equal ones go by a hash of
    ``value``.  Ids are cut into cells of about as many rows and these into buckets of
    equal width.  The next row is in the same bucket, or is the head of the next bucket
    that has rows; only heads are looked at across buckets.
    """
    key = F.col(order).cast("long")
    shares = [i / CELLS for i in range(1, CELLS)]
    stats = df.agg(
        F.min(key).alias("low"), F.max(key).alias("high"), F.count("*").alias("n"),
        F.percentile_approx(key, shares, 10_000).alias("cuts")).first()
    low, high = stats["low"] or 0, stats["high"] or 0
    edges = sorted({low, *(stats["cuts"] or []), high + 1})
    parts = max(1, round(stats["n"] / len(edges) / BUCKET_ROWS))
    bounds = F.array(*(F.lit(e).cast("long") for e in edges))
    # The edges ascend, so the number of those reached is the cell.
    cell = F.when(key.isNull(), 0).otherwise(F.size(F.filter(bounds, lambda e: e <= key)))
    left, right = F.element_at(bounds, F.col("_cell")), F.element_at(bounds, F.col("_cell") + 1)
    width = (right - left).cast("double")
    part = F.when(key.isNull(), F.pmod(F.col("_tie"), F.lit(parts))).otherwise(
        F.least(F.floor((key - left).cast("double") * parts / width), F.lit(parts - 1)))
    placed = (
        df.withColumn("_tie", F.xxhash64(value)).withColumn("_cell", cell)
        .withColumn("_part", F.when(F.col("_cell") == 0, F.pmod(F.col("_tie"), F.lit(parts))).otherwise(part))
    )
    within = Window.partitionBy("_cell", "_part").orderBy(F.col(order).asc_nulls_first(), "_tie")
    led = placed.withColumn("_next", F.lead(F.struct(F.col(value).alias("v"))).over(within))
    # Heads: one row for each bucket that has rows.
    heads = placed.groupBy("_cell", "_part").agg(
        F.min_by(F.struct(F.col(value).alias("v")), F.struct(key, F.col("_tie"))).alias("_head"))
    in_cell = Window.partitionBy("_cell").orderBy("_part")
    after = heads.select("_cell", "_part", F.lead("_head").over(in_cell).alias("_after"))
    # One row for each cell: the head of the next cell, or of the first after the last.
    starts = heads.groupBy("_cell").agg(F.min_by("_head", "_part").alias("_start"))
    cells = Window.orderBy("_cell")
    everywhere = cells.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    follow = starts.select(
        F.col("_cell").alias("_c"),
        F.coalesce(F.lead("_start").over(cells), F.first("_start").over(everywhere)).alias("_follow"))
    ends = after.join(follow, F.col("_cell") == F.col("_c")).select(
        F.col("_cell").alias("_c"), F.col("_part").alias("_p"), F.coalesce("_after", "_follow").alias("_end"))
    return led.join(ends, (F.col("_cell") == F.col("_c")) & (F.col("_part") == F.col("_p"))).select(
        *df.columns, F.coalesce("_next", "_end")["v"].alias(out))


def edited_by_next(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every text beside its edited form, whose last quarter is from the next text.

    Returns ``id_col``, ``text``, ``edited``, ``next``, and trees ``tree``,
    ``edited_tree``, ``next_tree``.
    """
    docs = df.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    led = with_next(docs, "_id", "text", "next")
    cut = F.floor(F.length("text") / 4)
    edited = F.concat(
        F.expr("left(text, cast(length(text) - floor(length(text) / 4) as int))"), F.left("next", cut.cast("int")))
    out = once(led, "edited", edited)
    for text, name in (("text", "tree"), ("edited", "edited_tree"), ("next", "next_tree")):
        out = with_tree(out, text, name)
    return out.withColumnRenamed("_id", id_col)


# The same in SQL, over table ``documents``.
SQL = f"""
WITH docs AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
led AS (
  SELECT doc_id, text, length(text) AS n_chars,
         coalesce(lead(text) OVER (ORDER BY doc_id), first_value(text) OVER (ORDER BY doc_id)) AS next FROM docs
), edited AS (
  SELECT *, left(text, n_chars - n_chars // 4) || left(next, n_chars // 4) AS edited FROM led
), trees AS (
  SELECT doc_id, n_chars, sha256(edited) AS edited_sha256,
         [sha256(list_aggregate([sha256(list_aggregate([sha256(p) for p in string_split(s, chr(10))], 'string_agg', ','))
                  for s in string_split(t, chr(10) || chr(10))], 'string_agg', ',')) for t in [text, edited, next]] AS roots,
         [list_distinct(regexp_extract_all(t, '{PIECE}')) for t in [text, edited, next]] AS pieces
  FROM edited
)
SELECT doc_id, n_chars, edited_sha256, roots[1] AS fingerprint, roots[2] AS edited_fingerprint,
       CASE WHEN roots[1] = roots[2] THEN 1.0::DOUBLE
            WHEN greatest(len(pieces[1]), len(pieces[2])) = 0 THEN 0.0::DOUBLE
            ELSE len(list_intersect(pieces[1], pieces[2]))::DOUBLE / greatest(len(pieces[1]), len(pieces[2])) END AS near_edited,
       CASE WHEN roots[1] = roots[3] THEN 1.0::DOUBLE
            WHEN greatest(len(pieces[1]), len(pieces[3])) = 0 THEN 0.0::DOUBLE
            ELSE len(list_intersect(pieces[1], pieces[3]))::DOUBLE / greatest(len(pieces[1]), len(pieces[3])) END AS near_next
FROM trees
"""
