"""The dealt operators as queries over the driver tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from themeloom.llm import bpe, fim, fingerprints, jaccard, langid, lexical, lines, lm, packing, sharding, substrings, topk, warc
from themeloom.session import scratch_path

WORD_VOCAB = public_tokenizers.path("word_bpe_49k.json")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids and decoded text of every document, as digests."""
    coded = bpe.round_trip(table(spark, sf_dir, "documents"), WORD_VOCAB)
    return coded.select(
        "doc_id", "n_tokens",
        F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def fold(parts: int) -> Column:
    return F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(parts))


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page through ARC archives of both versions, their conversion, and WARC archives."""
    pages = table(spark, sf_dir, "pages")
    arc, out = scratch_path(spark, "arc"), scratch_path(spark, "warc")
    uri = F.concat(F.coalesce("url", F.lit("-")), F.lit("#page="), F.coalesce(F.col("page_id").cast("string"), F.lit("")))
    odd = F.coalesce(F.col("page_id"), F.lit(0)) % 2 != 0
    warc.write_arc(pages.where(~odd), f"{arc}/version=1", 1, uri, F.col("html"))
    warc.write_arc(pages.where(odd), f"{arc}/version=2", 2, uri, F.col("html"))
    number = lambda c: F.regexp_extract(c, "#page=(-?[0-9]*)$", 1).try_cast("long")
    warc.convert(spark, arc, out, order=number(F.col("uri")))
    return warc.read_warc(spark, out, with_payload=False).select(
        number(F.col("uri")).alias("page_id"), "payload_bytes", "payload_digest", "record_type",
        number(F.col("refers_to_uri")).alias("refers_to"),
    )


def op3_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best other vectors by whole-number inner product for every hundredth id."""
    return topk.top(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op4_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and its edited text, and their likeness."""
    both = fingerprints.edited_by_next(table(spark, sf_dir, "documents"))
    return both.select(
        "doc_id", F.length("text").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"),
        F.col("tree.root").alias("fingerprint"), F.col("edited_tree.root").alias("edited_fingerprint"),
        fingerprints.likeness("tree", "edited_tree").alias("near_edited"),
        fingerprints.likeness("tree", "next_tree").alias("near_next"),
    )


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of every document with its place in a sequence."""
    return packing.pack(table(spark, sf_dir, "documents"), WORD_VOCAB)


def op6_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned from the documents of the other folds."""
    docs = table(spark, sf_dir, "documents")
    held = fold(4) == 2
    model = langid.fit(docs.where(~held))
    named = langid.predict(docs, model)
    return named.select("doc_id", held.alias("held_out"), "lang_pred", "score", "rejected")


def op7_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without its recurring lines."""
    kept = lines.dedup(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


def op8_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log probability of every document, learned from the documents of the other folds."""
    held = fold(7) == 2
    scored = lm.score(table(spark, sf_dir, "documents"), ~held)
    return scored.select(
        "doc_id", held.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op9_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class and number of links of every document."""
    return jaccard.classes(table(spark, sf_dir, "documents"))


def op10_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the words of windows that an earlier document has too."""
    kept = substrings.dedup(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op11_fim(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document cut for filling in its middle, and its text rebuilt from the output."""
    cut = fim.transform(table(spark, sf_dir, "documents"))
    return cut.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"),
        F.sha2(fim.restore(F.col("output"), F.col("form")), 256).alias("restored_sha256"),
    )


def op12_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents of every benchmark item."""
    return lexical.rank(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shard and slot of every document, sources in proportion in every shard."""
    docs = table(spark, sf_dir, "documents")
    text = F.col("text")
    rows = docs.select(
        "doc_id", "source", F.sha2("text", 256).alias("digest"), sharding.size_of(text).alias("size"),
        F.crc32(F.coalesce(text, F.lit(""))).alias("text_crc32"))
    placed = sharding.assign(rows, key=["doc_id", "digest"], keep=["doc_id", "size", "text_crc32"])
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit(sharding.LAW).alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_bpe": op1_bpe,
    "op2_warc": op2_warc,
    "op3_topk": op3_topk,
    "op4_fingerprints": op4_fingerprints,
    "op5_packing": op5_packing,
    "op6_langid": op6_langid,
    "op7_lines": op7_lines,
    "op8_lm": op8_lm,
    "op9_jaccard": op9_jaccard,
    "op10_substrings": op10_substrings,
    "op11_fim": op11_fim,
    "op12_lexical": op12_lexical,
    "op13_sharding": op13_sharding,
}

SQL: dict[str, str] = {
    "op2_warc": warc.SQL,
    "op3_topk": topk.SQL,
    "op4_fingerprints": fingerprints.SQL,
    "op7_lines": lines.SQL,
    "op11_fim": fim.SQL,
    "op12_lexical": lexical.SQL,
}
