"""A training corpus from ``documents``: stages that each read what the one before kept.

1. ``language``: texts that language ID rejects go (``und``, or too far from every language).
2. ``lines``: recurring lines are dropped from the texts.
3. ``near_duplicates``: one document of each class of similar texts stays.
4. ``substrings``: words of long passages that an earlier document has are cut out.
5. ``packing``: the texts left are cut into token sequences.

All stages but the last return the columns of what they were given.  A row is known by its
id and its text, so repeated ids are told apart where texts differ; repeated rows stay
until stage 3 keeps one.  A null text is rejected by the first stage; a text that a stage
empties stays as an empty text, since its row may carry other columns of worth.  Empty
tables give empty results.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from themeloom.llm import jaccard, langid, lines, packing, substrings
from themeloom.session import materialize

VOCAB = public_tokenizers.path("word_bpe_49k.json")


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that language ID, learned from their labels, does not reject."""
    return langid.accepted(docs, langid.fit(docs))


def recurring_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines of recurring templates."""
    return lines.without_recurring(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class."""
    return jaccard.one_of_each(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the words of passages that an earlier document has."""
    return substrings.without_repeats(docs)


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents and their places in sequences."""
    return packing.pack(docs, VOCAB)


# (name, function) in order; each function takes (spark, docs, sf_dir).
STAGES = [
    ("language", language),
    ("lines", recurring_lines),
    ("near_duplicates", near_duplicates),
    ("substrings", repeated_passages),
    ("packing", sequences),
]

# The first stage learns and the last searches: SQL has no words for them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stage over the whole table, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
