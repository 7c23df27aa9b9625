"""From summary texts to keywords with document frequency and IDF."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from themeloom.functions import text as tx
from themeloom.functions.stopwords import STOP_WORDS
from themeloom.operators.scale import checked_broadcast, spread

# Word classes a keyword may have, and its shortest length.
NOUN_CLASSES = ("n", "nr", "ns", "nt", "nz", "vn", "an", "eng")
MIN_LENGTH = 2
# Class of a letter run that no lexicon lists; a run of digits alone is a number.
RUN_CLASS = "eng"
NUMBER_CLASS = "m"
# Lengths of the pieces that Chinese text is cut into.
GRAM_LENGTHS = (2, 3, 4, 5, 6)
# Share of the documents above which a word says nothing.
MAX_SHARE = 0.5

# Unicode classes, and only a line feed ends a line.
HEADER = r"(?mdU)^#\s+(\d{6})\s+(.+)"


def _name_parts(file_name: Column) -> Column:
    return F.split(F.regexp_replace(file_name, r"\.md$", ""), "_", 2)


def code_of(file_name: Column) -> Column:
    """The code that a file's name gives, which may be empty."""
    return F.get(_name_parts(file_name), F.lit(0))


def parse_summary(df: DataFrame) -> DataFrame:
    """(path, code, name, content) from whole files (file_name, content).

    Code and name come from the file name, split at its first underscore; only
    if that gives no code does the heading count.  Empty files and files without
    a code are dropped.
    """
    content = tx.strip(F.col("content"))
    cut = _name_parts(F.col("file_name"))
    named = df.select(
        F.col("file_name").alias("path"),
        F.get(cut, F.lit(0)).alias("_code"),
        F.coalesce(F.get(cut, F.lit(1)), F.lit("")).alias("_name"),
        content.alias("content"),
    ).where(F.col("content") != "")
    by_heading = F.col("_code") == ""
    heading = F.regexp_extract("content", HEADER, 1)
    heading_name = tx.strip(F.regexp_extract("content", HEADER, 2))
    return named.select(
        "path",
        F.when(by_heading, heading).otherwise(F.col("_code")).alias("code"),
        F.when(by_heading & (heading != ""), heading_name).otherwise(F.col("_name")).alias("name"),
        "content",
    ).where(F.col("code") != "")


def tokenize(docs: DataFrame, lexicon: DataFrame | None = None, text: str = "content") -> DataFrame:
    """One row per document and distinct candidate: the columns of ``docs``
    other than the text, ``token`` and its word class ``pos``.

    Letter and digit runs are candidates of their own; runs with Chinese text
    are cut into pieces of two to six characters, of which those in ``lexicon``
    (token, pos) stay.  Repeats within a document are removed inside its row, so
    no shuffle is needed to count documents later.
    """
    keep = [c for c in docs.columns if c != text]
    runs = spread(docs).select(
        *keep, F.array_distinct(tx.words(F.col(text))).alias("runs"), tx.has_han(F.col(text)).alias("_han")
    )
    # Most texts need not look at their runs one by one.
    none = F.slice("runs", 1, 0)
    han = F.when(F.col("_han"), F.filter("runs", tx.has_han)).otherwise(none)
    plain = F.when(F.col("_han"), F.filter("runs", lambda r: ~tx.has_han(r))).otherwise(F.col("runs"))
    if lexicon is None:
        words = runs.select(*keep, F.explode(plain).alias("token"))
        return words.withColumn("pos", _run_class())
    pieces = F.flatten(F.transform(
        han, lambda r: F.flatten(F.array(*[tx.grams(r, n) for n in GRAM_LENGTHS]))
    ))
    candidates = runs.select(*keep, F.explode(F.array_union(plain, pieces)).alias("token"))
    known = lexicon.groupBy("token").agg(F.min("pos").alias("lex"))
    joined = candidates.join(checked_broadcast(known), "token", "left")
    return joined.where(F.col("lex").isNotNull() | ~tx.has_han(F.col("token"))).select(
        *keep, "token", F.coalesce("lex", _run_class()).alias("pos")
    )


def _run_class():
    return F.when(F.rlike("token", F.lit(r"^\p{N}+$")), NUMBER_CLASS).otherwise(RUN_CLASS)


def filter_tokens(
    tokens: DataFrame,
    stop: DataFrame | None = None,
    classes: tuple[str, ...] = NOUN_CLASSES,
    min_length: int = MIN_LENGTH,
) -> DataFrame:
    """Tokens of the allowed classes and length that are no stop words.

    The default stop list is fixed and part of the plan; a table given instead
    is joined, broadcast only if its counted size allows.
    """
    kept = tokens.where((F.char_length("token") >= min_length) & F.col("pos").isin(*classes))
    if stop is None:
        return kept.where(~F.col("token").isin(*STOP_WORDS))
    words = checked_broadcast(stop.select(F.col("word").alias("token")).distinct())
    return kept.join(words, "token", "left_anti")


def doc_freq(tokens: DataFrame) -> DataFrame:
    """(token, doc_freq); ``tokens`` holds each token of a document once."""
    return tokens.groupBy("token").agg(F.count("*").alias("doc_freq"))


def keyword_idf(frequencies: DataFrame, docs: DataFrame) -> DataFrame:
    """(token, doc_freq, idf) of words in at least two and at most half of ``docs``."""
    n = docs.agg(F.count("*")).scalar()
    df = F.col("doc_freq")
    return frequencies.where((df >= 2) & (df <= n * F.lit(MAX_SHARE))).select(
        "token", "doc_freq", F.round(F.log(n / df), 4).alias("idf")
    )


def extract_keywords(
    docs: DataFrame, lexicon: DataFrame | None = None, stop: DataFrame | None = None,
    text: str = "content",
) -> DataFrame:
    """The keyword table of a corpus of one text per row."""
    texts = docs.select(text)
    return keyword_idf(doc_freq(filter_tokens(tokenize(texts, lexicon, text), stop)), texts)
