"""Vectors for documents, keywords and query texts."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.ml.feature import CountVectorizerModel, Normalizer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from themeloom.functions import text as tx
from themeloom.operators.scale import spread
from themeloom.schemas import VECTOR

DIM = 512


def _features(text):
    """Words as they are, Chinese runs as character pairs; repeats count."""
    found = tx.words(text)
    return F.when(tx.has_han(text), F.flatten(F.transform(
        found,
        lambda r: F.when(tx.has_han(r) & (F.char_length(r) > 1), tx.grams(r, 2))
        .otherwise(F.array(r)),
    ))).otherwise(found)


def _slot(token, dim: int):
    """A fixed pseudo-random number below ``2 * dim``: bucket and sign in one."""
    return F.conv(F.substring(F.md5(token.cast("binary")), 1, 8), 16, 10).cast("bigint") % (2 * dim)


def embed_documents(df: DataFrame, dim: int = DIM, text: str = "content") -> DataFrame:
    """Add ``embedding``: signed feature hashing of term counts, length one.

    A feature adds one to its bucket or takes one off, by its slot.  The text is
    turned into a vector inside its own row, so the corpus is not shuffled.  A
    text without features gets the zero vector.
    """
    spark = df.sparkSession
    counter = CountVectorizerModel.from_vocabulary(
        [str(i) for i in range(2 * dim)], inputCol="_slots", outputCol="_counts"
    )
    slots = F.transform(_features(F.col(text)), lambda t: _slot(t, dim).cast("string"))
    counted = counter.transform(spread(df).withColumn("_slots", F.coalesce(slots, F.array().cast("array<string>"))))
    dense = counted.withColumn("_c", vector_to_array("_counts"))
    signed = dense.withColumn("_raw", array_to_vector(F.zip_with(
        F.slice("_c", 1, dim), F.slice("_c", dim + 1, dim), lambda plus, minus: plus - minus
    )))
    scaled = Normalizer(p=2.0, inputCol="_raw", outputCol="_unit").transform(signed)
    return scaled.select(*df.columns, vector_to_array("_unit").alias("embedding"))


def embed_keywords(keywords: DataFrame, dim: int = DIM) -> DataFrame:
    """(keyword, doc_freq, idf, embedding) from a keyword table."""
    named = keywords.withColumnRenamed("token", "keyword")
    return embed_documents(named, dim, text="keyword").select(
        "keyword", "doc_freq", "idf", "embedding"
    )


def embed_queries(queries: DataFrame, dim: int = DIM, text: str = "text") -> DataFrame:
    """(query_id, embedding) from query texts."""
    return embed_documents(queries, dim, text).select("query_id", "embedding")


def embed_with(
    df: DataFrame,
    load: Callable[[], Callable[[Sequence[str]], np.ndarray]],
    dim: int,
    text: str = "content",
    batch_size: int = 32,
) -> DataFrame:
    """Add ``embedding`` from a model of the user's.

    ``load`` runs once per task and returns a function from texts to a matrix of
    ``dim`` columns.  Rows are scaled to length one; a matrix of another shape
    is an error.
    """
    schema = T.StructType(df.schema.fields + [T.StructField("embedding", VECTOR)])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = load()
        for batch in batches:
            texts = batch[text].fillna("").tolist()
            parts = []
            for start in range(0, len(texts), batch_size):
                piece = texts[start:start + batch_size]
                matrix = np.asarray(model(piece), dtype="float64")
                if matrix.shape != (len(piece), dim):
                    raise ValueError(f"model gave {matrix.shape}, expected {(len(piece), dim)}")
                parts.append(matrix)
            if not parts:
                yield batch.assign(embedding=pd.Series([], dtype=object))
                continue
            whole = np.vstack(parts)
            length = np.linalg.norm(whole, axis=1, keepdims=True)
            whole = np.divide(whole, length, out=np.zeros_like(whole), where=length > 0)
            yield batch.assign(embedding=list(whole))

    return spread(df).mapInPandas(run, schema)
