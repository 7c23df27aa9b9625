"""Naming the themes of a pool of stocks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from themeloom.operators.clusters import Clustering, centroids, kmeans, single_cluster
from themeloom.operators.search import get_by_ids, topk_keywords
from themeloom.session import materialize

# Pool size per cluster, and lengths of the headline and preview.
STOCKS_PER_CLUSTER = 3
HEADLINE_WORDS = 5
PREVIEW_MEMBERS = 8


def theme_count(n: int, k: int) -> int:
    return max(1, min(k, max(1, n // STOCKS_PER_CLUSTER)))


def theme_table(
    labelled: DataFrame, centers: DataFrame, keywords: DataFrame, top: int = 10, metric: str = "l2sq"
) -> DataFrame:
    """(cluster_id, size, headline, preview, keywords), largest cluster first.

    ``keywords`` is an array of (rank, keyword, score, doc_freq) with ``top``
    entries at most.  Of the members only the first eight are gathered, for the
    preview; the full membership is the labelled table itself.
    """
    sizes = labelled.groupBy("cluster_id").agg(F.count("*").alias("size"))
    by_id = Window.partitionBy("cluster_id").orderBy("id")
    preview = (
        labelled.withColumn("rn", F.row_number().over(by_id)).where(F.col("rn") <= PREVIEW_MEMBERS)
        .groupBy("cluster_id")
        .agg(F.array_sort(F.collect_list(
            F.struct("rn", F.concat("id", "stock_name").alias("label"))
        )).alias("first"))
    )
    named = (
        topk_keywords(centers, keywords, top, metric)
        .groupBy("cluster_id")
        .agg(F.array_sort(F.collect_list(F.struct("rank", "keyword", "score", "doc_freq"))).alias("keywords"))
    )
    return (
        sizes.join(preview, "cluster_id").join(named, "cluster_id", "left")
        .select(
            "cluster_id", "size",
            F.array_join(F.slice(F.col("keywords.keyword"), 1, HEADLINE_WORDS), "、").alias("headline"),
            F.concat(
                F.array_join(F.col("first.label"), ", "),
                F.when(F.col("size") > PREVIEW_MEMBERS, "...").otherwise(""),
            ).alias("preview"),
            "keywords",
        )
        .orderBy(F.desc("size"), "cluster_id")
    )


def label_themes(labelled: DataFrame, keywords: DataFrame, top: int = 10) -> DataFrame:
    """The theme table of vectors whose clusters are given."""
    return theme_table(labelled, centroids(labelled, "cluster_id"), keywords, top)


def cluster_pool(pool, collection: DataFrame, k: int = 3) -> Clustering:
    """Cluster the stored vectors of a pool of ids (a table or a list)."""
    return kmeans(_pool_vectors(pool, collection), k)


def _pool_vectors(pool, collection: DataFrame) -> DataFrame:
    """The vectors of a pool as a table of its own, since many jobs read them."""
    return materialize(get_by_ids(collection, pool).select("id", "stock_name", "embedding"), "pool")


def analyze_themes(
    pool, collection: DataFrame, keywords: DataFrame, k: int = 5, top: int = 10
) -> DataFrame:
    """Cluster a pool and name each cluster by the keywords nearest to its centroid.

    The number of clusters is at most a third of the pool.
    """
    return analyze_with_members(pool, collection, keywords, k, top)[0]


def analyze_with_members(
    pool, collection: DataFrame, keywords: DataFrame, k: int = 5, top: int = 10
) -> tuple[DataFrame, DataFrame]:
    """The theme table, and (cluster_id, code, name) of every stock of every theme."""
    vectors = _pool_vectors(pool, collection)
    parts = theme_count(vectors.count(), k)
    result = single_cluster(vectors) if parts == 1 else kmeans(vectors, parts)
    return theme_table(result.labelled, result.centers, keywords, top), members(result.labelled)


def members(labelled: DataFrame) -> DataFrame:
    """(cluster_id, code, name) of labelled vectors."""
    return labelled.select("cluster_id", F.col("id").alias("code"), F.col("stock_name").alias("name"))
