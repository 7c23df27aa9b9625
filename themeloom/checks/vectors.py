"""Search, clusters and themes on the embeddings table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from themeloom.checks.base import Registry, code, code_sql, table
from themeloom.operators import approx, clusters, search, themes
from themeloom.session import scratch_path
from themeloom.sources import tables

R = Registry()
QUERIES, ORACLE = R.queries, R.oracle


def doc_vectors(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select(
        code("vec_id").alias("id"),
        F.concat(F.lit("S"), "vec_id").alias("stock_name"),
        F.col("embedding").cast("array<double>").alias("embedding"),
        F.col("label").alias("cluster_id"),
    )


def kw_vectors(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select(
        F.concat(F.lit("kw"), "vec_id").alias("keyword"),
        F.col("label").cast("bigint").alias("doc_freq"),
        F.col("embedding").cast("array<double>").alias("embedding"),
    )


DOC = f"""doc AS (
  SELECT vec_id, {code_sql('vec_id')} AS id, 'S' || vec_id AS stock_name,
         CAST(embedding AS DOUBLE[]) AS v, label AS cluster_id
  FROM embeddings)"""
KW = """kw AS (
  SELECT 'kw' || vec_id AS keyword, CAST(label AS BIGINT) AS doc_freq,
         CAST(embedding AS DOUBLE[]) AS v
  FROM embeddings)"""
CENTERS = """centers AS (
  SELECT cluster_id, list(m ORDER BY p) AS v FROM (
    SELECT cluster_id, p, avg(x) AS m
    FROM (SELECT cluster_id, unnest(v) AS x, unnest(range(1, len(v) + 1)) AS p FROM doc)
    GROUP BY cluster_id, p)
  GROUP BY cluster_id)"""


def gap_sql(a: str, b: str) -> str:
    return (
        f"list_sum(list_transform(range(1, len({a}) + 1), "
        f"lambda i: ({a}[i] - {b}[i]) * ({a}[i] - {b}[i])))"
    )


def cos_sql(a: str, b: str) -> str:
    def d(x, y):
        return f"list_sum(list_transform(range(1, len({a}) + 1), lambda i: {x}[i] * {y}[i]))"

    return f"({d(a, b)} / (sqrt({d(a, a)}) * sqrt({d(b, b)}) + 1e-8))"


def topk_sql(distance: str, k: int, self_too: bool = True) -> str:
    return f"""WITH {DOC}, hits AS (
      SELECT q.vec_id AS query_id, d.id, d.stock_name, {distance} AS d
      FROM doc q, doc d {'' if self_too else 'WHERE q.id <> d.id'}),
    numbered AS (
      SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d, id) AS rn FROM hits)
    SELECT query_id, CAST(rn AS INTEGER) AS rank, id AS code, stock_name AS name,
           round(1.0 / (1.0 + d), 4) AS score, round(d, 4) + 0.0 AS distance
    FROM numbered WHERE rn <= {k}"""


def _all_queries(spark, sf):
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("query_id"), "embedding")


def _topk(metric):
    # Tiny negative distances of a vector to itself would print as minus zero.
    def run(spark, sf):
        hits = search.topk(_all_queries(spark, sf), doc_vectors(spark, sf), 10, metric)
        return hits.withColumn("distance", F.col("distance") + F.lit(0.0))

    return run


R.add("t1_topk", topk_sql(gap_sql("q.v", "d.v"), 10))(_topk("l2sq"))


@R.add("t1_topk_rounds", topk_sql(gap_sql("q.v", "d.v"), 10))
def topk_rounds(spark, sf):
    """The same with queries and rows compared block by block, as too many to send."""
    return search.topk(_all_queries(spark, sf), doc_vectors(spark, sf), 10, query_bytes=1)


R.add("t1_topk_l2", topk_sql(f"sqrt({gap_sql('q.v', 'd.v')})", 10))(_topk("l2"))
R.add("t1_topk_cosine", topk_sql(f"1.0 - {cos_sql('q.v', 'd.v')}", 10))(_topk("cosine"))


@R.add("t1_nearest_to_vector", f"""WITH {DOC}, hits AS (
      SELECT id, stock_name, list_sum(list_transform(v, lambda x: (x - 0.125) * (x - 0.125))) AS d
      FROM doc)
    SELECT CAST(row_number() OVER (ORDER BY d, id) AS INTEGER) AS rank, id AS code,
           stock_name AS name, round(1.0 / (1.0 + d), 4) AS score, round(d, 4) AS distance
    FROM hits ORDER BY d, id LIMIT 10""")
def nearest_to_vector(spark, sf):
    return search.nearest_to_vector(doc_vectors(spark, sf), [0.125] * 64, 10)


@R.add("t2_similar_to", f"""WITH {DOC}, hits AS (
      SELECT q.id AS query_id, d.id, d.stock_name, {gap_sql('q.v', 'd.v')} AS d
      FROM doc q, doc d WHERE q.id <> d.id),
    numbered AS (
      SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d, id) AS rn FROM hits)
    SELECT query_id, CAST(rn AS INTEGER) AS rank, id AS code, stock_name AS name,
           round(1.0 / (1.0 + d), 4) AS score, round(d, 4) AS distance
    FROM numbered WHERE rn <= 10""")
def similar_to(spark, sf):
    docs = doc_vectors(spark, sf)
    return search.similar_to(docs, docs.select("id"), 10)


@R.add("t2_similar_to_id", f"""WITH {DOC}, hits AS (
      SELECT d.id, d.stock_name, {gap_sql('q.v', 'd.v')} AS d
      FROM doc q, doc d WHERE q.vec_id = 7 AND d.vec_id <> 7)
    SELECT CAST(row_number() OVER (ORDER BY d, id) AS INTEGER) AS rank, id AS code,
           stock_name AS name, round(1.0 / (1.0 + d), 4) AS score, round(d, 4) AS distance
    FROM hits ORDER BY d, id LIMIT 10""")
def similar_to_id(spark, sf):
    return search.similar_to_id(doc_vectors(spark, sf), "055446", 10)


TOP_KEYWORDS = f"""hits AS (
      SELECT c.cluster_id, k.keyword, k.doc_freq, {gap_sql('c.v', 'k.v')} AS d
      FROM centers c, kw k),
    named AS (
      SELECT cluster_id, CAST(row_number() OVER (PARTITION BY cluster_id ORDER BY d, keyword)
             AS INTEGER) AS rank, keyword, round(1.0 / (1.0 + d), 4) AS score, doc_freq
      FROM hits QUALIFY rank <= 5)"""


@R.add("t3_topk_keywords", f"WITH {DOC}, {KW}, {CENTERS}, {TOP_KEYWORDS} SELECT * FROM named")
def topk_keywords(spark, sf):
    centers = clusters.centroids(doc_vectors(spark, sf), "cluster_id")
    return search.topk_keywords(centers, kw_vectors(spark, sf), 5)


@R.add("t6_approx_topk")
def approx_topk(spark, sf):
    index = approx.build_index(doc_vectors(spark, sf).drop("cluster_id"))
    return approx.approx_topk(_all_queries(spark, sf), index, 10)


@R.add("t6_recall", "SELECT true AS reached")
def approx_recall(spark, sf):
    rows, asked = doc_vectors(spark, sf).drop("cluster_id"), _all_queries(spark, sf)
    found = approx.approx_topk(asked, approx.build_index(rows), 10)
    return approx.recall(found, search.topk(asked, rows, 10)).select((F.col("recall") >= 0.9).alias("reached"))


@R.add("t6_approx_topk_every_list", topk_sql(gap_sql("q.v", "d.v"), 10))
def approx_topk_every_list(spark, sf):
    index = approx.build_index(doc_vectors(spark, sf).drop("cluster_id"), n_lists=8)
    return approx.approx_topk(_all_queries(spark, sf), index, 10, probes=index.model.lists, rerank=index.size)


PAIRS = f"""pairs AS (
  SELECT a.id AS id_a, b.id AS id_b, round({cos_sql('a.v', 'b.v')}, 4) AS cosine
  FROM lineitem l JOIN doc a ON a.vec_id = l.l_orderkey JOIN doc b ON b.vec_id = l.l_partkey)"""


def _pairs(spark, sf):
    return table(spark, sf, "lineitem").select(
        code("l_orderkey").alias("id_a"), code("l_partkey").alias("id_b")
    )


@R.add("t7_score_pairs", f"WITH {DOC}, {PAIRS} SELECT * FROM pairs")
def score_pairs(spark, sf):
    return search.score_pairs(_pairs(spark, sf), doc_vectors(spark, sf))


@R.add("w2_ranked", f"""WITH {DOC}, hits AS (
      SELECT q.vec_id AS query_id, d.id, {cos_sql('q.v', 'd.v')} AS c FROM doc q, doc d),
    best AS (
      SELECT * FROM hits QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY 1.0 - c, id) <= 5)
    SELECT query_id, id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY id) AS INTEGER) AS rank
    FROM best""")
def ranked(spark, sf):
    hits = search.nearest(_all_queries(spark, sf), doc_vectors(spark, sf), 5, "cosine").drop("rank")
    return search.ranked(hits, ["id"]).select("query_id", "id", "rank")


@R.add("j4_get_by_ids", f"""WITH {DOC}
    SELECT id, stock_name, cluster_id FROM doc
    WHERE vec_id IN (SELECT doc_id FROM labels)""")
def get_by_ids(spark, sf):
    pool = table(spark, sf, "labels").select(code("doc_id").alias("id"))
    return search.get_by_ids(doc_vectors(spark, sf), pool).select("id", "stock_name", "cluster_id")


def _flat(centers: DataFrame) -> DataFrame:
    return centers.select("cluster_id", F.posexplode_outer("embedding").alias("pos", "x")).select(
        "cluster_id", "pos", (F.round("x", 6) + F.lit(0.0)).alias("mean")
    )


FLAT = """SELECT cluster_id, CAST(unnest(range(len(v))) AS INTEGER) AS pos,
    unnest(list_transform(v, lambda x: round(x, 6) + 0.0)) AS mean FROM"""


@R.add("a8_centroid", f"WITH {DOC}, {CENTERS} {FLAT} centers")
def centroid(spark, sf):
    return _flat(clusters.centroids(doc_vectors(spark, sf), "cluster_id"))


@R.add("a8_centroid_of_pool", f"""WITH {DOC.replace('label AS', '0 AS')}, {CENTERS} {FLAT} centers""")
def centroid_of_pool(spark, sf):
    return _flat(clusters.centroids(doc_vectors(spark, sf)))


@R.add("a9_cluster_sizes", "SELECT label AS cluster_id, count(*) AS size FROM embeddings GROUP BY label")
def cluster_sizes(spark, sf):
    return clusters.cluster_sizes(doc_vectors(spark, sf))


REPS = f"""reps AS (
  SELECT d.cluster_id, d.id AS rep_code, d.stock_name AS rep_name
  FROM doc d JOIN centers c USING (cluster_id)
  QUALIFY row_number() OVER (
    PARTITION BY d.cluster_id ORDER BY sqrt({gap_sql('d.v', 'c.v')}), d.id) = 1)"""


@R.add("w1_representatives", f"WITH {DOC}, {CENTERS}, {REPS} SELECT * FROM reps")
def representatives(spark, sf):
    docs = doc_vectors(spark, sf)
    return clusters.representatives(docs, clusters.centroids(docs, "cluster_id"))


ASSIGNED = f"""assigned AS (
  SELECT d.id, c.cluster_id, d.v FROM doc d, centers c
  QUALIFY row_number() OVER (PARTITION BY d.id ORDER BY {gap_sql('d.v', 'c.v')}, c.cluster_id) = 1)"""


@R.add("m4a_assign", f"WITH {DOC}, {CENTERS}, {ASSIGNED} SELECT id, cluster_id FROM assigned")
def assign(spark, sf):
    docs = doc_vectors(spark, sf)
    centers = clusters.centroids(docs, "cluster_id")
    return clusters.assign(docs.drop("cluster_id"), centers).select("id", "cluster_id")


@R.add("m4a_update", f"""WITH {DOC}, {CENTERS}, {ASSIGNED},
    again AS ({CENTERS.split('AS (', 1)[1].rsplit(')', 1)[0].replace('FROM doc', 'FROM assigned')})
    {FLAT} again""")
def update(spark, sf):
    docs = doc_vectors(spark, sf)
    moved = clusters.assign(docs.drop("cluster_id"), clusters.centroids(docs, "cluster_id"))
    return _flat(clusters.update(moved))


@R.add("m5_label_themes", f"""WITH {DOC}, {KW}, {CENTERS}, {TOP_KEYWORDS},
    sizes AS (SELECT cluster_id, count(*) AS size FROM doc GROUP BY cluster_id),
    first AS (
      SELECT cluster_id, string_agg(id || stock_name, ', ' ORDER BY id) AS members FROM (
        SELECT * FROM doc QUALIFY row_number() OVER (PARTITION BY cluster_id ORDER BY id) <= 8)
      GROUP BY cluster_id),
    heads AS (
      SELECT cluster_id, string_agg(keyword, '、' ORDER BY rank) AS headline,
             string_agg(keyword || ':' || doc_freq, ';' ORDER BY rank) AS keywords
      FROM named GROUP BY cluster_id)
    SELECT cluster_id, size, headline,
           members || CASE WHEN size > 8 THEN '...' ELSE '' END AS preview, keywords
    FROM sizes JOIN first USING (cluster_id) JOIN heads USING (cluster_id)""")
def label_themes(spark, sf):
    named = themes.label_themes(doc_vectors(spark, sf), kw_vectors(spark, sf), 5)
    return _themes_flat(named)


def _themes_flat(named):
    words = F.transform("keywords", lambda k: F.concat(k["keyword"], F.lit(":"), k["doc_freq"]))
    return named.withColumn("keywords", F.array_join(words, ";"))


@R.add("m6_cluster_table", f"""WITH {DOC}, {CENTERS}, {REPS}
    SELECT cluster_id, size, rep_code, rep_name FROM reps
    JOIN (SELECT cluster_id, count(*) AS size FROM doc GROUP BY cluster_id) USING (cluster_id)""")
def cluster_table(spark, sf):
    docs = doc_vectors(spark, sf)
    return clusters.cluster_table(docs, clusters.centroids(docs, "cluster_id"))


def _pool(spark, sf):
    return doc_vectors(spark, sf).drop("cluster_id")


@R.add("m4_kmeans")
def kmeans(spark, sf):
    return clusters.kmeans(_pool(spark, sf), 10).labels


@R.add("m5_label_members", f"WITH {DOC} SELECT cluster_id, id AS code, stock_name AS name FROM doc")
def label_members(spark, sf):
    return themes.members(doc_vectors(spark, sf))


WHOLE = f"""WITH {DOC} SELECT count(*) AS n_rows, count(DISTINCT id) AS n_ids, true AS few_clusters FROM doc"""


def _whole(members, k):
    return members.agg(
        F.count("*").alias("n_rows"), F.count_distinct("code").alias("n_ids"),
        (F.count_distinct("cluster_id") <= k).alias("few_clusters"))


@R.add("m4_kmeans_whole", WHOLE)
def kmeans_whole(spark, sf):
    return _whole(clusters.kmeans(_pool(spark, sf), 10, starts=2).members, 10)


@R.add("m5_theme_members", WHOLE)
def theme_members(spark, sf):
    docs = _pool(spark, sf)
    return _whole(themes.analyze_with_members(docs.select("id"), docs, kw_vectors(spark, sf), 5, 10)[1], 5)


@R.add("m5_analyze_themes")
def analyze_themes(spark, sf):
    docs = _pool(spark, sf)
    return _themes_flat(themes.analyze_themes(docs.select("id"), docs, kw_vectors(spark, sf), 5, 10))


@R.add("m6_cluster_pool")
def cluster_pool(spark, sf):
    docs = _pool(spark, sf)
    return themes.cluster_pool(docs.select("id"), docs, 5).clusters


@R.add("s7_write_collection", f"""WITH {DOC}
    SELECT id, stock_name FROM doc
    UNION ALL
    SELECT code, name FROM (SELECT DISTINCT {code_sql('p_partkey')} AS code, p_name AS name FROM part)
    WHERE code NOT IN (SELECT id FROM doc)""")
def write_collection(spark, sf):
    path = scratch_path(spark, "collection")
    # Both writes hold every row twice; one per id stays.
    docs = _pool(spark, sf).withColumn("path", F.col("stock_name"))
    tables.write_collection(docs.unionByName(docs), path, order="path")
    parts = table(spark, sf, "part").select(
        code("p_partkey").alias("id"), F.col("p_name").alias("stock_name"),
        F.array().cast("array<double>").alias("embedding"), F.col("p_name").alias("path"),
    )
    tables.write_collection(parts.unionByName(parts), path, mode="append", order="path")
    return tables.read_collection(spark, path).select("id", "stock_name")


@R.add("s8_collection_stats", """SELECT 'documents' AS collection, count(*) AS n FROM embeddings
    UNION ALL SELECT 'keywords', 0""")
def collection_stats(spark, sf):
    path = scratch_path(spark, "collection")
    tables.write_collection(_pool(spark, sf), path)
    return tables.collection_stats(spark, path, scratch_path(spark, "none"))
