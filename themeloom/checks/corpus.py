"""Summaries, quality, keywords and embeddings on documents, conversations and benchmark."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from themeloom.checks.base import Registry, code, code_sql, table
from themeloom.functions.stopwords import STOP_WORDS
from themeloom.operators import corpus, embed, quality
from themeloom.plans import jobs
from themeloom.session import scratch_path
from themeloom.sources import tables
from themeloom.sources.files import write_files
from themeloom.sources.summaries import read_summaries

R = Registry()
QUERIES, ORACLE = R.queries, R.oracle
DIM = 64
DOC = code_sql("doc_id")


def summaries(spark: SparkSession, sf: str) -> DataFrame:
    """(file_name, content): a summary per document.

    The language decides the shape: de has a title and sections, es no code in
    its file name but a heading, fr neither, and the rest the plain text.
    """
    lang = F.col("lang")
    key = code("doc_id")
    stem = (
        F.when(lang == "es", F.concat(F.lit("_es_"), "doc_id"))
        .when(lang == "fr", F.concat(F.lit("_"), "doc_id"))
        .otherwise(F.concat_ws("_", key, lang, F.col("doc_id").cast("string")))
    )
    heading = F.concat(F.lit("# "), key, F.lit("  name of "), "doc_id", F.lit(" \n"))
    content = (
        F.when(lang == "de", F.concat(heading, F.lit("## 所属板块\n"), "text", F.lit("\n## 主营业务\n## 题材标签\n")))
        .when(lang == "es", F.concat(F.lit("\n"), heading, "text"))
        .when(F.col("source") == "src7", F.lit(" \n　"))
        .when(F.col("source") == "src8", F.lit("too short"))
        .otherwise(F.col("text"))
    )
    return table(spark, sf, "documents").select(F.concat(stem, F.lit(".md")).alias("file_name"), content.alias("content"))


SUMMARIES = f"""summaries AS (
  SELECT doc_id, lang, source, text, CASE lang WHEN 'es' THEN '_es_' || doc_id WHEN 'fr' THEN '_' || doc_id
      ELSE {DOC} || '_' || lang || '_' || doc_id END || '.md' AS file_name,
    CASE WHEN lang = 'de' THEN '# ' || {DOC} || '  name of ' || doc_id || ' ' || chr(10) || '## 所属板块'
           || chr(10) || text || chr(10) || '## 主营业务' || chr(10) || '## 题材标签' || chr(10)
         WHEN lang = 'es' THEN chr(10) || '# ' || {DOC} || '  name of ' || doc_id || ' ' || chr(10) || text
         WHEN source = 'src7' THEN ' ' || chr(10) || '　'
         WHEN source = 'src8' THEN 'too short' ELSE text END AS content
  FROM documents)"""
BLANKS = "chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' ' || chr(160) || chr(12288)"
PARSED = f"""parsed AS (
  SELECT doc_id, file_name AS path, {DOC} AS code,
    CASE WHEN lang = 'es' THEN 'name of ' || doc_id ELSE lang || '_' || doc_id END AS name,
    trim(content, {BLANKS}) AS content
  FROM summaries WHERE trim(content, {BLANKS}) <> '' AND (lang <> 'fr' OR regexp_matches(
    content, '(?m)^#\\s+(\\d{{6}})\\s+(.+)')))"""


def _land(spark, sf) -> str:
    folder = scratch_path(spark, "summaries")
    write_files(summaries(spark, sf).withColumnRenamed("file_name", "name"), folder)
    return folder


@R.add("s2_read_summaries", f"WITH {SUMMARIES} SELECT file_name, content FROM summaries")
def read_back_summaries(spark, sf):
    return read_summaries(spark, _land(spark, sf))


@R.add("p12_parse_summary", f"WITH {SUMMARIES}, {PARSED} SELECT path, code, name, content FROM parsed")
def parse_summary(spark, sf):
    return corpus.parse_summary(summaries(spark, sf))


def issues_sql(title: str, title_issue: str, sections: tuple, shortest: int) -> str:
    missing = ", ".join(
        f"CASE WHEN NOT contains(content, '## {s}') THEN '缺少必需章节: ## {s}' END" for s in sections
    )
    return f"""issues AS (
      SELECT file_name, CASE WHEN trim(content, {BLANKS}) = '' THEN '文件内容为空' ELSE concat_ws('|',
        CASE WHEN NOT regexp_matches(content, '{title}') THEN '{title_issue}' END, {missing},
        CASE WHEN length(content) < {shortest} THEN '内容过短，可能数据不完整' END) END AS issues
      FROM summaries)"""


LEGACY = issues_sql(
    r"(?m)^#\s+\d{6}\s+", quality.NO_TITLE.replace("'", "''"), quality.LEGACY.sections, 50
)


@R.add("p13_validate_summaries", f"WITH {SUMMARIES}, {LEGACY} SELECT file_name, issues FROM issues")
def validate_summaries(spark, sf):
    found = quality.validate_summaries(summaries(spark, sf))
    return found.withColumn("issues", F.array_join("issues", "|"))


@R.add("p13_validate_current", f"""WITH {SUMMARIES}
    SELECT file_name, CASE WHEN trim(content, {BLANKS}) = '' THEN '文件内容为空' ELSE concat_ws('|',
      CASE WHEN NOT regexp_matches(content, '(?m)^#\\s+.+\\(\\d{{6}}\\)') THEN '{quality.NO_NEW_TITLE.replace("'", "''")}' END,
      CASE WHEN NOT regexp_matches(content, '(?m)^#\\s+.+\\(\\d{{6}}\\)\\s*\\n\\s*[^#\\s]') THEN '{quality.NO_INTRO}' END,
      CASE WHEN NOT contains(content, '## 核心题材') THEN '缺少必需章节: ## 核心题材' END,
      CASE WHEN NOT contains(content, '## 业务亮点') THEN '缺少必需章节: ## 业务亮点' END,
      CASE WHEN length(content) < 200 THEN '{quality.SHORT}' END,
      CASE WHEN length(content) > 500 THEN '{quality.LONG}' END) END AS issues
    FROM summaries""")
def validate_current(spark, sf):
    found = quality.validate_summaries(summaries(spark, sf), quality.CURRENT)
    return found.withColumn("issues", F.array_join("issues", "|"))


REPORT = """SELECT count(*) AS total, count(*) FILTER (issues = '') AS passed,
    count(*) FILTER (issues <> '') AS failed FROM issues"""


@R.add("a3_validation_report", f"WITH {SUMMARIES}, {LEGACY} {REPORT}")
def validation_report(spark, sf):
    return quality.validation_report(quality.validate_summaries(summaries(spark, sf)))


@R.add("b8_job_validate", f"WITH {SUMMARIES}, {LEGACY} {REPORT}")
def job_validate(spark, sf):
    return jobs.job_validate(spark, _land(spark, sf))[0]


@R.add("b8_failing_files", f"WITH {SUMMARIES}, {LEGACY} SELECT file_name, issues FROM issues WHERE issues <> ''")
def failing_files(spark, sf):
    failing = jobs.job_validate(spark, _land(spark, sf))[1]
    return failing.withColumn("issues", F.array_join("issues", "|"))


# Statements: the lines of every conversation turn, some of them marked by role.

def statements(spark: SparkSession, sf: str) -> DataFrame:
    turns = table(spark, sf, "conversations")
    kinds = (
        F.when(F.col("turn") == 0, F.lit("公司澄清：不涉及该业务"))
        .when(F.col("turn") == 1, F.concat(F.lit("2025年Q3营收"), "conv_id", F.lit("亿元")))
        .when(F.col("turn") == 2, F.concat(F.lit("今日涨幅"), "conv_id", F.lit("%")))
        .when(F.col("turn") == 3, F.lit("融资融券"))
        .otherwise(F.lit(""))
    )
    return turns.select("conv_id", "turn", F.explode(F.array_append(F.split("text", "\n"), kinds)).alias("text"))


STATEMENTS = """statements AS (
  SELECT conv_id, turn, unnest(list_append(string_split(text, chr(10)), CASE turn
    WHEN 0 THEN '公司澄清：不涉及该业务' WHEN 1 THEN '2025年Q3营收' || conv_id || '亿元'
    WHEN 2 THEN '今日涨幅' || conv_id || '%' WHEN 3 THEN '融资融券' ELSE '' END)) AS text
  FROM conversations)"""
FLAGGED = rf"""flagged AS (
  SELECT *, CASE WHEN regexp_matches(text, '{"|".join(quality.DENIAL_WORDS)}') THEN 'denial'
    WHEN text LIKE '2025年Q3营收%亿元' THEN 'figure' WHEN text LIKE '今日涨幅%\%' ESCAPE '\' THEN 'price'
    WHEN text = '融资融券' THEN 'trading' ELSE '' END AS flags FROM statements)"""


@R.add("p14_flag_statements", f"""WITH {STATEMENTS}, {FLAGGED}
    SELECT conv_id, turn, text, flags, flags IN ('', 'trading') AS keep, flags = '' AS core FROM flagged""")
def flag_statements(spark, sf):
    return quality.flag_statements(statements(spark, sf)).withColumn("flags", F.array_join("flags", ","))


@R.add("p14_kept_statements", f"""WITH {STATEMENTS}, {FLAGGED}
    SELECT conv_id, turn, text, flags = '' AS core FROM flagged WHERE flags IN ('', 'trading')""")
def kept_statements(spark, sf):
    return quality.kept_statements(statements(spark, sf)).select("conv_id", "turn", "text", "core")


# Tokens and keywords.

def docs(spark, sf) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", F.col("text").alias("content"))


WORD = r"[\p{L}\p{N}]+"
TOKENS = rf"""tokens AS (
  SELECT doc_id, unnest(list_distinct(regexp_extract_all(text, '{WORD}'))) AS token FROM documents),
  classed AS (
    SELECT doc_id, token, CASE WHEN regexp_full_match(token, '\p{{N}}+') THEN 'm' ELSE 'eng' END AS pos
    FROM tokens)"""
KEYWORDS = """freq AS (
    SELECT token, count(*) AS doc_freq FROM classed WHERE pos = 'eng' AND length(token) >= 2 GROUP BY token),
  keywords AS (
    SELECT token, doc_freq, round(ln((SELECT count(*) FROM documents) / doc_freq), 4) AS idf FROM freq
    WHERE doc_freq >= 2 AND doc_freq <= 0.5 * (SELECT count(*) FROM documents))"""


@R.add("m3_tokenize", f"WITH {TOKENS} SELECT * FROM classed")
def tokenize(spark, sf):
    return corpus.tokenize(docs(spark, sf))


_LATIN = "abcdefghijklmnopqrstuvwxyz"
_HAN = "甲乙丙丁戊己庚辛壬癸子丑寅卯辰巳午未申酉戌亥天地人和"


def han_docs(spark, sf) -> DataFrame:
    """Part names spelled with Chinese characters, beside the brand."""
    return table(spark, sf, "part").select(
        F.col("p_partkey").alias("doc_id"),
        F.concat_ws(" ", F.translate("p_name", _LATIN + " ", _HAN), F.col("p_brand")).alias("content"),
    )


def han_lexicon(spark, sf) -> DataFrame:
    """Every word of the part names is a noun; brand numbers of one digit are listed too."""
    part = table(spark, sf, "part")
    words = part.select(F.explode(F.split("p_name", " ")).alias("w")).distinct()
    return words.select(
        F.translate("w", _LATIN, _HAN).alias("token"),
        F.when(F.length("w") > 4, "n").otherwise("v").alias("pos"),
    )


HAN_TOKENS = rf"""
  han AS (
    SELECT p_partkey AS doc_id, translate(p_name, '{_LATIN} ', '{_HAN}') AS run, p_brand FROM part),
  lexicon AS (
    SELECT DISTINCT translate(w, '{_LATIN}', '{_HAN}') AS token, CASE WHEN length(w) > 4 THEN 'n' ELSE 'v' END AS pos
    FROM (SELECT unnest(string_split(p_name, ' ')) AS w FROM part)),
  pieces AS (
    SELECT DISTINCT doc_id, substring(run, i, n) AS token
    FROM (SELECT doc_id, run, n, unnest(range(1, length(run) - n + 2)) AS i
          FROM han, (VALUES (2), (3), (4), (5), (6)) AS lengths(n))),
  classed AS (
    SELECT doc_id, token, pos FROM pieces JOIN lexicon USING (token)
    UNION ALL
    SELECT doc_id, token, CASE WHEN regexp_full_match(token, '\p{{N}}+') THEN 'm' ELSE 'eng' END FROM (
      SELECT doc_id, unnest(list_distinct(regexp_extract_all(p_brand, '{WORD}'))) AS token FROM han))"""


@R.add("m3_tokenize_chinese", f"WITH {HAN_TOKENS} SELECT * FROM classed")
def tokenize_chinese(spark, sf):
    return corpus.tokenize(han_docs(spark, sf), han_lexicon(spark, sf))


@R.add("j5_filter_tokens", f"""WITH {TOKENS}
    SELECT * FROM classed WHERE pos = 'eng' AND length(token) >= 2
      AND token NOT IN (SELECT unnest(regexp_extract_all(text, '{WORD}')) FROM benchmark)""")
def filter_tokens(spark, sf):
    stop = table(spark, sf, "benchmark").select(
        F.explode(F.regexp_extract_all("text", F.lit(WORD), F.lit(0))).alias("word")
    )
    return corpus.filter_tokens(corpus.tokenize(docs(spark, sf)), stop)


_STOPPED = ", ".join(f"'{w}'" for w in STOP_WORDS)


@R.add("j5_filter_tokens_chinese", f"""WITH {HAN_TOKENS}
    SELECT * FROM classed WHERE pos IN ('n', 'eng') AND length(token) >= 2 AND token NOT IN ({_STOPPED})""")
def filter_tokens_chinese(spark, sf):
    return corpus.filter_tokens(corpus.tokenize(han_docs(spark, sf), han_lexicon(spark, sf)))


@R.add("a6_doc_freq", f"WITH {TOKENS} SELECT token, count(*) AS doc_freq FROM tokens GROUP BY token")
def doc_freq(spark, sf):
    return corpus.doc_freq(corpus.tokenize(docs(spark, sf)))


@R.add("a7_keyword_idf", f"WITH {TOKENS}, {KEYWORDS} SELECT * FROM keywords")
def keyword_idf(spark, sf):
    return corpus.extract_keywords(docs(spark, sf))


# Embeddings.

def vector_sql(source: str, key: str, text: str, name: str, dim: int = DIM) -> str:
    """Non-zero vector entries (key, bucket, x) of a text table, as a CTE."""
    slot = f"('0x' || substr(md5(t), 1, 8))::BIGINT % {2 * dim}"
    return rf"""{name}_slots AS (
      SELECT {key} AS key, {slot} AS slot
      FROM (SELECT {key}, unnest(regexp_extract_all({text}, '{WORD}')) AS t FROM {source})),
    {name}_raw AS (
      SELECT key, CAST(slot % {dim} AS INTEGER) AS bucket, sum(CASE WHEN slot < {dim} THEN 1.0 ELSE -1.0 END)::DOUBLE AS c
      FROM {name}_slots GROUP BY ALL),
    {name} AS (
      SELECT key, bucket, c / sqrt(sum(c * c) OVER (PARTITION BY key)) AS x FROM {name}_raw WHERE c <> 0)"""


def _sparse(vectors: DataFrame, key: str) -> DataFrame:
    return vectors.select(key, F.posexplode_outer("embedding").alias("bucket", "x")).where("x <> 0").select(
        key, "bucket", F.round("x", 6).alias("x")
    )


@R.add("m1_embed_documents", f"""WITH {vector_sql('documents', 'doc_id', 'text', 'e')}
    SELECT key AS doc_id, bucket, round(x, 6) AS x FROM e""")
def embed_documents(spark, sf):
    return _sparse(embed.embed_documents(docs(spark, sf), DIM), "doc_id")


@R.add("m2_embed_keywords", f"""WITH {TOKENS}, {KEYWORDS.replace("keywords AS (", "keywords AS MATERIALIZED (")}, {vector_sql('keywords', 'token', 'token', 'e')},
    entries AS (
      SELECT key, string_agg(bucket || ':' || CAST(round(x * 1000000) AS BIGINT), ' ' ORDER BY bucket) AS entries
      FROM e GROUP BY key)
    SELECT token AS keyword, doc_freq, idf, coalesce(entries, '') AS entries
    FROM keywords LEFT JOIN entries ON token = key""")
def embed_keywords(spark, sf):
    """One row per keyword; its vector as text, in millionths."""
    rows = embed.embed_keywords(corpus.extract_keywords(docs(spark, sf)), DIM)
    placed = F.transform("embedding", lambda x, i: F.when(
        x != 0, F.concat(i.cast("string"), F.lit(":"), F.round(x * 1000000).cast("bigint").cast("string"))))
    return rows.select("keyword", "doc_freq", "idf", F.array_join(F.array_compact(placed), " ").alias("entries"))


@R.add("m2_embed_queries", f"""WITH {vector_sql('benchmark', 'item_id', 'text', 'e')}
    SELECT key AS query_id, bucket, round(x, 6) AS x FROM e""")
def embed_queries(spark, sf):
    asked = table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    return _sparse(embed.embed_queries(asked, DIM), "query_id")


def toy_model():
    """Three numbers per text: characters, words and lines."""
    def run(texts):
        return np.array([[len(t), len(t.split(" ")), t.count("\n") + 1] for t in texts], dtype=float)

    return run


@R.add("x1_embed_with", """
    WITH f AS (
      SELECT doc_id, length(text)::DOUBLE AS a, len(string_split(text, ' '))::DOUBLE AS b,
        len(string_split(text, chr(10)))::DOUBLE AS c FROM documents)
    SELECT doc_id, round(a / sqrt(a * a + b * b + c * c), 6) AS x, round(b / sqrt(a * a + b * b + c * c), 6) AS y,
      round(c / sqrt(a * a + b * b + c * c), 6) AS z FROM f""")
def embed_with(spark, sf):
    rows = embed.embed_with(docs(spark, sf), toy_model, 3)
    return rows.select("doc_id", *[
        F.round(F.get("embedding", F.lit(i)), 6).alias(c) for i, c in enumerate("xyz")
    ])


# Jobs.

@R.add("b2_job_rebuild", rf"""WITH {SUMMARIES}, {PARSED},
    tokens AS (SELECT doc_id, unnest(list_distinct(regexp_extract_all(content, '{WORD}'))) AS token FROM parsed),
    freq AS (
      SELECT token, count(*) AS df FROM tokens
      WHERE length(token) >= 2 AND NOT regexp_full_match(token, '\p{{N}}+')
        AND NOT regexp_matches(token, '[\x{{4e00}}-\x{{9fff}}]') GROUP BY token)
    SELECT 'documents' AS collection, count(*) AS n FROM parsed
    UNION ALL
    SELECT 'keywords', count(*) FROM freq
    WHERE df >= 2 AND df <= 0.5 * (SELECT count(*) FROM parsed)""")
def job_rebuild(spark, sf):
    return jobs.job_rebuild(spark, _land(spark, sf), scratch_path(spark, "store"), dim=DIM)


@R.add("b3_job_update", f"WITH {SUMMARIES}, {PARSED} SELECT code AS id, name AS stock_name, content AS document FROM parsed")
def job_update(spark, sf):
    store = scratch_path(spark, "store")
    first = scratch_path(spark, "first")
    # The first run sees the summaries with a source label, the second all of them.
    write_files(summaries(spark, sf).where(F.col("content").contains("##")).withColumnRenamed("file_name", "name"), first)
    jobs.job_update(spark, first, store, DIM)
    jobs.job_update(spark, _land(spark, sf), store, DIM)
    return tables.read_collection(spark, jobs.documents(store)).select("id", "stock_name", "document")


@R.add("b4_job_query_text", f"""
    WITH {vector_sql('documents', 'doc_id', 'text', 'e')}, {vector_sql('benchmark', 'item_id', 'text', 'q')},
    hits AS (
      SELECT item_id AS query_id, doc_id, 2.0 - 2.0 * coalesce(dot, 0.0) AS d
      FROM benchmark CROSS JOIN (SELECT DISTINCT key AS doc_id FROM e) LEFT JOIN (
        SELECT q.key AS item_id, e.key AS doc_id, sum(q.x * e.x) AS dot
        FROM q JOIN e USING (bucket) GROUP BY ALL) USING (item_id, doc_id)),
    numbered AS (
      SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d, doc_id) AS rn FROM hits)
    SELECT query_id, CAST(rn AS INTEGER) AS rank, round(1.0 / (1.0 + d), 4) AS score,
      abs(round(d, 4)) AS distance FROM numbered WHERE rn <= 5""")
def job_query_text(spark, sf):
    store = scratch_path(spark, "store")
    rows = embed.embed_documents(docs(spark, sf), DIM)
    tables.write_collection(
        rows.select(F.lpad(F.col("doc_id").cast("string"), 12, "0").alias("id"),
                    F.lit("").alias("stock_name"), F.col("content").alias("document"), "embedding"),
        jobs.documents(store),
    )
    asked = table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    found = jobs.job_query_text(spark, asked, store, 5, DIM)
    # Copies of a document tie, so the names of the hits are left out.
    return found.select("query_id", "rank", "score", "distance")
