"""Universe, quotes, pages, concepts and drafts from part, supplier and customer."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from themeloom.checks.base import Registry, code, code_sql, joined_map, table
from themeloom.operators import concepts, merge, quotes, universe
from themeloom.plans import jobs
from themeloom.session import scratch_path
from themeloom.sources import tables
from themeloom.sources.drafts import conform_draft, read_drafts
from themeloom.sources.files import write_files

R = Registry()
QUERIES, ORACLE = R.queries, R.oracle

AT = "2024-01-31T00:00:00.000000"


def when():
    return F.lit("2024-01-31 00:00:00").cast("timestamp")


PART = code_sql("p_partkey")


def stocks(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").select(
        code("p_partkey").alias("code"), F.col("p_name").alias("name"), F.col("p_partkey").alias("pos")
    )


# Universe.

@R.add("p1_normalize_universe", f"""
    SELECT {PART} AS code, p_name AS name, p_partkey AS pos FROM part
    WHERE p_size <> 1 AND p_type <> 'PROMO'""")
def normalize_universe(spark, sf):
    raw = table(spark, sf, "part").select(
        F.when(F.col("p_type") == "PROMO", F.lit("　"))
        .otherwise(F.concat(F.lit(" \t"), code("p_partkey"), F.lit("　"))).alias("代码"),
        F.when(F.col("p_size") == 1, F.lit(" \n")).otherwise(F.concat("p_name", F.lit("\xa0"))).alias("名称"),
        F.col("p_partkey").alias("pos"),
    )
    return universe.normalize_universe(raw)


@R.add("p2_with_market", f"""
    SELECT {PART} AS code, CASE left({PART}, 1) WHEN '6' THEN 'SH' WHEN '0' THEN 'SZ'
      WHEN '3' THEN 'SZ' WHEN '4' THEN 'BJ' WHEN '8' THEN 'BJ' ELSE 'OTHER' END AS market FROM part""")
def with_market(spark, sf):
    return universe.with_market(stocks(spark, sf)).select("code", "market")


@R.add("p3_with_symbol", f"""
    SELECT {PART} AS code, CASE WHEN left({PART}, 1) IN ('6', '9') THEN 'sh'
      WHEN left({PART}, 1) IN ('4', '8') THEN 'bj' ELSE 'sz' END || {PART} AS symbol FROM part""")
def with_symbol(spark, sf):
    return universe.with_symbol(stocks(spark, sf)).select("code", "symbol")


@R.add("j1_new_keys", f"""
    SELECT {PART} AS code, p_name AS name FROM part
    WHERE p_partkey NOT IN (SELECT c_custkey FROM customer)""")
def new_keys(spark, sf):
    stored = table(spark, sf, "customer").select(code("c_custkey").alias("code"))
    return universe.new_keys(stocks(spark, sf), stored).select("code", "name")


@R.add("u1_all_codes", f"""
    SELECT {code_sql('s_suppkey')} AS code FROM supplier UNION SELECT {PART} FROM part
    UNION SELECT {code_sql('c_custkey')} FROM customer""")
def all_codes(spark, sf):
    return universe.all_codes(
        table(spark, sf, "supplier").select(code("s_suppkey").alias("code")),
        table(spark, sf, "part").select(code("p_partkey").alias("code")),
        table(spark, sf, "customer").select(code("c_custkey").alias("code")),
    )


@R.add("t5_limited", f"SELECT {PART} AS code, p_name AS name FROM part ORDER BY p_partkey LIMIT 25")
def limited(spark, sf):
    return universe.limited(stocks(spark, sf), 25).select("code", "name")


# Quotes.

_FIELDS = {
    1: "p_name", 3: "CAST(p_retailprice AS STRING)", 4: "CAST(p_size AS STRING)",
    5: "p_brand", 33: "concat('h', p_size)", 34: "concat('l', p_size)", 37: "p_type",
    39: "CASE WHEN p_size > 40 THEN '' ELSE '12.5' END", 42: "'fallback'", 45: "'0.00'",
}


def quote_lines(spark: SparkSession, sf: str) -> DataFrame:
    """A line per part; some sizes give lines that cannot be used."""
    part = table(spark, sf, "part")
    fields = [
        F.when(F.col("p_size") == 4, "").otherwise(code("p_partkey")) if i == 2
        else F.expr(_FIELDS.get(i, f"'x{i}'"))
        for i in range(48)
    ]
    body = F.when(F.col("p_size") == 3, F.concat_ws("~", *fields[:47])) \
        .otherwise(F.concat_ws("~", *fields))
    line = (
        F.when(F.col("p_size") == 1, body)
        .when(F.col("p_size") == 2, F.concat(F.lit('v_x="";')))
        .otherwise(F.concat(F.lit(' v_sz'), code("p_partkey"), F.lit('="'), body, F.lit('";\r')))
    )
    return part.select(F.col("p_partkey").alias("seq"), line.alias("line"))


QUOTES = f"""quotes AS (
  SELECT p_partkey AS seq, {PART} AS code, p_name AS name, CAST(p_retailprice AS VARCHAR) AS price,
    CAST(p_size AS VARCHAR) AS prev_close, p_brand AS open, 'x6' AS volume, p_type AS turnover,
    'x38' AS turnover_rate, CASE WHEN p_size > 40 THEN '' ELSE '12.5' END AS pe,
    'h' || p_size AS high, CASE WHEN p_size < 10 THEN 'fallback' ELSE 'l' || p_size END AS low,
    'x43' AS amplitude, 'x44' AS market_cap_float, '0.00' AS market_cap_total, 'x46' AS pb
  FROM part WHERE p_size > 4)"""


@R.add("p4_parse_quotes", f"WITH {QUOTES} SELECT * FROM quotes")
def parse_quotes(spark, sf):
    return quotes.parse_quotes(quote_lines(spark, sf))[0]


@R.add("p4_quote_rejects", """
    SELECT p_partkey AS seq, CASE p_size WHEN 1 THEN 'no assignment' WHEN 2 THEN 'no quoted text'
      WHEN 3 THEN 'too few fields' ELSE 'no code' END AS reason
    FROM part WHERE p_size <= 4""")
def quote_rejects(spark, sf):
    return quotes.parse_quotes(quote_lines(spark, sf))[1].drop("line")


@R.add("p4_typed_quotes", f"""WITH {QUOTES}
    SELECT seq, TRY_CAST(price AS DOUBLE) AS price, TRY_CAST(open AS DOUBLE) AS open,
      TRY_CAST(pe AS DOUBLE) AS pe, TRY_CAST(market_cap_total AS DOUBLE) AS market_cap_total
    FROM quotes""")
def typed_quotes(spark, sf):
    typed = quotes.typed_quotes(quotes.parse_quotes(quote_lines(spark, sf))[0])
    return typed.select("seq", "price", "open", "pe", "market_cap_total")


@R.add("t4_top_movers", f"""WITH {QUOTES}
    SELECT code, name, round(CAST(price AS DOUBLE) / CAST(prev_close AS DOUBLE) - 1, 6) AS change
    FROM quotes
    ORDER BY CAST(price AS DOUBLE) / CAST(prev_close AS DOUBLE) - 1 DESC, code LIMIT 100""")
def top_movers(spark, sf):
    found = universe.top_movers(quotes.parse_quotes(quote_lines(spark, sf))[0], 100)
    return found.select("code", "name", F.round("change", 6).alias("change"))


@R.add("j6_with_quote_placeholder", f"""
    WITH {QUOTES}, stock AS (
      SELECT DISTINCT {code_sql('l_partkey')} AS code, 'L' || l_partkey AS name FROM lineitem)
    SELECT s.code, CASE WHEN q.code IS NULL THEN s.name ELSE q.name END AS name,
           q.price, q.low, q.code IS NOT NULL AS matched
    FROM stock s LEFT JOIN quotes q ON s.code = q.code""")
def with_quote_placeholder(spark, sf):
    stock = table(spark, sf, "lineitem").select(
        code("l_partkey").alias("code"), F.concat(F.lit("L"), "l_partkey").alias("name")
    ).distinct()
    parsed = quotes.parse_quotes(quote_lines(spark, sf))[0]
    # An earlier quote of the same stock must lose.
    earlier = parsed.withColumn("seq", F.lit(-1).cast("bigint")).withColumn("price", F.lit("old"))
    return universe.with_quote_placeholder(stock, earlier.unionByName(parsed)).select(
        "code", "name", "price", "low", "matched"
    )


# Pages.

def concept_pages(spark: SparkSession, sf: str) -> DataFrame:
    """A page per part whose rows depend on the size of the part."""
    def name(n, short):
        return F.concat(
            F.lit('<tr class="r"><td class="gnName a"><a href="#"> '), n, F.lit(" </a></td>"),
            F.lit('<td><div class="tdContent">'), short, F.lit("</div></td></tr>"),
        )

    def full(text):
        return F.concat(
            F.lit('<tr class="extend_content" style="x"><td><div class="scrollbar-macosx y"><b>'), text,
            F.lit('</b><div class="bg_trigon_box"></div></div> </td></tr>'),
        )

    size = F.col("p_size")
    brand, kind = F.col("p_brand"), F.col("p_type")
    rows = (
        F.when(size < 10, F.concat(name(brand, kind), full(F.concat(kind, F.lit("&nbsp; \n more")))))
        .when(size < 20, F.concat(name(F.lit("dropped"), kind), name(brand, kind), full(F.lit(" "))))
        .when(size < 30, F.concat(full(kind), name(brand, F.concat(kind, F.lit("\xa0short")))))
        .when(size < 40, F.concat(name(brand, kind), full(kind), full(kind), name(F.lit(" "), kind)))
        .otherwise(F.lit("<tr><td>nothing</td></tr>"))
    )
    industry = F.when(size < 25, F.concat(
        F.lit('<p>所属行业：\n<a class="i" href="/i"> '), kind, F.lit(" </a></p>")
    )).when(size < 35, F.lit('<p>所属行业：<a href="/more">更多>></a></p>')).otherwise("")
    return table(spark, sf, "part").select(
        code("p_partkey").alias("code"),
        F.concat(
            F.lit("<html><tr><td class='gnName'>outside</td></tr>"), industry,
            F.lit('<table class="gnContent" id="t">\n'), rows, F.lit("</table></html>"),
        ).alias("html"),
    )


PAGE_CONCEPTS = f"""page_concepts AS (
  SELECT {PART} AS code, 0 AS pos, p_brand AS name,
    CASE WHEN p_size < 10 THEN p_type || ' more' WHEN p_size < 20 THEN p_type
         WHEN p_size < 30 THEN p_type || ' short' ELSE p_type END AS description
  FROM part WHERE p_size < 40)"""
PAGE_INDUSTRY = f"""page_industry AS (
  SELECT {PART} AS code, CASE WHEN p_size < 25 THEN p_type ELSE '' END AS industry FROM part)"""


@R.add("p5_extract_concepts", f"WITH {PAGE_CONCEPTS} SELECT * FROM page_concepts")
def extract_concepts(spark, sf):
    return concepts.extract_concepts(concept_pages(spark, sf))


@R.add("p6_extract_industry", f"WITH {PAGE_INDUSTRY} SELECT * FROM page_industry")
def extract_industry(spark, sf):
    return concepts.extract_industry(concept_pages(spark, sf))


# The white space of a page, spelled out for a regex engine without Unicode classes.
_BLANK = (
    r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
)


@R.add("p7_html_text", rf"""
    SELECT page_id, regexp_replace(regexp_replace(
      replace(replace(regexp_replace(html, '<[^>]+>', '', 'g'), chr(160), ' '), '&nbsp;', ' '),
      '{_BLANK}+', ' ', 'g'), '^ | $', '', 'g') AS text FROM pages""")
def html_text(spark, sf):
    return concepts.html_text(table(spark, sf, "pages")).select("page_id", "text")


# Board membership and item rows.

def membership(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").select(
        F.col("l_linenumber").alias("concept_pos"),
        F.when(F.col("l_linenumber") == 3, " ")
        .otherwise(F.concat(F.lit(" board "), "l_linenumber")).alias("concept"),
        code("l_partkey").alias("code"),
    )


INVERTED = f"""inverted AS (
  SELECT {code_sql('l_partkey')} AS code, l_linenumber AS concept_pos,
    'board ' || l_linenumber AS concept, count(*) AS copies
  FROM lineitem WHERE l_linenumber <> 3 GROUP BY ALL)"""
LISTS = """lists AS (
  SELECT code, string_agg(concept, ',' ORDER BY concept_pos) AS concepts,
    string_agg(copies, ',' ORDER BY concept_pos) AS copies FROM inverted GROUP BY code)"""


@R.add("a1_invert_membership", f"WITH {INVERTED} SELECT * FROM inverted")
def invert_membership(spark, sf):
    return concepts.invert_membership(membership(spark, sf))


@R.add("a1_concept_lists", f"WITH {INVERTED}, {LISTS} SELECT * FROM lists")
def concept_lists(spark, sf):
    lists = concepts.concept_lists(concepts.invert_membership(membership(spark, sf)))
    return lists.select(
        "code", F.array_join("concepts", ",").alias("concepts"),
        F.array_join(F.col("copies").cast("array<string>"), ",").alias("copies"),
    )


@R.add("j2_attach_concepts", f"""WITH {INVERTED}, {LISTS}
    SELECT c.code, coalesce(concepts, '') AS concepts
    FROM (SELECT {code_sql('c_custkey')} AS code FROM customer) c LEFT JOIN lists USING (code)""")
def attach_concepts(spark, sf):
    lists = concepts.concept_lists(concepts.invert_membership(membership(spark, sf)))
    who = table(spark, sf, "customer").select(code("c_custkey").alias("code"))
    return universe.attach_concepts(who, lists).select(
        "code", F.array_join("concepts", ",").alias("concepts")
    )


def items(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select(
        code("user_id").alias("code"), F.col("event_id").alias("pos"),
        F.concat(F.lit(" "), "event_type").alias("key"),
        F.when(F.col("value") < 5, "\t").otherwise(F.col("props")).alias("value"),
    )


LATEST = f"""latest AS (
  SELECT {code_sql('user_id')} AS code, event_type AS key, arg_max(props, event_id) AS value
  FROM events WHERE NOT value < 5 GROUP BY ALL)"""


@R.add("p8_latest_items", f"WITH {LATEST} SELECT * FROM latest")
def latest_items(spark, sf):
    return concepts.latest_items(items(spark, sf))


@R.add("p8_kv_to_map", f"""WITH {LATEST}
    SELECT code, string_agg(key || '=' || value, ';' ORDER BY key) AS info FROM latest GROUP BY code""")
def kv_to_map(spark, sf):
    return concepts.kv_to_map(items(spark, sf)).select("code", joined_map("info").alias("info"))


@R.add("j8_drop_contained_concepts", f"""
    WITH c AS (
      SELECT {code_sql('p_size')} AS code, p_name AS concept FROM part
      UNION SELECT {code_sql('p_size')}, split_part(p_name, ' ', 1) FROM part
      UNION SELECT {code_sql('p_size')}, p_brand FROM part)
    SELECT * FROM c WHERE NOT EXISTS (
      SELECT 1 FROM c AS o WHERE o.code = c.code AND o.concept <> c.concept
        AND contains(o.concept, c.concept))""")
def drop_contained_concepts(spark, sf):
    part = table(spark, sf, "part").select(
        code("p_size").alias("code"),
        F.explode(F.array("p_name", F.split_part("p_name", F.lit(" "), F.lit(1)), "p_brand")).alias("concept"),
    )
    return concepts.drop_contained_concepts(part)


# Drafts of three sources and their merge.

def board_drafts(spark, sf):
    rows = table(spark, sf, "supplier").select(
        code("s_suppkey").alias("code"),
        F.when(F.col("s_nationkey") < 5, "").otherwise(F.col("s_name")).alias("name"),
        F.array(F.concat(F.lit("n"), "s_nationkey"), F.lit("all")).alias("concepts"),
        F.create_map(F.lit("nation"), F.col("s_nationkey").cast("string"), F.lit("pe"), F.lit("board")).alias("info"),
        F.create_map(F.lit("note"), F.lit("from board"), F.lit("only"), F.col("s_name")).alias("extra"),
    )
    return conform_draft(merge.stamp(rows, "eastmoney", when()), "eastmoney")


def web_drafts(spark, sf):
    rows = table(spark, sf, "part").select(
        code("p_partkey").alias("code"), F.col("p_name").alias("name"),
        F.array(F.struct(F.col("p_brand").alias("name"), F.col("p_type").alias("description"))).alias("concepts_ths"),
        F.when(F.col("p_size") < 10, "").otherwise(F.col("p_type")).alias("industry"),
        F.create_map(F.lit("note"), F.concat(F.lit("web "), "p_size")).alias("extra"),
    )
    return conform_draft(merge.stamp(rows, "ths", when()), "ths")


def quote_drafts(spark, sf):
    rows = table(spark, sf, "customer").select(
        code("c_custkey").alias("code"), F.col("c_name").alias("name"),
        F.lit("0.00").alias("price"), F.lit("").alias("open"), F.col("c_mktsegment").alias("pe"),
    )
    return conform_draft(merge.stamp(rows, "tencent", when()), "tencent")


def drafts(spark, sf) -> DataFrame:
    return board_drafts(spark, sf).unionByName(web_drafts(spark, sf)).unionByName(quote_drafts(spark, sf))


MERGED = f"""
  keys AS (SELECT s_suppkey AS k FROM supplier UNION SELECT p_partkey FROM part
           UNION SELECT c_custkey FROM customer),
  merged AS (
    SELECT {code_sql('k')} AS code,
      coalesce(CASE WHEN s_nationkey < 5 THEN NULL ELSE s_name END, c_name, p_name, '') AS name,
      CASE WHEN s_suppkey IS NULL THEN '' ELSE 'n' || s_nationkey || ',all' END AS boards,
      coalesce(p_brand || ':' || p_type, '') AS web,
      CASE WHEN p_size < 10 THEN '' ELSE coalesce(p_type, '') END AS industry,
      concat_ws(';', CASE WHEN s_suppkey IS NOT NULL THEN 'nation=' || s_nationkey END,
        CASE WHEN c_custkey IS NOT NULL THEN 'pe=' || c_mktsegment
             WHEN s_suppkey IS NOT NULL THEN 'pe=board' END,
        CASE WHEN c_custkey IS NOT NULL THEN 'price=0.00' END) AS info,
      concat_ws(',', CASE WHEN s_suppkey IS NOT NULL THEN 'eastmoney' END,
        CASE WHEN c_custkey IS NOT NULL THEN 'tencent' END,
        CASE WHEN p_partkey IS NOT NULL THEN 'ths' END) AS sources,
      concat_ws(';', CASE WHEN p_partkey IS NOT NULL THEN 'note=web ' || p_size
                          WHEN s_suppkey IS NOT NULL THEN 'note=from board' END,
        'only=' || s_name) AS extra
    FROM keys LEFT JOIN supplier ON s_suppkey = k LEFT JOIN part ON p_partkey = k
         LEFT JOIN customer ON c_custkey = k)"""


def _merged_flat(merged: DataFrame) -> DataFrame:
    web = F.transform("concepts_ths", lambda c: F.concat(c["name"], F.lit(":"), c["description"]))
    return merged.select(
        "code", "name", F.array_join("concepts_eastmoney", ",").alias("boards"),
        F.array_join(web, ",").alias("web"), "industry", joined_map("info").alias("info"),
        F.array_join("sources", ",").alias("sources"), joined_map("extra").alias("extra"),
    )


@R.add("j3_merge_drafts", f"WITH {MERGED} SELECT * FROM merged")
def merge_drafts(spark, sf):
    return _merged_flat(merge.merge_drafts(drafts(spark, sf), ["eastmoney", "tencent", "ths"]))


@R.add("s4_write_merged", f"WITH {MERGED} SELECT * FROM merged")
def write_merged(spark, sf):
    path = scratch_path(spark, "merged")
    merged = merge.merge_drafts(drafts(spark, sf))
    tables.write_merged(merged, path)
    return _merged_flat(spark.read.parquet(path))


@R.add("s9_stamp", f"""
    SELECT {PART} AS code, 'ths' AS source, {PART} AS stock_code, '{AT}' AS collected_at FROM part""")
def stamp(spark, sf):
    return merge.stamp(stocks(spark, sf), "ths", when()).select(
        "code", "_meta.source", "_meta.stock_code", "_meta.collected_at"
    )


@R.add("a2_outcome_counts", """
    SELECT 'ths' AS source, count(*) FILTER (p_size < 20) AS success,
      count(*) FILTER (p_size >= 20 AND p_size < 40) AS "empty",
      count(*) FILTER (p_size >= 40) AS no_data FROM part
    UNION ALL SELECT 'tencent', count(*), 0, 0 FROM customer""")
def outcome_counts(spark, sf):
    web = table(spark, sf, "part").select(
        F.lit("ths").alias("source"), (F.col("p_size") < 40).alias("landed"),
        F.when(F.col("p_size") < 20, 2).otherwise(0).alias("n_concepts"),
    )
    quoted = table(spark, sf, "customer").select(
        F.lit("tencent").alias("source"), F.lit(True).alias("landed"), F.lit(None).cast("int").alias("n_concepts")
    )
    return merge.outcome_counts(web.unionByName(quoted))


@R.add("a10_concept_counts", f"""WITH {MERGED}
    SELECT code, CASE WHEN boards = '' THEN 0 ELSE 2 END AS n_boards,
      CASE WHEN web = '' THEN 0 ELSE 1 END AS n_web, n_boards + n_web AS n_concepts FROM merged""")
def concept_counts(spark, sf):
    return merge.concept_counts(merge.merge_drafts(drafts(spark, sf)))


@R.add("a10_concept_totals", f"""WITH {MERGED}
    SELECT count(*) AS n_stocks, CAST(2 * count(*) FILTER (boards <> '') AS BIGINT) AS n_boards,
      count(*) FILTER (web <> '') AS n_web FROM merged""")
def concept_totals(spark, sf):
    return merge.concept_totals(merge.merge_drafts(drafts(spark, sf)))


@R.add("p15_assemble_documents", f"""WITH {MERGED}
    SELECT code, name, concat_ws(chr(10) || chr(10), '# ' || name || ' (' || code || ')',
      CASE WHEN industry <> '' THEN '所属行业: ' || industry END,
      CASE WHEN web <> '' THEN '## 核心题材' || chr(10) || '- ' || replace(web, ':', ': ') END,
      CASE WHEN boards <> '' THEN '## 所属板块' || chr(10) || replace(boards, ',', '、') END) AS content
    FROM merged""")
def assemble_documents(spark, sf):
    return merge.assemble_documents(merge.merge_drafts(drafts(spark, sf)))


def _land_drafts(spark, sf) -> str:
    """Write every draft as a JSON file, beside files that are to be skipped."""
    root = scratch_path(spark, "drafts")
    all_drafts = drafts(spark, sf)
    body = F.struct(*[c for c in all_drafts.columns if c not in ("source", "extra")])
    opened = F.when(F.col("extra").isNull(), F.to_json(body)).otherwise(F.concat(
        F.rtrim(F.regexp_replace(F.to_json(body), r"\}$", "")), F.lit(","),
        F.substring(F.to_json("extra"), 2, 2**31 - 1),
    ))
    files = all_drafts.select(
        F.concat_ws("/", "source", F.concat("code", F.lit(".json"))).alias("name"), opened.alias("content")
    )
    skipped = stocks(spark, sf).select(
        F.concat(F.lit("merged/"), "code", F.lit(".json")).alias("name"), F.lit('{"name":"no"}').alias("content")
    ).unionByName(
        table(spark, sf, "region").groupBy().agg(F.count("*").alias("n")).select(
            F.lit("ths/stock_list.json").alias("name"), F.concat(F.lit('{"count":'), "n", F.lit("}")).alias("content")
        )
    )
    write_files(files.unionByName(skipped), root)
    return root


@R.add("s1_read_drafts", f"""
    SELECT 'eastmoney' AS source, {code_sql('s_suppkey')} AS code,
      CASE WHEN s_nationkey < 5 THEN '' ELSE s_name END AS name, 'note,only' AS extra_keys,
      '{AT}' AS at FROM supplier
    UNION ALL SELECT 'ths', {PART}, p_name, 'note', '{AT}' FROM part
    UNION ALL SELECT 'tencent', {code_sql('c_custkey')}, c_name, '', '{AT}' FROM customer""")
def read_back_drafts(spark, sf):
    found = read_drafts(spark, _land_drafts(spark, sf))
    keys = F.array_join(F.array_sort(F.map_keys("extra")), ",")
    return found.select("source", "code", "name", keys.alias("extra_keys"), F.col("_meta.collected_at").alias("at"))


@R.add("b1_job_merge_all", f"WITH {MERGED} SELECT * FROM merged")
def job_merge_all(spark, sf):
    return _merged_flat(jobs.job_merge_all(spark, _land_drafts(spark, sf), scratch_path(spark, "merged")))


def _collect(spark, sf, existing=None):
    return jobs.job_collect(
        stocks(spark, sf), membership(spark, sf), items(spark, sf), concept_pages(spark, sf),
        quote_lines(spark, sf), existing=existing, at=when(),
    )


COLLECTED = f"""collected AS (
  SELECT 'eastmoney' AS source, code, name, coalesce(concepts, '') AS concepts,
    CASE WHEN concepts IS NULL THEN 0 ELSE 1 END AS listed, coalesce(info, '') AS info,
    NULL AS industry, NULL AS price
  FROM (SELECT {PART} AS code, p_name AS name FROM part) LEFT JOIN lists USING (code) LEFT JOIN (
    SELECT code, string_agg(key || '=' || value, ';' ORDER BY key) AS info FROM latest GROUP BY code)
    USING (code)
  UNION ALL
  SELECT 'ths', p.code, p.name, coalesce(c.name || ':' || c.description, ''), 0, NULL, i.industry, NULL
  FROM (SELECT {PART} AS code, p_name AS name FROM part) p
    LEFT JOIN page_concepts c USING (code) LEFT JOIN page_industry i USING (code)
  UNION ALL
  SELECT 'tencent', p.code, p.name, '', 0, NULL, NULL, q.price
  FROM (SELECT {PART} AS code, p_name AS name FROM part) p LEFT JOIN quotes q USING (code))"""
_ALL = f"{INVERTED}, {LISTS}, {LATEST}, {PAGE_CONCEPTS}, {PAGE_INDUSTRY}, {QUOTES}, {COLLECTED}"


def _collected_flat(found: DataFrame) -> DataFrame:
    web = F.transform("concepts_ths", lambda c: F.concat(c["name"], F.lit(":"), c["description"]))
    return found.select(
        "source", "code", "name",
        F.coalesce(F.array_join(F.coalesce("concepts", web), ","), F.lit("")).alias("concepts"),
        F.when(F.col("source") == "eastmoney", F.coalesce(joined_map("info"), F.lit(""))).alias("info"),
        "industry", "price",
    )


@R.add("b7_job_collect", f"WITH {_ALL} SELECT source, code, name, concepts, info, industry, price FROM collected")
def job_collect(spark, sf):
    return _collected_flat(_collect(spark, sf)[0])


@R.add("b7_job_collect_incremental", f"""WITH {_ALL}
    SELECT source, code, name, concepts, info, industry, price FROM collected
    WHERE (source = 'eastmoney' AND code NOT IN (SELECT {code_sql('s_suppkey')} FROM supplier))
       OR (source = 'tencent' AND code NOT IN (SELECT {code_sql('c_custkey')} FROM customer))""")
def job_collect_incremental(spark, sf):
    return _collected_flat(_collect(spark, sf, drafts(spark, sf))[0])


@R.add("b7_outcomes", f"""
    SELECT 'eastmoney' AS source, count(*) AS success, 0 AS "empty", 0 AS no_data FROM part
    UNION ALL SELECT 'ths', count(*) FILTER (p_size < 40), count(*) FILTER (p_size >= 40), 0 FROM part
    UNION ALL SELECT 'tencent', count(*) FILTER (p_size > 4), 0, count(*) FILTER (p_size <= 4) FROM part""")
def job_outcomes(spark, sf):
    return _collect(spark, sf)[1]
