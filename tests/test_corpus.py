"""Summaries, quality rules, tokens, keywords, embeddings and the collection jobs."""

import math

import numpy as np
import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from themeloom.functions import text as tx
from themeloom.operators import corpus, embed, quality
from themeloom.plans import jobs
from themeloom.sources import files as landed
from themeloom.sources import tables
from themeloom.sources.files import write_files
from themeloom.sources.summaries import read_summaries, summary_names


def files(spark, *rows):
    return spark.createDataFrame(list(rows), "file_name string, content string")


def land(spark, folder, *rows):
    write_files(files(spark, *rows).withColumnRenamed("file_name", "name"), folder)


def texts(spark, *rows):
    return spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "doc_id int, content string")


@pytest.mark.parametrize("name, content, want", [
    ("000001_平安.md", " a \n", ("000001", "平安", "a")),
    ("000001_a_b.md", "x", ("000001", "a_b", "x")),
    ("plain.md", "x", ("plain", "", "x")),
    ("_x.md", "intro\n#  600000  Bank \nmore", ("600000", "Bank", "intro\n#  600000  Bank \nmore")),
    ("_x.md", "# 60000 Bank", None),
    ("000002_b.md", " 　\n", None),
])
def test_summary_names(spark, name, content, want):
    got = corpus.parse_summary(files(spark, (name, content))).collect()
    assert [(r.code, r.name, r.content) for r in got] == ([want] if want else [])


def test_summary_files(spark, folder):
    land(spark, folder, ("000001_平 安+1.md", "a\r\nb\rc"), ("_hidden.md", "h"), ("note.txt", "no"), ("empty.md", ""))
    got = {r.file_name: r.content for r in read_summaries(spark, folder).collect()}
    assert got == {"000001_平 安+1.md": "a\nb\nc", "_hidden.md": "h", "empty.md": ""}


def test_summaries_are_listed_and_opened_in_tasks(spark, folder, monkeypatch):
    """The driver holds no list of the files, and each comes once, hidden and empty ones too."""
    monkeypatch.setattr(landed, "NAMES_AT_ONCE", 3)
    monkeypatch.setattr(landed, "BYTES_AT_ONCE", 1)
    names = ["1_a.md", "2_b {x}+%41.md", "_h.md", "_k=v.md", ".md", "_metadata.md"] + [f"{i}_n.md" for i in range(10, 20)]
    land(spark, folder, *[(n, "x\r" + n) for n in names], ("empty.md", ""), ("sub/3_c.md", "below"), ("4_d.MD", "no"))
    found = read_summaries(spark, folder)
    assert found.inputFiles() == [] and summary_names(spark, folder).inputFiles() == []
    want = {**{n: "x\n" + n for n in names}, "empty.md": ""}
    assert sorted(tuple(r) for r in found.collect()) == sorted(want.items())
    ordinary = sorted(n for n in names if n[0] not in "_.")
    assert sorted(r.file_name for r in summary_names(spark, folder).collect()) == ordinary
    aside = sorted(set(want) - set(ordinary))
    assert sorted(r.file_name for r in read_summaries(spark, folder, []).collect()) == aside
    assert sorted(r.file_name for r in read_summaries(spark, folder, [names[1]]).collect()) == sorted([*aside, names[1]])
    with pytest.raises(AnalysisException):
        read_summaries(spark, folder + "-none")
    assert read_summaries(spark, folder + "-none", []).count() == 0


GOOD = "# 000001 平安银行\n## 所属板块\n## 主营业务\n## 题材标签\n"


@pytest.mark.parametrize("content, want", [
    (" \n", [quality.EMPTY]),
    (GOOD + "x" * (50 - len(GOOD)), []),
    (GOOD + "x" * (49 - len(GOOD)), [quality.SHORT]),
    ("x\n" + GOOD.replace("## 主营业务", "主营业务") + "x" * 50, [quality.NO_SECTION + "主营业务"]),
    ("x" * 60, [quality.NO_TITLE] + [quality.NO_SECTION + s for s in quality.LEGACY.sections]),
])
def test_legacy_profile(spark, content, want):
    assert quality.validate_summaries(files(spark, ("f.md", content))).first().issues == want


def test_current_profile(spark):
    body = "# 平安银行 (000001)\n\n引言一句。\n\n## 核心题材\n1. x\n\n## 业务亮点\n- y\n"
    def check(content):
        return quality.validate_summaries(files(spark, ("f.md", content)), quality.CURRENT).first().issues
    assert check(body + "字" * 200) == []
    assert check(body) == [quality.SHORT] and check(body + "字" * 600) == [quality.LONG]
    assert quality.NO_INTRO in check(body.replace("引言一句。", "") + "字" * 200)
    assert quality.NO_NEW_TITLE in check(GOOD + "字" * 200)


def test_report(spark):
    issues = quality.validate_summaries(files(spark, ("a.md", ""), ("b.md", GOOD + "x" * 50)))
    assert tuple(quality.validation_report(issues).first()) == (2, 1, 1)
    assert [r.file_name for r in quality.failing_files(issues).collect()] == ["a.md"]


@pytest.mark.parametrize("text, flags, keep, core", [
    ("公司澄清与该题材无关", ["denial"], False, False),
    ("2025年Q3营收123.4亿元", ["figure"], False, False),
    ("今日涨幅5.2%", ["price"], False, False),
    ("融资融券", ["trading"], True, False),
    ("公司融资融券业务发展", [], True, True),
    ("2025年Q3营收123亿元，来自机器人业务", [], True, True),
])
def test_statements(spark, text, flags, keep, core):
    r = quality.flag_statements(spark.createDataFrame([(text,)], "text string")).first()
    assert (r.flags, r.keep, r.core) == (flags, keep, core)


def test_tokens_of_mixed_text(spark):
    docs = texts(spark, "光伏组件 PV2024 2024 光伏组件", "none 这里")
    lexicon = spark.createDataFrame([("光伏", "n"), ("组件", "v"), ("光伏组件", "nz"), ("伏组", "x")], "token string, pos string")
    got = sorted((r.doc_id, r.token, r.pos) for r in corpus.tokenize(docs, lexicon).collect())
    assert got == sorted([
        (0, "光伏", "n"), (0, "组件", "v"), (0, "光伏组件", "nz"), (0, "伏组", "x"),
        (0, "PV2024", "eng"), (0, "2024", "m"), (1, "none", "eng"),
    ])
    kept = {r.token for r in corpus.filter_tokens(corpus.tokenize(docs, lexicon)).collect()}
    assert kept == {"光伏", "光伏组件", "PV2024", "none"}
    stop = spark.createDataFrame([("none",), ("光伏",)], "word string")
    assert {r.token for r in corpus.filter_tokens(corpus.tokenize(docs, lexicon), stop).collect()} == {"光伏组件", "PV2024"}


def test_keyword_band(spark):
    docs = texts(spark, "aa bb cc", "aa bb", "aa dd", "ee", "公司", "bb")
    rows = {r.token: (r.doc_freq, r.idf) for r in corpus.extract_keywords(docs).collect()}
    assert rows == {"aa": (3, round(math.log(2), 4)), "bb": (3, round(math.log(2), 4))}


def test_stop_words_are_dropped(spark):
    tokens = spark.createDataFrame([("公司", "n"), ("机器人", "n"), ("x", "n"), ("跑步", "v")], "token string, pos string")
    assert [r.token for r in corpus.filter_tokens(tokens).collect()] == ["机器人"]


def test_embedding(spark):
    rows = embed.embed_documents(texts(spark, "a b a", "", "光伏组件", "伏组"), 16).orderBy("doc_id").collect()
    v = [np.array(r.embedding) for r in rows]
    assert all(len(x) == 16 for x in v) and np.allclose([np.linalg.norm(x) for x in v], [1, 0, 1, 1])
    # A pair of characters inside a longer run is a feature of both texts.
    assert abs(v[2] @ v[3]) > 0.3


def test_embed_with_a_model(spark):
    loads = embed.embed_with(texts(spark, "ab", "", None), lambda: lambda t: np.array([[len(x), 0.0] for x in t]), 2, batch_size=2)
    assert [r.embedding for r in loads.orderBy("doc_id").collect()] == [[1.0, 0.0], [0.0, 0.0], [0.0, 0.0]]
    wrong = embed.embed_with(texts(spark, "ab"), lambda: lambda t: np.zeros((len(t), 3)), 2)
    with pytest.raises(Exception, match="expected"):
        wrong.collect()


def test_trimming(spark):
    row = spark.createDataFrame([("　\x1c a b  \n",)], "t string").select(tx.strip(F.col("t")).alias("t")).first()
    assert row.t == "　\x1c a b  \n".strip()


def stored(spark, store):
    rows = tables.read_collection(spark, jobs.documents(store)).collect()
    return {r.id: r.document for r in rows}


def test_rebuild_update_query(spark, folder):
    store, summaries = folder + "-store", folder + "-in"
    land(spark, summaries, ("1_a.md", "solar panel power"), ("1_b.md", "second of an id"), ("2_c.md", "solar wind power"),
         ("3_d.md", "bank loan"), ("4_e.md", "bank card"))
    counts = {r.collection: r.n for r in jobs.job_rebuild(spark, summaries, store, dim=64).collect()}
    # Words of two of the five texts: solar, power and bank.
    assert counts == {"documents": 4, "keywords": 3}
    assert stored(spark, store)["1"] == "solar panel power"
    assert jobs.job_update(spark, summaries, store, 64).count() == 0
    land(spark, summaries, ("5_f.md", "wind farm"), ("2_c.md", "changed text"))
    assert [r.id for r in jobs.job_update(spark, summaries, store, 64).collect()] == ["5"]
    assert stored(spark, store)["2"] == "solar wind power"
    assert [r.id for r in jobs.job_update(spark, summaries, store, 64, changed=True).collect()] == ["2"]
    assert stored(spark, store)["2"] == "changed text" and len(stored(spark, store)) == 5
    asked = spark.createDataFrame([(1, "bank card"), (2, "solar panel")], "query_id int, text string")
    best = {r.query_id: r.code for r in jobs.job_query_text(spark, asked, store, 2, 64).where("rank = 1").collect()}
    assert best == {1: "4", 2: "1"}
    with pytest.raises(ValueError):
        jobs.job_query_text(spark, asked, folder + "-none")


def test_rebuild_without_keywords_empties_them(spark, folder):
    store, summaries = folder + "-store", folder + "-in"
    land(spark, summaries, ("1_a.md", "x1 y1"), ("2_b.md", "x1 y2"), ("3_c.md", "zz"), ("4_d.md", "ww"))
    assert {r.collection: r.n for r in jobs.job_rebuild(spark, summaries, store, dim=8).collect()}["keywords"] == 1
    other = folder + "-other"
    land(spark, other, ("1_a.md", "nothing shared"))
    assert {r.collection: r.n for r in jobs.job_rebuild(spark, other, store, dim=8).collect()} == {"documents": 1, "keywords": 0}


def test_validate_job(spark, folder):
    land(spark, folder, ("a.md", ""), ("b.md", GOOD + "x" * 50), ("_c.md", "short"))
    report, failing = jobs.job_validate(spark, folder)
    assert tuple(report.first()) == (3, 1, 2)
    assert {r.file_name for r in failing.collect()} == {"a.md", "_c.md"}


def test_an_update_opens_new_files_only(spark, folder, monkeypatch):
    store, summaries = folder + "-store", folder + "-in"
    land(spark, summaries, ("1_a.md", "one"), ("2_b {x}[1],*.md", "two"), ("_h.md", "# 000007 hidden\ntext"))
    jobs.job_rebuild(spark, summaries, store, dim=8)
    land(spark, summaries, ("1_z.md", "another of a known code"), ("3_c {y}[1],?.md", "three"), ("_i.md", "# 000008 next\ntext"))
    opened = []
    real = jobs.read_summaries
    monkeypatch.setattr(jobs, "read_summaries", lambda s, f, only=None: opened.append(only) or real(s, f, only))
    assert sorted(r.id for r in jobs.job_update(spark, summaries, store, 8).collect()) == ["000008", "3"]
    assert opened == [["3_c {y}[1],?.md"]] and stored(spark, store)["3"] == "three"
    # Too many to be named: the folder is read, with the same result.
    land(spark, summaries, ("4_d.md", "four"))
    monkeypatch.setattr(jobs, "NAMED_FILES", 0)
    assert [r.id for r in jobs.job_update(spark, summaries, store, 8).collect()] == ["4"] and opened[-1] is None
    monkeypatch.setattr(jobs, "NAMED_FILES", 5)
    assert jobs.job_update(spark, summaries, store, 8).count() == 0 and opened[-1] == []


def lists_of_the_driver(monkeypatch, module, name):
    """Files that the driver holds a list of, of the first table given to a function."""
    real, seen = getattr(module, name), []
    monkeypatch.setattr(module, name, lambda df, *a: seen.append(df.inputFiles()) or real(df, *a))
    return seen


def test_update_lists_no_files_on_the_driver(spark, folder, monkeypatch):
    store, summaries = folder + "-store", folder + "-in"
    land(spark, summaries, ("1_a.md", "one"), ("_h.md", "# 000007 hidden\ntext"))
    jobs.job_rebuild(spark, summaries, store, dim=8)
    land(spark, summaries, ("2_b.md", "two"), ("3_c.md", "three"), ("_i.md", "# 000008 next\ntext"))
    monkeypatch.setattr(jobs, "NAMED_FILES", 1)
    seen = lists_of_the_driver(monkeypatch, corpus, "parse_summary")
    assert sorted(r.id for r in jobs.job_update(spark, summaries, store, 8).collect()) == ["000008", "2", "3"]
    assert seen == [[]]


def test_rebuild_lists_no_files_on_the_driver(spark, folder, monkeypatch):
    land(spark, folder, ("1_a.md", "one two"), ("2_b.md", "two"), ("_h.md", "# 000007 hidden\ntext"))
    seen = lists_of_the_driver(monkeypatch, corpus, "parse_summary")
    counts = {r.collection: r.n for r in jobs.job_rebuild(spark, folder, folder + "-store", dim=8).collect()}
    assert seen == [[]] and counts["documents"] == 3


def test_validation_lists_no_files_on_the_driver(spark, folder, monkeypatch):
    land(spark, folder, ("a.md", ""), ("b.md", GOOD + "x" * 50), ("_c.md", "short"))
    seen = lists_of_the_driver(monkeypatch, quality, "validate_summaries")
    assert tuple(jobs.job_validate(spark, folder)[0].first()) == (3, 1, 2) and seen == [[]]


def test_failing_files_come_without_a_list_on_the_driver(spark, folder):
    land(spark, folder, ("a.md", ""), ("b.md", GOOD + "x" * 50), ("_c.md", "short"))
    failing = jobs.job_validate(spark, folder)[1]
    assert failing.inputFiles() == [] and {r.file_name for r in failing.collect()} == {"a.md", "_c.md"}


def test_query_text_leaves_texts_without_features_out_as_its_sql(spark, tmp_path):
    import duckdb
    import pyarrow as pa
    import pyarrow.parquet as pq

    from themeloom.checks import oracle_sql, queries
    from tests.compare import difference

    ids = pa.array(range(1, 9), pa.int64())
    pq.write_table(pa.table({
        "doc_id": ids, "text": ["alpha beta", None, "", "gamma delta", "epsilon zeta", "eta theta", "iota", "!!"],
        "lang": ["en"] * 8, "source": ["x"] * 8, "n_chars": ids,
    }), tmp_path / "documents.parquet")
    pq.write_table(pa.table({"item_id": pa.array([1, 2], pa.int64()), "text": ["alpha omega", "..."]}),
                   tmp_path / "benchmark.parquet")
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{tmp_path}/{t}.parquet')")
    found = queries()["b4_job_query_text"](spark, str(tmp_path))
    assert difference(found, con, oracle_sql()["b4_job_query_text"]) is None
