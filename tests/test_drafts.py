"""Pages, quotes, drafts and merging on small inputs, against sequential models."""

import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.errors import AnalysisException

from themeloom.operators import concepts, merge, quotes, universe
from themeloom.plans import jobs
from themeloom.sources import tables
from themeloom.sources import drafts as sources
from themeloom.sources import files
from themeloom.sources.drafts import parse_drafts, read_drafts
from themeloom.sources.files import write_files


def name_row(name, short="short"):
    return f'<tr><td class="gnName x">{name}</td><td><div class="tdContent">{short}</div></td></tr>'


def full_row(text):
    return f'<tr class="extend_content"><td><div class="scrollbar-macosx">{text}</div></td></tr>'


def extracted(spark, *rows, marker='<div class="gnContent">'):
    html = "<tr></tr>" + marker + "".join(rows)
    pages = spark.createDataFrame([("1", html)], "code string, html string")
    found = concepts.extract_concepts(pages).orderBy("pos").collect()
    return [(r.name, r.description) for r in found]


def model(events):
    """The rule, one row after the other: a full row closes the name before it."""
    out, pending = [], None
    for kind, value in events:
        if kind == "name":
            pending = value
        elif kind == "full" and pending is not None:
            out.append((pending, value or "short"))
            pending = None
    if pending is not None:
        out.append((pending, "short"))
    return out


EVENT = st.one_of(
    st.tuples(st.just("name"), st.sampled_from(["a", "b"])),
    st.tuples(st.just("full"), st.sampled_from(["", "long"])),
    st.tuples(st.just("other"), st.just("")),
)


@settings(max_examples=15, deadline=None)
@given(events=st.lists(EVENT, max_size=8))
def test_concept_rows(spark, events):
    rows = [{"name": name_row, "full": full_row, "other": lambda _: "<tr><td>x</td></tr>"}[k](v) for k, v in events]
    assert extracted(spark, *rows) == model(events)


def test_concept_details(spark):
    assert extracted(spark, name_row("a"), marker="<div>") == []
    assert extracted(spark, name_row(" <a>x</a> ", " s&nbsp;t\xa0"), full_row("　")) == [("x", "s t")]
    decorated = full_row('one\xa0<i>two</i>\n　three<div class="bg_trigon_box"></div>')
    assert extracted(spark, name_row("a"), decorated) == [("a", "one two three")]
    plain = '<tr class="extend_content"><td> no <b>box</b> </td></tr>'
    assert extracted(spark, name_row("a"), plain) == [("a", "no box")]


@pytest.mark.parametrize("html, want", [
    ('所属行业：\n<b></b><a class="x" href="/i"> 银行 </a>', "银行"),
    ('所属行业：<a href="/m">更多>></a>', ""),
    ("<a href='x'>y</a>", ""),
])
def test_industry(spark, html, want):
    pages = spark.createDataFrame([("1", html)], "code string, html string")
    assert concepts.extract_industry(pages).first().industry == want


def quote_line(n=48, code="600519", low="12.3"):
    f = [f"f{i}" for i in range(n)]
    f[2] = code
    if n > 34:
        f[34] = low
    return 'v_sh600519="' + "~".join(f) + '";'


def test_quotes(spark):
    lines = [quote_line(), quote_line(low="--"), quote_line(n=47), quote_line(code=""), "v_x=1", 'v_x=""', "nothing"]
    table = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "seq int, line string")
    good, bad = quotes.parse_quotes(table)
    rows = good.orderBy("seq").collect()
    assert [r.seq for r in rows] == [0, 1]
    assert (rows[0].low, rows[1].low) == ("12.3", "f42")
    assert (rows[0].turnover, rows[0].turnover_rate, rows[0].pe, rows[0].high) == ("f37", "f38", "f39", "f33")
    assert (rows[0].amplitude, rows[0].market_cap_float, rows[0].market_cap_total, rows[0].pb) == ("f43", "f44", "f45", "f46")
    assert {r.seq: r.reason for r in bad.collect()} == {
        2: "too few fields", 3: "no code", 4: "no quoted text", 5: "no quoted text", 6: "no assignment",
    }


def test_universe(spark):
    raw = spark.createDataFrame([(" 600000 ", "A"), ("", "B"), ("1", " 　")], "code string, name string")
    assert [tuple(r) for r in universe.normalize_universe(raw).collect()] == [("600000", "A")]
    codes = spark.createDataFrame([(c,) for c in ("600", "000", "300", "430", "830", "900", "200", "500")], "code string")
    rows = universe.with_symbol(universe.with_market(codes)).collect()
    assert [r.market for r in rows] == ["SH", "SZ", "SZ", "BJ", "BJ", "OTHER", "OTHER", "OTHER"]
    assert [r.symbol[:2] for r in rows] == ["sh", "sz", "sz", "bj", "bj", "sh", "sz", "sz"]
    days = [str(r.date) for r in universe.date_spine(spark, "2024-03-01", "2024-02-28").collect()]
    assert days == ["2024-02-28", "2024-02-29", "2024-03-01"]
    assert universe.recent_days(spark, "2024-03-31").count() == 31


def test_top_movers(spark):
    rows = spark.createDataFrame(
        [("a", "11", "10"), ("b", "12", "10"), ("c", "", "10"), ("d", "5", "0"), ("e", "11", "10")],
        "code string, price string, prev_close string",
    )
    assert [r.code for r in universe.top_movers(rows, 3).collect()] == ["b", "a", "e"]


def test_membership_of_a_dominant_stock(spark):
    rows = [(i % 4, f"c{i % 4}", "hot") for i in range(300)] + [(1, " ", "x"), (2, "c", " ")]
    table = spark.createDataFrame(rows, "concept_pos int, concept string, code string")
    found = concepts.invert_membership(table)
    assert sorted((r.concept_pos, r.copies) for r in found.collect()) == [(0, 75), (1, 75), (2, 75), (3, 75)]
    lists = concepts.concept_lists(found).first()
    assert lists.concepts == ["c0", "c1", "c2", "c3"] and lists.copies == [75] * 4


NAMES = st.lists(st.text(alphabet="ab中", min_size=1, max_size=4), min_size=1, max_size=8)


@settings(max_examples=15, deadline=None)
@given(names=NAMES)
def test_contained_concepts(spark, names):
    table = spark.createDataFrame([("1", n) for n in names], "code string, concept string")
    got = sorted(r.concept for r in concepts.drop_contained_concepts(table).collect())
    assert got == sorted(n for n in set(names) if not any(n != o and n in o for o in set(names)))


def test_contained_concepts_in_rounds_and_of_long_names(spark, monkeypatch):
    """A name of 10,000 letters costs its length; many rounds of names give the same."""
    names = ["ab", "b", "", "x" * 10_000, "xxx", "x" * 9_999, "中文", "文", "lone"]
    rows = [("1", n) for n in names] + [("2", n) for n in ("b", "cd", None)] + [("3", "")]
    table = spark.createDataFrame(rows, "code string, concept string")

    def outcome():
        return sorted(((r.code, r.concept) for r in concepts.drop_contained_concepts(table).collect()), key=repr)

    got = outcome()
    assert got == sorted([("1", "ab"), ("1", "x" * 10_000), ("1", "中文"), ("1", "lone"),
                          ("2", "b"), ("2", "cd"), ("2", None), ("3", "")], key=repr)
    monkeypatch.setattr(concepts, "NAME_BYTES", 200)
    assert outcome() == got


def drafts(spark, *files):
    return parse_drafts(spark.createDataFrame(
        [(s, c, json.dumps(body, ensure_ascii=False)) for s, c, body in files], "source string, code string, value string"
    ))


def merged(spark, *files, rank=None):
    return {r.code: r for r in merge.merge_drafts(drafts(spark, *files), rank).collect()}


FILES = (
    ("eastmoney", "1", {"name": "", "concepts": ["x", "y"], "info": {"pe": "board", "k": "v"}, "note": "b", "_p": 1}),
    ("tencent", "1", {"name": "quote", "price": "0.00", "pe": "9", "open": "", "note": {"a": 1}}),
    ("ths", "1", {"name": "web", "concepts_ths": [{"name": "n", "description": "d"}], "industry": "i"}),
    ("ths", "2", {"name": "only", "industry": ""}),
    ("other", "3", {"price": "7", "concepts": ["no"], "deep": [1, 2]}),
)


def test_merge(spark):
    got = merged(spark, *FILES)
    one = got["1"]
    assert one.name == "quote" and one.concepts_eastmoney == ["x", "y"] and one.industry == "i"
    assert [tuple(c) for c in one.concepts_ths] == [("n", "d")]
    assert one["info"] == {"k": "v", "pe": "9", "price": "0.00"}
    assert one.sources == ["eastmoney", "tencent", "ths"]
    assert one.extra == {"note": '{"a":1}'}
    two, three = got["2"], got["3"]
    assert (two.name, two.industry, two.concepts_eastmoney, two["info"]) == ("only", "", [], {})
    # A source without a role of its own gives its name and open keys only.
    assert (three.name, three["info"], three.concepts_eastmoney, three.extra) == ("", {}, [], {"deep": "[1,2]"})


def test_merge_rank_decides(spark):
    got = merged(spark, *FILES, rank=["ths", "tencent", "eastmoney"])["1"]
    assert got.name == "web" and got.sources == ["ths", "tencent", "eastmoney"] and got.extra == {"note": "b"}


def test_sources_without_a_rank_come_last(spark):
    everything = merged(spark, *FILES)
    some = merged(spark, *FILES, rank=["ths"])
    assert set(some) == set(everything)
    assert some["1"].sources[0] == "ths" and set(some["1"].sources) == set(everything["1"].sources)


def test_merge_of_very_many_sources(spark):
    """No limit of sources, and a plan that does not grow with them."""
    files = [(f"s{i:04d}", "1", {"name": "" if i < 3 else f"n{i}", "key": str(i)}) for i in range(2000)]
    files += [("ths", "1", {"name": "web", "industry": "i"})] + [("s0005", "2", {"name": f"{j}"}) for j in range(300)]
    table = drafts(spark, *files)
    got = {r.code: r for r in merge.merge_drafts(table, ["s1999", "ths"]).collect()}
    one = got["1"]
    assert one.sources == ["s1999", "ths", *[f"s{i:04d}" for i in range(1999)]]
    assert (one.name, one.industry, one.extra) == ("n1999", "i", {"key": "1998"})
    assert got["2"].sources == ["s0005"]
    assert merge.merge_drafts(table.where("false")).count() == 0

    def plan(df):
        return len(merge.merge_drafts(df)._jdf.queryExecution().optimizedPlan().toString())

    assert plan(table) < 1.2 * plan(drafts(spark, *files[:2]))


def test_repeated_boards_are_counted(spark):
    table = merge.merge_drafts(drafts(
        spark, ("eastmoney", "1", {"concepts": ["x", "y"], "concept_copies": "[2,1]"}), ("eastmoney", "2", {"concepts": ["x"]}),
        ("eastmoney", "3", {"concepts": ["x"], "concept_copies": "odd"})))
    got = {r.code: (r.n_boards, r.n_web, r.n_concepts) for r in merge.concept_counts(table).collect()}
    assert got == {"1": (3, 0, 3), "2": (1, 0, 1), "3": (1, 0, 1)}


def test_draft_folder(spark, folder):
    rows = [(f"{s}/{c}.json", json.dumps(b)) for s, c, b in FILES]
    rows += [("merged/1.json", "{}"), ("ths/stock_list.json", "{}")]
    write_files(spark.createDataFrame(rows, "name string, content string"), folder)
    found = read_drafts(spark, folder)
    assert sorted((r.source, r.code) for r in found.collect()) == sorted((s, c) for s, c, _ in FILES)
    out = folder + "-out"
    first = jobs.job_merge_all(spark, folder, out).orderBy("code").collect()
    again = jobs.job_merge_all(spark, folder, out).orderBy("code").collect()
    assert first == again and len(first) == 3
    tables.write_merged(merge.merge_drafts(found), folder + "-json", fmt="json")
    assert spark.read.json(folder + "-json").count() == 3


def test_drafts_are_listed_and_opened_in_tasks(spark, folder, monkeypatch):
    """The driver holds no list of the files; which of them count is as before."""
    names = ["a/1.json", "a/2 {x}+%41.json", "a/deep/er/3.json", "a/_b=c.json", "4.json", "merged/below/5.json", "k=v/6.json"]
    other = ["a/.7.json", "a/_8.json", "a/_metadata9.json", ".h/10.json", "_h/11.json", "merged/12.json", "a/stock_list.json", "a/13.txt"]
    rows = [(n, '{"name":"é"}') for n in names + other] + [("a/empty.json", "")]
    write_files(spark.createDataFrame(rows, "name string, content string"), folder)
    found = read_drafts(spark, folder)
    assert found.inputFiles() == []
    got = sorted((r.source, r.code, r.name) for r in found.collect())
    root = folder.rsplit("/", 1)[-1]
    assert got == sorted((f"{root}/{n}".split("/")[-2], n.split("/")[-1][:-5], "é") for n in names)
    assert sorted(r.code for r in read_drafts(spark, folder + "/{a,k=v}").collect()) == ["1", "2 {x}+%41", "3", "6", "_b=c"]
    monkeypatch.setattr(sources, "in_reach", lambda *a: False)
    assert sorted((r.source, r.code, r.name) for r in read_drafts(spark, folder).collect()) == got
    with pytest.raises(AnalysisException):
        read_drafts(spark, folder + "-none")


def test_merge_job_lists_drafts_in_tasks(spark, folder, monkeypatch):
    monkeypatch.setattr(files, "NAMES_AT_ONCE", 2)
    monkeypatch.setattr(files, "BYTES_AT_ONCE", 1)
    rows = [(f"{s}/{i}.json", json.dumps({"name": f"{s}{i}"})) for s in ("eastmoney", "ths", "merged") for i in range(9)]
    write_files(spark.createDataFrame(rows, "name string, content string"), folder)
    real, inputs = merge.merge_drafts, []
    monkeypatch.setattr(merge, "merge_drafts", lambda d, *a: inputs.extend(d.inputFiles()) or real(d, *a))
    merged = jobs.job_merge_all(spark, folder, folder + "-out")
    assert inputs == []
    assert sorted((r.code, r.name) for r in merged.collect()) == [(str(i), f"eastmoney{i}") for i in range(9)]


def test_assembled_document(spark):
    text = {r.code: r.content for r in merge.assemble_documents(merge.merge_drafts(drafts(spark, *FILES))).collect()}
    assert text["1"] == "# quote (1)\n\n所属行业: i\n\n## 核心题材\n- n: d\n\n## 所属板块\nx、y"
    assert text["2"] == "# only (2)"


def test_outcomes(spark):
    rows = spark.createDataFrame(
        [("a", True, 2), ("a", True, 0), ("a", False, None), ("b", True, None)], "source string, landed boolean, n_concepts int"
    )
    got = {r.source: (r.success, r.empty, r.no_data) for r in merge.outcome_counts(rows).collect()}
    assert got == {"a": (1, 1, 1), "b": (1, 0, 0)}


def test_repeated_membership_is_told(spark):
    stocks = spark.createDataFrame([("1", "A", 0), ("2", "B", 1)], "code string, name string, pos int")
    membership = spark.createDataFrame(
        [(0, "x", "1"), (0, "x", "1"), (1, "y", "1"), (1, "y", "2")], "concept_pos int, concept string, code string"
    )
    items = spark.createDataFrame([("1", 0, " k ", "v"), ("1", 1, "k", "w"), ("1", 2, "z", " ")], "code string, pos int, key string, value string")
    got = {r.code: r for r in jobs.collect_boards(stocks.drop("pos"), membership, items).collect()}
    assert got["1"].concepts == ["x", "y"] and got["1"].extra == {"concept_copies": "[2,1]"}
    assert got["1"]["info"] == {"k": "w"} and got["2"].extra is None and got["2"]["info"] == {}
