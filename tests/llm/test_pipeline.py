import random
import re

import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from tests.llm.test_jaccard import copies, grams
from tests.llm.test_substrings import brute
from themeloom.llm import packing
from themeloom.session import scratch_path


def stage(spark, name, docs, sf="/nowhere"):
    out = dict(corpus_pipeline.STAGES)[name](spark, docs, sf)
    path = scratch_path(spark, "stage")
    out.write.parquet(path)
    return spark.read.parquet(path)


def docs_of(spark, rows):
    return spark.createDataFrame(
        [(i, t, "en", "s", len(t or ""), "__row") for i, t in rows],
        "doc_id long, text string, lang string, source string, n_chars long, __extra string")


def test_names_and_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "lines", "near_duplicates", "substrings", "packing"]


def test_odd_rows_pass_every_stage(spark, sf):
    real = spark.read.parquet(f"{sf}/documents.parquet").limit(60)
    extra = [(None, None), (9001, ""), (9002, " \n "), (9003, "word " * 30_000), (9004, "a"), (9004, "a"), (None, "null id text here")]
    docs = real.unionByName(docs_of(spark, extra).drop("__extra"))
    for name, _ in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, name, docs, sf)
        assert out.columns == docs.columns
        assert stage(spark, name, docs.limit(0), sf).count() == 0
        docs = out
    assert stage(spark, "packing", docs, sf).count() >= docs.count()
    assert stage(spark, "packing", docs.limit(0), sf).count() == 0


def test_language_rejects_only_what_is_odd(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    pick = random.Random(1)
    far = " ".join("".join(pick.choices("ЖЩЫЭЮЯФЦ", k=7)) for _ in range(80))
    odd = docs_of(spark, [(9001, None), (9002, "123 456"), (9003, far)]).drop("__extra")
    kept = {r["doc_id"] for r in stage(spark, "language", docs.unionByName(odd), sf).collect()}
    clean = {r["doc_id"] for r in docs.collect()}
    assert not kept & {9001, 9002, 9003} and len(clean - kept) <= 0.01 * len(clean)


def test_near_duplicates_keep_one_of_each_class(spark):
    rows = copies(4, 10, 8)
    kept = {r["doc_id"] for r in stage(spark, "near_duplicates", docs_of(spark, rows)).collect()}
    sets = {i: grams(t, 5) for i, t in rows}
    near = lambda a, b: len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])
    up = {i: i for i in sets}

    def top(v):
        while up[v] != v:
            v = up[v]
        return v

    for a in sets:
        for b in sets:
            if a < b and near(a, b):
                up[max(top(a), top(b))] = min(top(a), top(b))
    assert kept == {top(i) for i in sets}


def test_whole_run_equals_its_stages_done_plainly(spark, sf):
    """From what the second stage kept, classes, passages and packing by brute force."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for name in ("language", "lines"):
        docs = stage(spark, name, docs, sf)
    rows = sorted((r["doc_id"], r["text"]) for r in docs.collect())
    sets = {i: grams(t, 5) for i, t in rows}
    by, up = {}, {i: i for i, _ in rows}
    for i, s in sets.items():
        for g in s:
            by.setdefault(g, []).append(i)

    def top(v):
        while up[v] != v:
            v = up[v]
        return v

    for i, s in sets.items():
        for j in {j for g in s for j in by[g] if j > i}:
            if len(s & sets[j]) >= 0.8 * len(s | sets[j]):
                up[max(top(i), top(j))] = min(top(i), top(j))
    one = [(i, t) for i, t in rows if top(i) == i]
    left = {i: k for i, _, _, k in brute(one, 50)}
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    # Tokens do not depend on white space, so the words joined by one space do.
    want = {i: len(library.encode(" ".join(re.findall(r"[^\x20\x09-\x0D]+", k)), add_special_tokens=False).ids) + 1
            for i, k in left.items()}
    got, rooms = {}, {}
    for r in corpus_pipeline.run(spark, sf).collect():
        got[r["doc_id"]] = got.get(r["doc_id"], 0) + r["length"]
        rooms[r["sequence_id"]] = rooms.get(r["sequence_id"], 0) + r["length"]
    assert got == want
    assert max(rooms.values()) <= packing.CAPACITY
