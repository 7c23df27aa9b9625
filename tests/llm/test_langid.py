import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from themeloom.llm import langid, queries
from themeloom.llm.words import slices

ENGLISH = "the quick brown fox jumps over the lazy dog and then it runs away from the other animals "
GERMAN = "der schnelle braune fuchs springt über den faulen hund und dann läuft er weg von den tieren "


@pytest.fixture(scope="module")
def model(spark):
    rows = [(i, (ENGLISH if i % 2 else GERMAN)[i:] * (1 + i % 5), "en" if i % 2 else "de") for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    return langid.fit(df)


def test_rejects_only_what_is_far_away(spark, model):
    pick = random.Random(3)
    far = " ".join("".join(pick.choices("zqxjvwkй", k=6)) for _ in range(30))
    cases = {
        1: (ENGLISH, "en", False), 2: (GERMAN.upper(), "de", False), 3: (None, "und", True),
        4: ("12 34 !!", "und", True), 5: ("", "und", True), 6: (far, None, True),
        7: ("a", "de", False), 8: (ENGLISH * 2000, "en", False), 9: ("ж", "de", False),
    }
    rows = [(k, v[0], "x") for k, v in cases.items()] + [(1, ENGLISH, "y")]
    df = spark.createDataFrame(rows, "doc_id long, text string, score string")
    got = langid.predict(df, model).collect()
    assert len(got) == len(rows)
    for r in got:
        _, lang, rejected = cases[r["doc_id"]]
        assert lang is None or r["lang_pred"] == lang, r
        assert r["rejected"] == rejected, r
        assert 0 <= r["score"] <= 1


def test_junk_longer_than_all_labelled_texts_is_rejected(model):
    pick = random.Random(5)
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
    junk = ["".join(pick.choices(letters, k=n)) for n in (500, 1000, 4000, 40_000)]
    part = next(slices(pa.array([*junk, ENGLISH * 500])))
    bands = langid.size_band(langid.counts(part))
    learned = langid.size_band(langid.counts(next(slices(pa.array([ENGLISH * 5, GERMAN * 5]))))).max()
    assert bands[3] > learned + 2
    assert langid.judge(model, part)[2].tolist() == [True, True, True, True, False]
    # Sizes below the smallest learned one have no limit, larger ones all have one.
    held = np.flatnonzero(model.limits)
    assert held[-1] == langid.SIZE_BANDS - 1 and (np.diff(held) == 1).all()


def test_copies_of_a_text_do_not_starve_its_language(spark):
    words = GERMAN.split()
    rows = [(f"{words[i % 17]} {GERMAN[i:]} {words[i % 13]}", "de") for i in range(40)] + [(ENGLISH, "en")] * 3
    copies = spark.range(300_000).select(F.lit("seite nicht gefunden").alias("text"), F.lit("de").alias("lang"))
    df = spark.createDataFrame(rows, "text string, lang string").union(copies)
    model = langid.fit(df)
    assert model.languages == ["de", "en"]
    lang, _, rejected = langid.judge(model, next(slices(pa.array([GERMAN * 3, ENGLISH * 3]))))
    assert lang.tolist() == ["de", "en"] and not rejected.any()
    # A small sample has different texts in it, whichever are copied.
    few = langid.fit(df, per_language=20)
    assert few.languages == ["de", "en"]


def test_nothing_to_learn_from_and_empty_tables(spark):
    df = spark.createDataFrame([(1, "abc", None), (2, None, "en")], "doc_id long, text string, lang string")
    model = langid.fit(df)
    assert model is None
    assert {r["lang_pred"] for r in langid.predict(df, model).collect()} == {"und"}
    assert langid.fit(df.limit(0)) is None
    assert langid.predict(df.limit(0), model).count() == 0


def test_trigram_counts_equal_a_plain_count():
    texts = ["Über DEN, den", "", "ab", "é" * 5]
    part = next(slices(pa.array(texts)))
    got = langid.counts(part)
    for text, row in zip(texts, got):
        raw = bytes(b if 97 <= b < 123 or b >= 128 else 32 for b in text.lower().encode())
        plain = sum(raw[i + 1] != 32 for i in range(len(raw) - 2))
        assert row.sum() == plain
    assert np.array_equal(langid.counts(next(slices(pa.array(["DEN den"]))))[0],
                          langid.counts(next(slices(pa.array(["den den"]))))[0])


def test_held_out_accuracy(spark, sf):
    docs = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = queries.op6_langid(spark, sf).collect()
    assert len(got) == len(docs)
    held = [r for r in got if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in got)
    right = sum(docs[r["doc_id"]] == r["lang_pred"] for r in held)
    assert right >= 0.95 * len(held)
    assert sum(r["rejected"] for r in got) <= 0.01 * len(got)
