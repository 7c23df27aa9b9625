import collections
import math
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from themeloom.llm import lm, queries
from themeloom.llm.words import slices


def tokens(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x20\x09-\x0D]+", low) + [None]


def base(train, texts):
    c = collections.Counter(t for x in train for t in tokens(x))
    n, v = sum(c.values()), len(c)
    return n, [
        (len(tokens(x)), sum(c[t] > 0 for t in tokens(x)),
         sum(math.log10((c[t] + 1) / (n + v + 1)) for t in tokens(x)))
        for x in texts
    ]


def test_counts_and_base_equal_a_plain_count(spark, monkeypatch):
    monkeypatch.setattr(lm, "HEAD", 40)
    train = [f"The cat{i % 7} sat on mat{i}. É {'la ' * (i % 5)}" for i in range(60)] + [None, ""]
    other = ["THE cat1 flew", None, "", "new NEW words É", "x" * 5000, "the " * 3000]
    rows = [(i, t, True) for i, t in enumerate(train)] + [(100 + i, t, False) for i, t in enumerate(other)]
    rows += [(100, other[0], False)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, seen boolean, n int")
    got = sorted(map(tuple, lm.score(df, F.col("seen")).collect()))
    n, want = base(train, [r[1] for r in rows])
    want = sorted((r[0], *w[:2], n, w[2]) for r, w in zip(rows, want))
    assert len(got) == len(want)
    for g, w in zip(got, want):
        assert g[:4] == w[:4] and g[4] == pytest.approx(w[4], rel=1e-9)
        assert g[5] < 0 and math.isfinite(g[5])


def test_nothing_to_learn_from_and_empty_table(spark):
    df = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in lm.score(df, F.lit(False)).collect()}
    assert got[1]["n_tokens"] == 3 and got[1]["n_known"] == 0 and got[1]["train_tokens"] == 0
    assert got[1]["base_score"] == 0 and math.isfinite(got[2]["score"])
    assert lm.score(df.limit(0), F.lit(True)).count() == 0


def softmax(z):
    e = [math.exp(x - max(z)) for x in z]
    return [x / sum(e) for x in e]


def leaf_shares(model, codes):
    """Probability of every leaf after one history, by plain loops."""
    rows = lm.rows_of(codes, model.rows)[:, 0]
    groups = softmax([float(model.group_bias[g]) + sum(float(model.groups[r, g]) for r in rows) for g in range(lm.WAYS)])
    out = []
    for g in range(lm.WAYS):
        own = lm.rows_of(codes, model.rows, np.array([g]))[:, 0]
        ways = softmax([float(model.leaf_bias[g, w]) + sum(float(model.leaves[r, w]) for r in own) for w in range(lm.WAYS)])
        out += [groups[g] * w for w in ways]
    return out


def test_scores_equal_a_plain_model_whose_shares_sum_to_one(spark):
    texts = [f"le chat{i % 9} dort la nuit{i} et le chien{i % 4} aussi" for i in range(200)] + ["le chat1 vole", "", "le le"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    learned = df.where("doc_id < 200").coalesce(1)
    counts = lm.count_words(learned)
    v = lm.vocabulary(counts)
    model = lm.train(learned, v)
    assert np.abs(model.groups).max() > 0 and np.abs(model.leaves).max() > 0
    held = {np.int64(r["word"]).view(np.uint64): (r["n"], r["ending"]) for r in counts.collect()}
    got = {r["doc_id"]: r["score"] for r in lm.score(df.coalesce(1), F.col("doc_id") < 200).collect()}
    for i in (0, 17, 200, 201, 202):
        t = lm.tokens_of(next(slices(pa.array([texts[i]]))))
        codes, leaves, want = lm.features(t), v.classes(t), 0.0
        for at, (word, leaf) in enumerate(zip(t.token, leaves)):
            shares = leaf_shares(model, codes[:, at:at + 1])
            assert sum(shares) == pytest.approx(1)
            within = 1.0
            if leaf >= lm.SINGLES:
                n = held.get(word, (0, 0))[0]
                within = (n - lm.DISCOUNT if n else lm.DISCOUNT * v.class_words[leaf]) / v.class_tokens[leaf] \
                    if v.class_tokens[leaf] > 0 else 1.0
            want += math.log10(shares[leaf] * within)
        # A different task may have learned in another order.
        assert got[i] == pytest.approx(want, rel=1e-3)
    # Within a leaf of endings: known words and the share of unknown ones.
    for c in np.flatnonzero(v.class_tokens[lm.SINGLES:] > 0) + lm.SINGLES:
        own = [n for w, (n, e) in held.items() if e + lm.SINGLES == c and w not in v.singles]
        known = sum((n - lm.DISCOUNT) / v.class_tokens[c] for n in own)
        assert known + lm.DISCOUNT * v.class_words[c] / v.class_tokens[c] == pytest.approx(1)


def test_training_learns_which_word_follows(spark):
    """After each of two words another one follows; no unigram can tell."""
    texts = [" ".join(["un deux" if (i + j) % 2 else "trois quatre" for j in range(40)]) for i in range(120)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    r = lm.score(df, F.col("doc_id") < 100).where("doc_id >= 100").agg(
        F.sum("score").alias("s"), F.sum("base_score").alias("b")).first()
    assert r.s > 0.6 * r.b


def test_rows_without_id_are_scored_and_not_learned_from(spark):
    df = spark.createDataFrame([(None, "a b"), (1, "a c"), (2, "a c")], "doc_id long, text string")
    got = lm.score(df, queries.fold(7) != 2).collect()
    seen = sum(zlib.crc32(str(i).encode()) % 7 != 2 for i in (1, 2))
    assert len(got) == 3 and {r.train_tokens for r in got} == {3 * seen} and all(r.score < 0 for r in got)


def test_tables_grow_with_the_words(spark):
    v = lm.Vocabulary(*[np.zeros(0)] * 3, 0, 0, np.zeros(lm.CLASSES), np.zeros(lm.CLASSES))
    sizes = []
    for v.distinct in (0, 10**6, 3 * 10**6, 10**7, 10**9):
        sizes.append(lm.table_rows(v))
    assert sizes == sorted(sizes) and sizes[0] == lm.LEAST_ROWS and sizes[-1] == lm.MOST_ROWS and len(set(sizes)) >= 4


def test_query_beats_the_base_on_held_out_texts(spark, sf):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    held = {i for i in docs if zlib.crc32(str(i).encode()) % 7 == 2}
    n, want = base([t for i, t in docs.items() if i not in held], list(docs.values()))
    want = dict(zip(docs, want))
    got = queries.op8_lm(spark, sf).collect()
    assert len(got) == len(docs)
    for r in got:
        w = want[r["doc_id"]]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (r["doc_id"] in held, *w[:2], n)
        assert r["base_score"] == pytest.approx(w[2], rel=1e-9)
    out = [r for r in got if r["held_out"]]
    # A tenth fewer digits of surprise than the base.
    assert sum(r["score"] for r in out) > 0.9 * sum(r["base_score"] for r in out)
