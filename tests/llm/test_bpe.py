from array import array
import sys

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from themeloom.llm import bpe, queries

PATH = public_tokenizers.path("word_bpe_49k.json")
ODD = [
    "", " ", "Don't 'S it's  a\x1cb\x85c", "<|endoftext|>Hello<|startoftext|> x <|foo|>",
    "ΑΣ Σ ΣΑΣ. ΌΣΟΣ", "é ﬁ Å", "日本語 テスト 🤔 ١٢٣ ½", "İI ẞ ß", "a" * 20_000,
    "Ab1 c2d'''re 's 't're", "x\x00y", " a　b c", "same same same", None,
]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def test_ids_and_text_equal_the_library(spark, library):
    rows = [(i, t, "x") for i, t in enumerate(ODD)] + [(0, ODD[3], "y")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = bpe.round_trip(df, PATH).collect()
    assert len(got) == len(rows)
    texts = {(i, t or "") for i, t, _ in rows}
    for r in got:
        ids = list(array("I", bytes(r["ids"])))
        assert r["n_tokens"] == len(ids)
        assert any(
            i == r["doc_id"] and ids == library.encode(t, add_special_tokens=False).ids
            for i, t in texts
        )
        assert r["decoded"] == library.decode(ids, skip_special_tokens=False)


def test_decode_alone_and_empty_tables(spark):
    df = spark.createDataFrame([(1, "Hello world"), (2, None)], "doc_id long, text string")
    coded = bpe.encode(df, PATH)
    assert {(r[0], r[1]) for r in bpe.decode(coded, PATH).collect()} == {
        (1, "hello</w> world</w>"), (2, "")}
    assert bpe.round_trip(df.limit(0), PATH).count() == 0


def test_query_equals_the_library(spark, sf, library):
    import hashlib

    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    want = set()
    for d in docs:
        ids = library.encode(d["text"] or "", add_special_tokens=False).ids
        text = library.decode(ids, skip_special_tokens=False)
        want.add((
            d["doc_id"], len(ids), hashlib.sha256(array("I", ids).tobytes()).hexdigest(),
            hashlib.sha256(text.encode()).hexdigest(),
        ))
    got = queries.op1_bpe(spark, sf)
    assert dict(got.dtypes)["n_tokens"] == "bigint"
    assert {tuple(r) for r in got.collect()} == want
    assert got.where(F.col("doc_id").isNull()).count() == 0


def test_every_code_point_as_the_library():
    """Letters, numbers and lower case are those of the library's tables, not of Python's."""
    from array import array

    path = queries.WORD_VOCAB
    own, theirs = bpe.Codec(bpe.vocabulary(path)), Tokenizer.from_file(path)
    theirs.no_truncation()
    theirs.no_padding()
    points = [chr(c) for c in range(1, 0x110000) if not 0xD800 <= c < 0xE000]
    for at in range(0, len(points), 4096):
        text = " ".join(f"a{c}b {c}1{c}" for c in points[at:at + 4096])
        assert list(array("I", own.encode(text))) == theirs.encode(text, add_special_tokens=False).ids, hex(at)


def test_short_and_long_pieces_and_runs_as_the_library(library):
    """Pre-tokens on both sides of ``SHORT_PIECE`` (list and queue), with repeated pairs,
    and runs with a mark, which are remembered whole and met again."""
    syllables = ["th", "e", "an", "ing", "a", "ble", "tion", "sh", "nd", "ou"]
    words = [
        "".join(syllables[(i * 7 + j * 3) % len(syllables)] for j in range(n))
        for i in range(12) for n in (1, 2, 5, 13, 21, 22, 23, 40)
    ]
    words += ["a" * n for n in (1, 2, 3, 63, 64, 65, 129)] + ["é" * 40, "ab" * 33]
    text = " ".join(w + m for w in words for m in ("", ".", "!x,", ""))
    own = bpe.Codec(bpe.vocabulary(PATH))
    for _ in range(2):
        assert list(array("I", own.encode(text))) == library.encode(text, add_special_tokens=False).ids
    assert own.runs and all(len(k) <= bpe.LONGEST_REMEMBERED for k in own.runs)
    for n in (bpe.SHORT_PIECE - 1, bpe.SHORT_PIECE, bpe.SHORT_PIECE + 1):
        raw = ("thing" * n)[:n].encode()
        ids = [own.inner[b] for b in raw]
        ids[-1] = own.last[raw[-1]]
        assert own.merge(raw.decode()) == own.merge_long(ids)


def _spelled(i: int) -> str:
    out = "q"
    while i:
        i, r = divmod(i, 26)
        out += chr(97 + r)
    return out


def test_what_a_worker_remembers_stays_small():
    # Every Python worker of an executor keeps its codec over tasks: all its memories
    # together stay well below 100 MB, however many distinct words it meets.
    own = bpe.Codec(bpe.vocabulary(PATH))
    words = [_spelled(i) for i in range(700_000)]
    own.encode(" ".join(words) + " " + " ".join(w + "." for w in words))
    held = sum(
        sys.getsizeof(d) + sum(sys.getsizeof(k) + sys.getsizeof(v) for k, v in d.items())
        for d in (own.new, own.old, own.runs, own.old_runs)
    )
    assert held < 100e6
