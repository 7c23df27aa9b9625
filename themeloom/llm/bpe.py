"""BPE encoding and decoding with a given vocabulary file.

A text is cut into pre-tokens by the rules of the vocabulary file.  In a short
pre-token, a list holds the merge ranks of neighbouring symbols and the least is merged
until none is left.  In a long one the symbols form a doubly linked list; a priority
queue holds the merge ranks of neighbours, and entries whose symbols have changed
meanwhile are skipped.  Decoding joins the vocabulary strings, as a file without a
decoder asks for.

Work is per row, so there is no shuffle.  The vocabulary (a file of a fixed size) is
the only thing sent to the tasks.

Defined results: a null text is an empty text (no ids, empty decoded text); repeated
rows give repeated results; other columns are left aside; a null id column stays null;
an empty table gives an empty table.  A text of any length is encoded whole.
"""

from __future__ import annotations

import hashlib
import json
import re
import sys
import types
import unicodedata
from array import array
from collections.abc import Iterable, Iterator
from heapq import heapify, heappop, heappush

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Pre-tokens remembered by a worker, twice: the newer and the older half.  Only speed
# depends on it; the memory is held by every Python worker of an executor, across tasks.
REMEMBERED = 150_000
LONGEST_REMEMBERED = 64
# Bytes of ids or text in one outgoing batch.
BATCH_BYTES = 4 << 20

# White space as the pattern library of the vocabulary file sees it.
WHITE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
NOT_WHITE = regex.compile(f"[^{WHITE}]+")
# Code points that newer character tables than those of the vocabulary's
# library call letters or numbers, and capitals that only that library lowers, as
# (first, last, distance to the first lower-case one).
NO_LETTERS = (
    "\u0558\u058b-\u058c\u088f\u0c5c\u0cdc\u208f\u209d-\u209f\ua7ce-\ua7cf\ua7d2\ua7d4\ua7dd\ua7e2\ua7f1"
    "\uab6c-\uab6d\U000107bb-\U000107bf\U00010940-\U00010959\U00010ec5-\U00010ec7\U00010ed9-\U00010eee\U00011b0a"
    "\U00011db0-\U00011ddb\U00011df1\U00016ea0-\U00016eb8\U00016ebb-\U00016ed3\U00016ff2-\U00016ff3"
    "\U000187f8-\U000187ff\U00018cd6-\U00018cda\U00018d09-\U00018d20\U00018d80-\U00018df2\U00018e00-\U00019191"
    "\U000191a0-\U000191d2\U0001b123-\U0001b128\U0001b168\U0001d6a6\U0001df1f-\U0001df24\U0001df2b-\U0001df81"
    "\U0001df90-\U0001df96\U0001dfcd-\U0001dfff\U0001e6c0-\U0001e6de\U0001e6e0-\U0001e6e2\U0001e6e4-\U0001e6e5"
    "\U0001e6e7-\U0001e6ed\U0001e6f0-\U0001e6f4\U0001e6fe-\U0001e6ff\U0002b73a-\U0002b73f\U0002b81e"
    "\U0002cea2-\U0002cead\U000323b0-\U00033479\U0003d000-\U0003fc3f"
)
NO_NUMBERS = "\U00011de0-\U00011de9\U0001246f\U00012475-\U0001247f\U00012550-\U00012686\U00016ff4-\U00016ff6"
LOWERED = (
    (0x1c89, 0x1c89, 1), (0xa7cb, 0xa7cb, -42343), (0xa7cc, 0xa7cc, 1), (0xa7ce, 0xa7ce, 1), (0xa7d2, 0xa7d2, 1), (0xa7d4, 0xa7d4, 1), (0xa7da, 0xa7da, 1), (0xa7dc, 0xa7dc, -42561), (0x10d50, 0x10d65, 32), (0x16ea0, 0x16eb8, 27),
)
MORE_LOWERED = {c: c + by for first, last, by in LOWERED for c in range(first, last + 1)}
RARE_CAPITAL = re.compile("[" + "".join(map(chr, MORE_LOWERED)) + "]")
# Marks that are a pre-token of their own after letters.
SINGLE_MARKS = frozenset(".,;:!?")
ODD_FOR_SPLIT = regex.compile("[\\x1c-\\x1f]")
# Above every rank and new id of a pair.
NO_MERGE = 1 << 62
# Bytes of a pre-token up to which a list of its pairs, searched whole at each merge, is
# quicker than a priority queue.  Only speed depends on it.
SHORT_PIECE = 64


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    signs = {b: chr(b) for b in plain}
    for b in range(256):
        if b not in signs:
            signs[b] = chr(256 + len(signs) - len(plain))
    return [signs[b] for b in range(256)]


def has_rare_capital(text: str) -> bool:
    """Whether ``text`` has one of ``MORE_LOWERED``; texts of Latin letters only are told apart quickly."""
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return RARE_CAPITAL.search(text) is not None
    return False


class Codec:
    """Encoder and decoder of one vocabulary file (byte level, word ends)."""

    def __init__(self, content: bytes):
        spec = json.loads(content)
        model = spec["model"]
        vocab, end = model["vocab"], model["end_of_word_suffix"] or ""
        signs = byte_symbols()
        self.inner = [vocab[s] for s in signs]
        self.last = [vocab[s + end] for s in signs]
        self.merges = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            # Pair of ids -> rank and new id, each as one number; ids stay below 2^20.
            self.merges[vocab[a] << 20 | vocab[b]] = rank << 20 | vocab[a + b]
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special = {k: array("I", [v]).tobytes() for k, v in special.items()}
        self.special_pattern = (
            regex.compile("(" + "|".join(map(regex.escape, sorted(special, key=len, reverse=True))) + ")")
            if special else None
        )
        self.strings = [""] * (1 + max([*vocab.values(), *special.values()]))
        for text, i in [*vocab.items(), *special.items()]:
            self.strings[i] = text
        split = next(
            p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split"
        )
        # The same classes as the library's, without what newer tables have added.
        letters, numbers = f"[\\p{{L}}--[{NO_LETTERS}]]", f"[\\p{{N}}--[{NO_NUMBERS}]]"
        self.pieces = regex.compile("(?V1)" + split["pattern"]["Regex"].replace("[\\p{L}]+", letters + "+").replace(
            "[\\p{N}]|", numbers + "|").replace("[^\\s\\p{L}\\p{N}]+", f"[^\\s{letters}{numbers}]+"))
        self.new: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        # Runs without white space that are not one pre-token, as the pre-tokens above.
        self.runs: dict[str, bytes] = {}
        self.old_runs: dict[str, bytes] = {}

    def merge(self, piece: str) -> bytes:
        """Ids of one pre-token: the lowest rank merges first, the leftmost of equals."""
        raw = piece.encode()
        ids = [self.inner[b] for b in raw]
        ids[-1] = self.last[raw[-1]]
        if len(ids) > SHORT_PIECE:
            return self.merge_long(ids)
        if len(ids) > 1:
            # ranks[i]: rank and new id of the pair (ids[i], ids[i + 1]), NO_MERGE if none.
            # A rank names one pair, so the first place of the least value is the leftmost
            # of the lowest rank; only the two pairs beside a merge change.
            get = self.merges.get
            ranks = [get(a << 20 | b, NO_MERGE) for a, b in zip(ids, ids[1:])]
            while ranks:
                least = min(ranks)
                if least == NO_MERGE:
                    break
                i = ranks.index(least)
                new = ids[i] = least & 0xFFFFF
                del ids[i + 1], ranks[i]
                if i < len(ranks):
                    ranks[i] = get(new << 20 | ids[i + 1], NO_MERGE)
                if i:
                    ranks[i - 1] = get(ids[i - 1] << 20 | new, NO_MERGE)
        return array("I", ids).tobytes()

    def merge_long(self, ids: list[int]) -> bytes:
        """``merge`` of a long pre-token, from its byte ids, in time n log n."""
        n, merges = len(ids), self.merges
        queue, left = [], ids[0]
        for i in range(n - 1):
            right = ids[i + 1]
            found = merges.get(left << 20 | right)
            if found is not None:
                queue.append(found << 32 | i)
            left = right
        if queue:
            heapify(queue)
            after, before = list(range(1, n + 1)), list(range(-1, n - 1))
            while queue:
                entry = heappop(queue)
                i = entry & 0xFFFFFFFF
                j = after[i]
                # Stale: a side is gone or has become another symbol.
                if ids[i] < 0 or j >= n or merges.get(ids[i] << 20 | ids[j]) != entry >> 32:
                    continue
                new = entry >> 32 & 0xFFFFF
                ids[i], ids[j] = new, -1
                k = after[i] = after[j]
                if k < n:
                    before[k] = i
                    found = merges.get(new << 20 | ids[k])
                    if found is not None:
                        heappush(queue, found << 32 | i)
                h = before[i]
                if h >= 0:
                    found = merges.get(ids[h] << 20 | new)
                    if found is not None:
                        heappush(queue, found << 32 | h)
            ids = [i for i in ids if i >= 0]
        return array("I", ids).tobytes()

    def piece(self, piece: str) -> bytes:
        """Ids of one pre-token, remembered if it is short."""
        ids = self.new.get(piece)
        if ids is None:
            ids = self.old.get(piece)
            if ids is None:
                ids = self.merge(piece)
            if len(piece) <= LONGEST_REMEMBERED:
                if len(self.new) >= REMEMBERED:
                    self.old, self.new = self.new, {}
                self.new[piece] = ids
        return ids

    def chunk(self, word: str) -> bytes:
        """Ids of a run without white space, remembered if it is short."""
        if word.isalpha():
            return self.piece(word)
        ids = self.runs.get(word)
        if ids is None:
            ids = self.old_runs.get(word)
            if ids is None:
                if word[-1] in SINGLE_MARKS and word[:-1].isalpha():
                    ids = self.piece(word[:-1]) + self.piece(word[-1])
                else:
                    ids = b"".join(map(self.piece, self.pieces.findall(word)))
            if len(word) <= LONGEST_REMEMBERED:
                if len(self.runs) >= REMEMBERED:
                    self.old_runs, self.runs = self.runs, {}
                self.runs[word] = ids
        return ids

    def ordinary(self, text: str) -> list[bytes]:
        if not text.isascii():
            if not unicodedata.is_normalized("NFC", text):
                text = unicodedata.normalize("NFC", text)
            # A capital sigma is lowered without looking at its neighbours.
            text = text.replace("Σ", "σ").lower()
            if has_rare_capital(text):
                text = text.translate(MORE_LOWERED)
        else:
            text = text.lower()
        words = NOT_WHITE.findall(text) if ODD_FOR_SPLIT.search(text) else text.split()
        chunk, out = self.chunk, []
        for word in words:
            # Pre-tokens are runs without white space too, so one memory serves both.
            ids = self.new.get(word)
            out.append(chunk(word) if ids is None else ids)
        return out

    def encode(self, text: str | None) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        if not text:
            return b""
        if self.special_pattern and "<|" in text:
            parts = []
            for part in self.special_pattern.split(text):
                parts += [self.special[part]] if part in self.special else self.ordinary(part)
            return b"".join(parts)
        return b"".join(self.ordinary(text))

    def decode(self, ids: bytes) -> str:
        strings = self.strings
        return " ".join([strings[i] for i in array("I", ids)])


def codec(content: bytes) -> Codec:
    """One codec per worker and vocabulary, so that its memory lasts over tasks.

    Functions reach tasks by value, and with them the globals of this module; the table
    of loaded modules stays with the worker.
    """
    held = sys.modules.setdefault("themeloom_codecs", types.ModuleType("themeloom_codecs"))
    key = hashlib.sha256(content).hexdigest()
    own = vars(held).get(key)
    if own is None:
        own = Codec(content)
        setattr(held, key, own)
    return own


def vocabulary(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def in_parts(rows: Iterable[tuple], schema: pa.Schema, weigh) -> Iterator[pa.RecordBatch]:
    """Rows as batches of a bounded size."""
    part, held = [], 0
    for row in rows:
        part.append(row)
        held += weigh(row)
        if held >= BATCH_BYTES or len(part) >= 4096:
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*part), schema.types)], schema=schema)
            part, held = [], 0
    if part:
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(zip(*part), schema.types)], schema=schema)


def _id_type(df: DataFrame, id_col: str) -> tuple[str, pa.DataType]:
    from pyspark.sql.pandas.types import to_arrow_type

    field = df.schema[id_col]
    return field.dataType.simpleString(), to_arrow_type(field.dataType)


def round_trip(
    df: DataFrame, vocab_path: str, id_col: str = "doc_id", text_col: str = "text",
    decoded: bool = True,
) -> DataFrame:
    """Ids of every text and, if asked for, the text decoded from these ids.

    Returns ``id_col``, ``n_tokens``, ``ids`` (little-endian unsigned 32-bit) and
    ``decoded``.  Both directions run in one pass, so ids cross to Python and back once.
    """
    sent = df.sparkSession.sparkContext.broadcast(vocabulary(vocab_path))
    kind, arrow_kind = _id_type(df, id_col)
    fields = [("_id", arrow_kind), ("n_tokens", pa.int64()), ("ids", pa.binary())]
    fields += [("decoded", pa.string())] if decoded else []
    schema = pa.schema(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(sent.value)

        def rows():
            for batch in batches:
                for key, text in zip(batch.column(0), batch.column(1)):
                    ids = own.encode(text.as_py())
                    row = (key.as_py(), len(ids) // 4, ids)
                    yield (*row, own.decode(ids)) if decoded else row

        return in_parts(rows(), schema, lambda r: len(r[2]) + (len(r[3]) if decoded else 0))

    ddl = f"_id {kind}, n_tokens long, ids binary" + (", decoded string" if decoded else "")
    out = df.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"))
    return out.mapInArrow(run, ddl).withColumnRenamed("_id", id_col)


def encode(df: DataFrame, vocab_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, ``n_tokens`` and ``ids`` of every text."""
    return round_trip(df, vocab_path, id_col, text_col, decoded=False)


def decode(df: DataFrame, vocab_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """``id_col`` and ``decoded``: the vocabulary strings of the ids, one space between.

    Null ids decode to an empty text; an id outside the vocabulary fails the task.
    """
    sent = df.sparkSession.sparkContext.broadcast(vocabulary(vocab_path))
    kind, arrow_kind = _id_type(df, id_col)
    schema = pa.schema([("_id", arrow_kind), ("decoded", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(sent.value)
        rows = (
            (key.as_py(), own.decode(ids.as_py() or b""))
            for batch in batches for key, ids in zip(batch.column(0), batch.column(1))
        )
        return in_parts(rows, schema, lambda r: len(r[1]))

    out = df.select(F.col(id_col).alias("_id"), F.col(ids_col).alias("_ids"))
    return out.mapInArrow(run, f"_id {kind}, decoded string").withColumnRenamed("_id", id_col)
