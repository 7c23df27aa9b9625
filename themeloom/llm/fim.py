"""Fill-in-middle transformation with cuts at token boundaries.

A text is cut into tokens, its first ``min`` and ``max`` of two hashed counts of tokens are
the prefix and the prefix with the middle.  The code point offsets at which the tokens of
many texts begin are one Roaring-style set: offsets with equal high 16 bits share a
container, which is an array, a bitmap or a list of runs, whichever is smallest.
Cumulative cardinalities lead from the rank of a boundary to its container, a select inside
the container to the offset, so both cuts of every text are two lookups.

Only the two cuts come from Python; texts stay in the JVM, which puts the parts together
and takes them apart.

Defined results: a null text is an empty one; an empty text or one with a marker is plain,
and its output is the text itself; a null id is hashed as an empty one; equal ids with
equal texts give equal rows; an empty table gives an empty one.  Columns other than id and
text are left aside, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from themeloom.llm.words import Slice, slices

# The markers before prefix, suffix and middle.
MARKERS = ("<P>", "<S>", "<M>")
SEED = "1"
TRANSFORMED = 90
SUFFIX_FIRST = 20

# Values that share a container, and the bytes of its three forms.
SPAN = 1 << 16
BITMAP_BYTES = SPAN // 8
LETTER = np.zeros(256, bool)
LETTER[65:91] = LETTER[97:123] = True


class ArrayContainer:
    """The values in order."""

    def __init__(self, values: np.ndarray):
        self.values = values.astype(np.uint16)

    def select(self, ranks: np.ndarray) -> np.ndarray:
        return self.values[ranks].astype(np.int64)


class BitmapContainer:
    """One bit for each possible value, and the number of bits before each word."""

    def __init__(self, values: np.ndarray):
        bits = np.zeros(SPAN, np.uint8)
        bits[values] = 1
        self.words = np.packbits(bits, bitorder="little").reshape(-1, 8)
        counts = np.bitwise_count(self.words).sum(axis=1)
        self.before = np.concatenate([[0], np.cumsum(counts)])

    def select(self, ranks: np.ndarray) -> np.ndarray:
        word = np.searchsorted(self.before, ranks, "right") - 1
        bits = np.unpackbits(self.words[word], axis=1, bitorder="little")
        seen = np.cumsum(bits, axis=1)
        return word * 64 + (seen > (ranks - self.before[word])[:, None]).argmax(axis=1)


class RunContainer:
    """First values of runs of consecutive values, and the number of values before each."""

    def __init__(self, values: np.ndarray):
        begins = np.flatnonzero(np.diff(values, prepend=-2) != 1)
        self.starts = values[begins]
        self.before = begins

    def select(self, ranks: np.ndarray) -> np.ndarray:
        run = np.searchsorted(self.before, ranks, "right") - 1
        return self.starts[run] + ranks - self.before[run]


def container(values: np.ndarray):
    """The smallest form for values below ``SPAN``, which are distinct and in order."""
    runs = 1 + int((np.diff(values) != 1).sum())
    sizes = {RunContainer: 4 * runs, ArrayContainer: 2 * len(values), BitmapContainer: BITMAP_BYTES}
    return min(sizes, key=sizes.get)(values)


class BoundarySet:
    """A set of whole numbers, given distinct and in order, that answers select by rank."""

    def __init__(self, values: np.ndarray):
        self.high, first = np.unique(values // SPAN, return_index=True)
        self.before = np.append(first, len(values))
        self.containers = [
            container(values[a:b] - h * SPAN) for h, a, b in zip(self.high, self.before, self.before[1:])
        ]

    def __len__(self) -> int:
        return int(self.before[-1])

    def select(self, ranks: np.ndarray) -> np.ndarray:
        """The values of the given ranks, which count from 0."""
        at = np.searchsorted(self.before, ranks, "right") - 1
        out = np.zeros(len(ranks), np.int64)
        for c in np.unique(at):
            own = at == c
            out[own] = self.high[c] * SPAN + self.containers[c].select(ranks[own] - self.before[c])
        return out


def boundaries(part: Slice) -> tuple[BoundarySet, np.ndarray, np.ndarray]:
    """Offsets of tokens in the code points of a slice.

    Returns the set of offsets where tokens begin, and the end of the slice; the rank of
    the first token of each row; and the offset of each row, both with an end.
    """
    data, n = part.data, len(part.data)
    lead = (data & 0xC0) != 0x80
    letter = LETTER[data]
    begins = lead.copy()
    begins[1:] &= ~(letter[1:] & letter[:-1])
    edges = part.bounds[:-1]
    begins[edges[edges < n]] = True
    points = np.concatenate([[0], np.cumsum(lead)])
    tokens = np.concatenate([[0], np.cumsum(begins)])
    offsets = np.append(points[:-1][begins], points[-1])
    return BoundarySet(offsets), tokens[part.bounds], points[part.bounds]


def _cuts(texts: pa.Array, one: pa.Array, other: pa.Array) -> pa.Array:
    one, other = (c.to_numpy(zero_copy_only=False) for c in (one, other))
    n, low, high = (np.zeros(len(texts), np.int64) for _ in range(3))
    for part in slices(texts):
        own = slice(part.first, part.first + part.rows)
        found, rank, offset = boundaries(part)
        n[own] = np.diff(rank)
        a, b = one[own] % (n[own] + 1), other[own] % (n[own] + 1)
        low[own] = found.select(rank[:-1] + np.minimum(a, b)) - offset[:-1]
        high[own] = found.select(rank[:-1] + np.maximum(a, b)) - offset[:-1]
    return pa.StructArray.from_arrays([pa.array(n), pa.array(low), pa.array(high)], ["n", "low", "high"])


def _hashed(key: Column, seed: str, group: int) -> Column:
    """A group of eight digits of the key's hash as a number."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256)
    return F.conv(F.substring(digest, 8 * group + 1, 8), 16, 10).cast("long")


def transform(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: str = SEED,
    transformed: int = TRANSFORMED, suffix_first: int = SUFFIX_FIRST, markers: tuple[str, str, str] = MARKERS,
) -> DataFrame:
    """``id_col``, ``text``, ``n``, ``form``, ``prefix_chars``, ``middle_chars`` and ``output`` of each row.

    ``transformed`` percent of the texts are cut, of these ``suffix_first`` percent put the
    suffix before the prefix (``spm``), the others the prefix first (``psm``).
    """
    cuts = F.arrow_udf(_cuts, "struct<n: long, low: long, high: long>")
    key = F.col("_key")
    rows = docs.select(
        F.col(id_col).alias("_key"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    cut = rows.select("*", cuts(F.col("text"), _hashed(key, seed, 0), _hashed(key, seed, 1)).alias("_cut"))
    text, low, high = F.col("text"), F.col("_cut.low").cast("int"), F.col("_cut.high").cast("int")
    marked = F.lit(False)
    for m in markers:
        marked = marked | text.contains(m)
    plain = (text == "") | marked | (_hashed(key, seed, 2) % 100 >= transformed)
    form = F.when(plain, "plain").when(_hashed(key, seed, 3) % 100 < suffix_first, "spm").otherwise("psm")
    formed = cut.select("_key", "text", "_cut", form.alias("form"))
    p, s, m = (F.lit(x) for x in markers)
    prefix, middle = F.substring(text, F.lit(1), low), F.substring(text, low + 1, high - low)
    suffix = F.substring(text, high + 1, F.length(text) - high)
    cut_text = F.col("form") != "plain"
    output = (
        F.when(F.col("form") == "psm", F.concat(p, prefix, s, suffix, m, middle))
        .when(F.col("form") == "spm", F.concat(s, suffix, p, prefix, m, middle)).otherwise(text)
    )
    return formed.select(
        F.col("_key").alias(id_col), "text", F.col("_cut.n").alias("n"), "form",
        F.when(cut_text, F.col("_cut.low")).alias("prefix_chars"),
        F.when(cut_text, F.col("_cut.high") - F.col("_cut.low")).alias("middle_chars"),
        output.alias("output"),
    )


def restore(output: Column, form: Column, markers: tuple[str, str, str] = MARKERS) -> Column:
    """The text that :func:`transform` made ``output`` of.

    The parts hold no marker, and none can arise where a part meets a marker as long as no
    marker's end is the beginning of a marker, so the first find of each is the right one.
    """
    p, s, m = markers

    def parted(first: str, second: str) -> tuple[Column, Column, Column]:
        """What follows each marker: the first, the second, the last."""
        b = F.locate(second, output, len(first) + 1)
        c = F.call_function("locate", F.lit(m), output, b)
        one = F.substring(output, F.lit(len(first) + 1), b - len(first) - 1)
        two = F.substring(output, b + len(second), c - b - len(second))
        return one, two, F.substring(output, c + len(m), F.length(output))

    a, c, b = parted(p, s)
    suffix, prefix, middle = parted(s, p)
    return (
        F.when(form == "psm", F.concat(a, b, c)).when(form == "spm", F.concat(prefix, middle, suffix)).otherwise(output)
    )


# The same over `documents`.
SQL = """
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u,
         sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h
  FROM documents),
k AS (
  SELECT *, len(u)::BIGINT AS n, ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2,
         ('0x' || h[17:24])::BIGINT AS h3, ('0x' || h[25:32])::BIGINT AS h4
  FROM d),
c AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
         CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90
              THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
  FROM k),
p AS (
  SELECT *, array_to_string(u[1:a], '') AS pre, array_to_string(u[a + 1:b], '') AS mid,
         array_to_string(u[b + 1:], '') AS suf
  FROM c)
SELECT doc_id, n, form,
       CASE WHEN form <> 'plain' THEN length(pre) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN length(mid) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid
                        ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM p
"""
