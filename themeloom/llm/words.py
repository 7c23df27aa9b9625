"""Words of many texts at once, as numpy arrays over their UTF-8 bytes."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

# The six bytes that separate words.
SPACES = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)
IS_SPACE = np.zeros(256, bool)
IS_SPACE[list(SPACES)] = True

# Bytes and rows handled at once, which bounds a task's memory; a longer text is
# handled alone.
SLICE_BYTES = 1 << 20
SLICE_ROWS = 1024

_random = np.random.default_rng(20240229)
_BYTE = _random.integers(1, 1 << 63, 256, np.uint64)
FACTORS = [int(x) | 1 for x in _random.integers(1 << 62, 1 << 63, 4, np.uint64)]


@dataclass
class Slice:
    """Texts of rows ``first`` .. of a batch: their bytes and where each begins."""

    first: int
    data: np.ndarray
    bounds: np.ndarray

    @property
    def rows(self) -> int:
        return len(self.bounds) - 1


def slices(column: pa.Array, max_bytes: int = SLICE_BYTES, max_rows: int = SLICE_ROWS) -> Iterator[Slice]:
    """A text column in slices; null is an empty text."""
    if not len(column):
        return
    column = column.cast(pa.large_string()).fill_null("")
    bounds = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    at = 0
    while at < len(column):
        end = int(np.searchsorted(bounds, bounds[at] + max_bytes, "right")) - 1
        end = min(max(end, at + 1), len(column), at + max_rows)
        yield Slice(at, data[bounds[at]:bounds[end]], bounds[at:end + 1] - bounds[at])
        at = end


def mix(x: np.ndarray) -> np.ndarray:
    """Scatter 64-bit numbers one-to-one (the finishing steps of a common hash)."""
    x = x ^ (x >> np.uint64(33))
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(factor: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """``factor`` and its inverse modulo 2^64, to the powers 0 .. n."""
    held = _POWERS.get(factor)
    if held is None or len(held[0]) <= n:
        size = max(n + 1, SLICE_BYTES + 1)
        both = []
        for f in (factor, pow(factor, -1, 1 << 64)):
            p = np.full(size, f, np.uint64)
            p[0] = 1
            both.append(np.cumprod(p, dtype=np.uint64))
        held = tuple(both)
        if size <= 4 * SLICE_BYTES:
            _POWERS[factor] = held
    return held


GOLD = np.uint64(0x9E3779B97F4A7C15)
_MULTIPLIERS: dict[int, np.ndarray] = {}


def multipliers(family: int, n: int) -> np.ndarray:
    """At least ``n`` random numbers, the same in every process, one for each place of a span."""
    held = _MULTIPLIERS.get(family)
    if held is None or len(held) < n:
        size = max(1024, 1 << int(n - 1).bit_length())
        held = mix(np.arange(1, size + 1, dtype=np.uint64) * GOLD + mix(np.full(1, family, np.uint64) + GOLD))
        if size <= SLICE_BYTES:
            _MULTIPLIERS[family] = held
    return held


def sequence_hash(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, family: int) -> np.ndarray:
    """64-bit hash of ``values[start:end]`` for spans that follow one another without overlap.

    Every place of a span has a multiplier of its own, so there are no arrangements of the
    same values whose hashes are equal by structure, as those of powers of one factor are
    for a Thue-Morse word and its complement.  Families are independent of each other.
    """
    n = len(values)
    if not len(starts):
        return np.zeros(0, np.uint64)
    size = ends - starts
    longest = int(size.max())
    place = np.arange(n) - np.concatenate([
        np.zeros(starts[0], np.int64), np.repeat(starts, np.diff(np.append(starts, n)))])
    factor = multipliers(family, longest + 1)[np.minimum(place, longest)]
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(values * factor, dtype=np.uint64, out=sums[1:])
    return mix(sums[ends] - sums[starts] + size.astype(np.uint64) * GOLD)


def window_hash(values: np.ndarray, starts: np.ndarray, width: int, family: int) -> np.ndarray:
    """64-bit hash of ``values[start:start + width]``; windows may overlap."""
    out = np.zeros(len(starts), np.uint64)
    for place, factor in enumerate(multipliers(family, width)[:width]):
        out += values[starts + place] * factor
    return mix(out + np.full(1, width, np.uint64) * GOLD)


def span_hash(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, factor: int) -> np.ndarray:
    """64-bit hash of ``values[start:end]`` for each span; equal spans, equal hashes.

    Different spans may have equal hashes by structure (a Thue-Morse sequence and its
    complement), so this finds candidates and never decides.
    """
    n = len(values)
    up, down = powers(factor, n)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(values * up[:n], dtype=np.uint64, out=sums[1:])
    out = (sums[ends] - sums[starts]) * down[starts]
    return mix(out + (ends - starts).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


PRIME = (1 << 31) - 1
_BASES = [int(b) for b in np.random.default_rng(5).integers(1 << 20, PRIME - 1, 8)]
_FIELD: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _field_powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """``base`` and its inverse modulo ``PRIME``, to the powers 0 .. n."""
    held = _FIELD.get(base)
    if held is None or len(held[0]) <= n:
        both = []
        for f in (base, pow(base, -1, PRIME)):
            p = np.ones(1, np.uint64)
            while len(p) <= max(n, 1 << 16):
                p = np.concatenate([p, p * np.uint64(pow(f, len(p), PRIME)) % np.uint64(PRIME)])
            both.append(p)
        held = tuple(both)
        if len(held[0]) <= 4 * SLICE_BYTES:
            _FIELD[base] = held
    return held


def field_hash(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, family: int) -> np.ndarray:
    """Hash of ``values[start:end]`` for spans of any place: two polynomials over a prime field.

    Two different spans of m values agree with a chance of (m / 2^31)^2 at most, whatever
    their structure; families are independent of each other.
    """
    p, n = np.uint64(PRIME), len(values)
    folded = ((values & p) + (values >> np.uint64(31))) % p + np.uint64(1)
    out = np.zeros(len(starts), np.uint64)
    for base in _BASES[2 * family:2 * family + 2]:
        up, down = _field_powers(base, n)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(folded * up[:n] % p, dtype=np.uint64, out=sums[1:])
        out = (out << np.uint64(31)) + (sums[ends] - sums[starts]) % p * down[starts] % p
    return mix(out + (ends - starts).astype(np.uint64) * GOLD)


@dataclass
class Words:
    """Words of a slice: byte spans, the row of each, and where each row's words begin."""

    starts: np.ndarray
    ends: np.ndarray
    row: np.ndarray
    first: np.ndarray


def find_words(part: Slice, apart: np.ndarray = IS_SPACE) -> Words:
    """Words between the bytes that ``apart`` marks."""
    inside = ~apart[part.data]
    n = len(inside)
    begins = np.zeros(n + 1, bool)
    begins[part.bounds] = True
    start = inside.copy()
    start[1:] &= ~inside[:-1] | begins[1:n]
    end = inside.copy()
    end[:-1] &= ~inside[1:] | begins[1:n]
    starts, ends = np.flatnonzero(start), np.flatnonzero(end) + 1
    first = np.searchsorted(starts, part.bounds)
    row = np.repeat(np.arange(part.rows), np.diff(first))
    return Words(starts, ends, row, first)


def word_hashes(data: np.ndarray, words: Words, family: int = 0) -> np.ndarray:
    """A 64-bit hash of every word; ``data`` are the bytes as they are to be compared."""
    return sequence_hash(_BYTE[data], words.starts, words.ends, family)


def lower_ascii(data: np.ndarray) -> np.ndarray:
    return np.where((data >= 65) & (data <= 90), data + np.uint8(32), data)
