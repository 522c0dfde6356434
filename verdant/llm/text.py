"""Byte-level text helpers shared by the operators: word spans, word hashes
and rolling hashes over Arrow string columns, all vectorised with numpy.

Texts are handled as UTF-8 bytes.  A null text has no words.  Columns are cut
into slices of a quarter megabyte, so that a task's arrays, some of them eight
bytes for each byte of text, stay small; a longer text is a slice of its own.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash

SLICE_BYTES = 1 << 18
#: Longer words are hashed one by one, as rolling hashes are weak on long strings.
LONG_WORD = 512

_M64 = (1 << 64) - 1


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser (xor-shift-multiply)."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x81DADEF4BC2DD44D)
    x ^= x >> np.uint64(33)
    return x


class Powers:
    """Powers of an odd base modulo 2**64 and of its inverse, grown on demand."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(1 << (n - 1).bit_length(), 1 << 16)
            for name, b in (("up", self.base), ("down", self.inverse)):
                steps = np.full(size, b, np.uint64)
                steps[0] = 1
                setattr(self, name, np.multiply.accumulate(steps))
        return self.up[:n], self.down[:n]


BYTES, GRAMS, GRAMS2 = Powers(0x9E3779B97F4A7C15), Powers(0xD1342543DE82EF95), Powers(0xAF251AF3B0F025B5)
_BYTE_VALUES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def prefix_sums(values: np.ndarray, powers: Powers) -> np.ndarray:
    """out[i] = sum of values[j] * base**j for j < i, modulo 2**64."""
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * powers.get(len(values))[0], out=out[1:])
    return out


def span_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray, powers: Powers) -> np.ndarray:
    """Rolling hash of values[start:end], the same wherever those values stand."""
    return (sums[end] - sums[start]) * powers.get(len(sums))[1][start]


@dataclass(frozen=True)
class WordRule:
    """Which bytes belong to a word, and whether A-Z count as a-z."""

    inside: np.ndarray
    values: np.ndarray
    fold: np.ndarray

    @staticmethod
    def make(separators: bytes, lower: bool) -> WordRule:
        inside = np.ones(256, bool)
        inside[list(separators)] = False
        fold = np.arange(256, dtype=np.uint8)
        if lower:
            fold[65:91] += 32
        return WordRule(inside, _BYTE_VALUES[fold], fold)


WHITESPACE = bytes([0x20, *range(0x09, 0x0E)])
PLAIN = WordRule.make(WHITESPACE, lower=False)
LOWER = WordRule.make(WHITESPACE, lower=True)
ALNUM = WordRule.make(bytes([*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]), lower=False)


@dataclass
class Slice:
    """Rows [lo, hi) of a batch: their bytes and where each row begins (hi - lo + 1 offsets)."""

    lo: int
    hi: int
    data: np.ndarray
    offsets: np.ndarray

    def row(self, i: int) -> np.ndarray:
        return self.data[self.offsets[i]:self.offsets[i + 1]]


def slices(column: pa.Array, max_bytes: int = SLICE_BYTES, max_rows: int = 1 << 30) -> Iterator[Slice]:
    """Cut a string or binary column into slices of whole rows."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = pa.large_binary()
    column = column.cast(pa.binary() if pa.types.is_string(column.type) else column.type).cast(wide)
    if column.null_count:
        column = column.fill_null(b"")
    n = len(column)
    if not n:
        return
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + n + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + max_bytes, "right")) - 1)
        hi = min(hi, n, lo + max_rows)
        yield Slice(lo, hi, data[offsets[lo]:offsets[hi]], offsets[lo:hi + 1] - offsets[lo])
        lo = hi


@dataclass
class Words:
    """Word spans of a slice; first[r]:first[r+1] are the words of its row r."""

    start: np.ndarray
    end: np.ndarray
    first: np.ndarray

    @property
    def row(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def words(s: Slice, rule: WordRule) -> Words:
    inside = rule.inside[s.data]
    n = len(inside)
    if not n:
        return Words(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(s.offsets), np.int64))
    edge = np.zeros(n + 1, bool)  # a row begins here
    edge[s.offsets] = True
    begins, ends = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1] | edge[1:n]
    ends[:-1] &= ~inside[1:] | edge[1:n]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    return Words(start, end, np.searchsorted(start, s.offsets, "left"))


def word_hashes(s: Slice, w: Words, rule: WordRule) -> np.ndarray:
    """A 64-bit hash of every word's (folded) bytes."""
    if not len(w.start):
        return np.zeros(0, np.uint64)
    sums = prefix_sums(rule.values[s.data], BYTES)
    out = span_hash(sums, w.start, w.end, BYTES)
    out += (w.end - w.start).astype(np.uint64)
    out = mix(out)
    for i in np.flatnonzero(w.end - w.start > LONG_WORD):
        out[i] = xxhash.xxh3_64_intdigest(rule.fold[s.data[w.start[i]:w.end[i]]].tobytes())
    return out


def ragged(first: np.ndarray, values: np.ndarray, kind: pa.DataType) -> pa.Array:
    """List array whose row r holds values[first[r]:first[r+1]]."""
    return pa.LargeListArray.from_arrays(pa.array(first, pa.int64()), pa.array(values, kind)).cast(pa.list_(kind))
