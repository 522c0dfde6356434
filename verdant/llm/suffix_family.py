"""Exact substring de-duplication over bytes, by a logarithmic family of suffix arrays.

The corpus is cut into shards by the anchors of its windows (see ``repeats``).
Within a shard the text arrives in batches.  Each batch gets a suffix array
(sorted to the depth of a window); it is merge-scanned against the existing
levels, where equal entries are long matches; then it becomes a level itself,
and levels of equal size merge, so each entry is merged a logarithmic number of
times.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from verdant.llm.repeats import ByteKind, remove_repeats

#: Bytes of distinct text in one family (more only if one anchor has more).
SHARD_BYTES = 1 << 18
#: Suffixes in a new batch.
BATCH = 1 << 14


class SuffixFamily:
    """Levels of sorted suffixes, cut at ``width`` bytes, with how often each occurs."""

    def __init__(self, width: int):
        self.width = width
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []

    @staticmethod
    def _collapse(keys: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        order = np.argsort(keys, kind="stable")
        keys, times = keys[order], times[order]
        head = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
        return keys[head], np.add.reduceat(times, head)

    def add(self, suffixes: np.ndarray, weight: np.ndarray) -> None:
        """Suffix array of a batch; scan it against the levels; merge levels of equal size."""
        if not len(suffixes):
            return
        keys, times = self._collapse(suffixes, weight)
        for level_keys, level_times in self.levels:
            at = np.minimum(np.searchsorted(level_keys, keys), len(level_keys) - 1)
            match = level_keys[at] == keys
            level_times[at[match]] += times[match]
            keys, times = keys[~match], times[~match]
        if len(keys):
            self.levels.append((keys, times))
        while len(self.levels) > 1 and len(self.levels[-2][0]) <= 2 * len(self.levels[-1][0]):
            (a, b), (c, d) = self.levels.pop(), self.levels.pop()
            self.levels.append(self._collapse(np.concatenate([a, c]), np.concatenate([b, d])))

    def times(self, suffixes: np.ndarray) -> np.ndarray:
        out = np.zeros(len(suffixes), np.int64)
        for keys, times in self.levels:
            at = np.minimum(np.searchsorted(keys, suffixes), len(keys) - 1)
            match = keys[at] == suffixes
            out[match] = times[at[match]]
        return out


def family_flags(width: int):
    def index(segments: list[bytes], weights: np.ndarray) -> list[np.ndarray]:
        data = np.frombuffer(b"".join(segments), np.uint8)
        size = np.array([len(s) for s in segments])
        count = size - width + 1
        begin = np.repeat(np.cumsum(size) - size - (np.cumsum(count) - count), count) + np.arange(count.sum())
        suffixes = np.lib.stride_tricks.sliding_window_view(data, width)
        weight = np.repeat(weights, count)
        family = SuffixFamily(width)

        def cut(at: np.ndarray) -> np.ndarray:
            return np.ascontiguousarray(suffixes[at]).view(f"S{width}").ravel()

        for k in range(0, len(begin), BATCH):
            family.add(cut(begin[k:k + BATCH]), weight[k:k + BATCH])
        flags = [family.times(cut(begin[k:k + BATCH])) > 1 for k in range(0, len(begin), BATCH)]
        return np.split(np.concatenate(flags), np.cumsum(count)[:-1])
    return index


def remove_repeated_bytes(docs: DataFrame, width: int = 200, gram: int = 32, doc_id: str = "doc_id", text: str = "text",
                          keep: list[str] | None = None, as_is: bool = False) -> DataFrame:
    """Removes every byte covered by a string of ``width`` bytes that also starts
    anywhere else, same document included; all strings are judged on the input.

    Returns per row: ``row`` (a struct of the columns ``keep``, the id by default), ``size`` (bytes of the UTF-8 text), ``spans`` (maximal
    removed byte ranges) and ``kept`` (binary: the remaining bytes, which may cut
    a character in two).  A null text counts as empty; shorter texts keep all;
    repeated rows count as several occurrences.  Other columns are not read.
    With ``as_is`` a text of which nothing is removed is kept as it is.
    """
    return remove_repeats(docs, ByteKind(width, gram), family_flags(width), SHARD_BYTES, doc_id, text, keep or [doc_id], as_is)
