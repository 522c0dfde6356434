"""Substring de-duplication over words, by suffix automata of reference shards.

The corpus is cut into reference shards by the anchors of its windows (see
``repeats``).  A task builds the suffix automaton of a shard, counts how often
each of its states occurs, then streams the shard's documents through it: the
matching statistics tell for each place the longest match, and where that
reaches the window width, how often the window occurs.

The automata are not broadcast to every task: streaming all documents past all
shards would grow with the square of the corpus.  A document's passage is
streamed past the one shard that can hold its matches.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from verdant.llm.repeats import WordKind, remove_repeats

#: Bytes of reference text in one automaton (more only if one anchor has more).
SHARD_BYTES = 1 << 18


class SuffixAutomaton:
    """Of several sequences of hashable symbols, with occurrence counts by state."""

    def __init__(self) -> None:
        self.steps: list[dict] = [{}]
        self.link, self.length, self.count = [-1], [0], [0]

    def _state(self, length: int, steps: dict, link: int) -> int:
        self.steps.append(steps)
        self.length.append(length)
        self.link.append(link)
        self.count.append(0)
        return len(self.steps) - 1

    def add(self, sequence, weight: int = 1) -> None:
        last = 0
        for symbol in sequence:
            last = self._extend(last, symbol)
            self.count[last] += weight

    def _extend(self, last: int, symbol) -> int:
        steps, link, length = self.steps, self.link, self.length
        if symbol in steps[last]:  # another sequence has been here
            return self._split(last, symbol)
        new = self._state(length[last] + 1, {}, 0)
        at = last
        while at >= 0 and symbol not in steps[at]:
            steps[at][symbol] = new
            at = link[at]
        if at >= 0:
            link[new] = self._split(at, symbol)
        return new

    def _split(self, at: int, symbol) -> int:
        """The state of (at, symbol), split off where it also holds longer strings."""
        steps, link, length = self.steps, self.link, self.length
        to = steps[at][symbol]
        if length[to] == length[at] + 1:
            return to
        part = self._state(length[at] + 1, dict(steps[to]), link[to])
        link[to] = part
        while at >= 0 and steps[at].get(symbol) == to:
            steps[at][symbol] = part
            at = link[at]
        return part

    def close(self) -> None:
        """Pass the counts down the suffix links."""
        for state in sorted(range(1, len(self.length)), key=self.length.__getitem__, reverse=True):
            self.count[self.link[state]] += self.count[state]

    def often(self, sequence, width: int) -> np.ndarray:
        """For each window of ``width`` symbols, whether it occurs twice or more."""
        steps, link, length, count = self.steps, self.link, self.length, self.count
        out = np.zeros(max(0, len(sequence) - width + 1), bool)
        at = matched = 0
        for i, symbol in enumerate(sequence):
            while at and symbol not in steps[at]:
                at = link[at]
                matched = length[at]
            if symbol in steps[at]:
                at = steps[at][symbol]
                matched += 1
            while length[link[at]] >= width > 0 and at:
                at = link[at]
                matched = length[at]
            if matched >= width:
                out[i - width + 1] = count[at] > 1
        return out


def automaton_flags(width: int):
    def index(segments: list[bytes], weights: np.ndarray) -> list[np.ndarray]:
        sequences = [s.split() for s in segments]
        automaton = SuffixAutomaton()
        for sequence, weight in zip(sequences, weights.tolist(), strict=True):
            automaton.add(sequence, weight)
        automaton.close()
        return [automaton.often(sequence, width) for sequence in sequences]
    return index


def remove_repeated_spans(docs: DataFrame, width: int = 35, gram: int = 8, doc_id: str = "doc_id", text: str = "text",
                          keep: list[str] | None = None, as_is: bool = False) -> DataFrame:
    """Removes every word covered by a window of ``width`` consecutive words that
    also starts anywhere else, same document included; all windows are judged on
    the input.

    Returns per row: ``row`` (a struct of the columns ``keep``, the id by default), ``size`` (words), ``spans`` (maximal removed word
    ranges) and ``kept`` (binary: kept words joined by one space).  Words are
    split at ASCII white space and compared as they are.  Null, empty and blank
    texts have no words; texts shorter than a window keep all; repeated rows
    count as several occurrences.  Other columns are not read.
    With ``as_is`` a text of which nothing is removed is kept as it is.
    """
    return remove_repeats(docs, WordKind(width, gram), automaton_flags(width), SHARD_BYTES, doc_id, text, keep or [doc_id], as_is)
