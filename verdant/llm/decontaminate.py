"""Benchmark decontamination with one FM-index per training shard.

A task cuts its documents into shards of bounded size.  A shard is a sequence of
word numbers; words that occur in no test phrase get numbers of their own, so
they end every match.  Each shard gets a suffix array (prefix doubling), its
Burrows-Wheeler transform in a wavelet matrix, and sampled suffix positions.
Test phrases are searched backwards, all at once; their occurrences are located
by walking to the next sampled position and merged into removal spans.

The phrases are a stated query set: they go to the executors in blocks of
bounded size, one pass over the documents per block.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from verdant.llm.shared import row_key, schema, small_batches, stage, whole
from verdant.llm.text import ALNUM

#: Words a shard holds before it is indexed (a longer document is a shard of its own).
SHARD_WORDS = 1 << 18
#: Every so many positions of a shard has its place in the text stored.
SAMPLE_EVERY = 16
#: Bytes of test text sent to the executors at once.
BLOCK_BYTES = 16 << 20

_FOLD = bytes(32 if not ALNUM.inside[b] else b for b in bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256)))


def split_words(text: bytes | None) -> list[bytes]:
    """Lower-cased (A-Z) runs of digits, letters and non-ASCII bytes."""
    return text.translate(_FOLD).split() if text else []


class Phrases:
    """Windows of ``width`` words of the test items and the items they occur in."""

    def __init__(self, items: list[tuple], width: int):
        self.vocabulary: dict[bytes, int] = {}
        number: dict[tuple, int] = {}
        self.items: list[set] = []
        for item_id, text in items:
            ids = [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in split_words(text)]
            for i in range(max(1, len(ids) - width + 1) if ids else 0):
                phrase = number.setdefault(tuple(ids[i:i + width]), len(number))
                if phrase == len(self.items):
                    self.items.append(set())
                self.items[phrase].add(item_id)
        self.length = np.array([len(p) for p in number], np.int64)
        self.words = np.full((len(number), width), -1, np.int64)
        for row, phrase in enumerate(number):
            self.words[row, width - len(phrase):] = phrase
        self.least = int(self.length.min()) if number else 0


def suffix_order(seq: np.ndarray) -> np.ndarray:
    """Suffix array of ``seq`` (non-negative numbers) by prefix doubling; only
    suffixes that are still tied are sorted again."""
    n = len(seq)
    rank = np.unique(seq, return_inverse=True)[1].astype(np.int64)
    order = np.argsort(rank, kind="stable")
    step, tied = 1, None
    while True:
        key = rank[order]
        first = np.ones(n, bool)  # begins a group of equal rank
        if tied is not None:
            after = np.zeros(n, np.int64)
            inside = tied + step < n
            after[tied[inside]] = rank[tied[inside] + step] + 1
            first[1:] = (key[1:] != key[:-1]) | (after[order[1:]] != after[order[:-1]])
            step *= 2
        else:
            first[1:] = key[1:] != key[:-1]
        begin = np.maximum.accumulate(np.where(first, np.arange(n), 0))
        rank[order] = begin
        alone = first & np.append(first[1:], True)
        slots = np.flatnonzero(~alone)
        if not len(slots):
            return order
        tied = order[slots]
        ahead = np.where(tied + step < n, rank[np.minimum(tied + step, n - 1)] + 1, 0)
        resort = np.lexsort((ahead, begin[slots]))
        order[slots] = tied[resort]


class WaveletMatrix:
    """Rank of a symbol in any prefix of a sequence, one bit vector per bit."""

    def __init__(self, seq: np.ndarray, size: int):
        self.bits = max(1, int(size - 1).bit_length())
        self.ones, self.zeros = [], []
        for level in range(self.bits - 1, -1, -1):
            bit = (seq >> level) & 1
            ones = np.zeros(len(seq) + 1, np.int32)
            np.cumsum(bit, out=ones[1:])
            self.ones.append(ones)
            self.zeros.append(len(seq) - int(ones[-1]))
            seq = np.concatenate([seq[bit == 0], seq[bit == 1]])

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often symbol occurs among the first ``at`` places."""
        lo, hi = np.zeros_like(at), at
        for k, (ones, zeros) in enumerate(zip(self.ones, self.zeros, strict=True)):
            one = (symbol >> (self.bits - 1 - k)) & 1 == 1
            lo = np.where(one, zeros + ones[lo], lo - ones[lo])
            hi = np.where(one, zeros + ones[hi], hi - ones[hi])
        return hi - lo


class FMIndex:
    """Index of word numbers below ``size``; -1 stands for words that occur in
    no phrase, each of which sorts as a word of its own."""

    def __init__(self, seq: np.ndarray, size: int):
        seq = np.append(seq, -1)
        n, self.other = len(seq), size
        strange = seq < 0
        unique = np.where(strange, size + np.cumsum(strange), seq)
        order = suffix_order(unique)
        known = np.where(strange, size, seq)
        self.first = np.searchsorted(known[order], np.arange(size + 2), "left")
        before = known[order - 1]
        self.wavelet = WaveletMatrix(before, size + 1)
        self.before = before
        # a walk to the left can't pass a strange word, so the place after one is sampled too
        sampled = (order % SAMPLE_EVERY == 0) | (before == size)
        self.mark = np.append(0, np.cumsum(sampled))
        self.sample = order[sampled]
        self.n = n

    def search(self, words: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows [lo, hi) of every phrase (words are right-aligned), by backward search."""
        lo, hi = np.zeros(len(words), np.int64), np.full(len(words), self.n, np.int64)
        for k in range(words.shape[1]):
            live = np.flatnonzero((lo < hi) & (k < length))
            if not len(live):
                break
            c = words[live, words.shape[1] - 1 - k]
            lo[live], hi[live] = (self.first[c] + self.wavelet.rank(c, x[live]) for x in (lo, hi))
        return lo, hi

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Places in the text of the given rows, by walks to sampled places."""
        rows, steps = rows.copy(), np.zeros(len(rows), np.int64)
        while True:
            walk = np.flatnonzero(self.mark[rows + 1] == self.mark[rows])
            if not len(walk):
                return self.sample[self.mark[rows]] + steps
            c = self.before[rows[walk]]
            rows[walk] = self.first[c] + self.wavelet.rank(c, rows[walk])
            steps[walk] += 1


def find_phrases(seq: np.ndarray, phrases: Phrases) -> tuple[np.ndarray, np.ndarray]:
    """Places and phrase numbers of all occurrences in a shard."""
    none = np.zeros(0, np.int64)
    if not len(phrases.length) or not len(seq):
        return none, none
    index = FMIndex(seq, len(phrases.vocabulary))
    lo, hi = index.search(phrases.words, phrases.length)
    count = np.maximum(hi - lo, 0)
    which = np.repeat(np.arange(len(count)), count)
    rows = np.repeat(lo - np.append(0, np.cumsum(count)[:-1]), count) + np.arange(count.sum())
    return index.locate(rows), which


def merge_spans(start: np.ndarray, end: np.ndarray) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for s, e in sorted(zip(start.tolist(), end.tolist(), strict=True)):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [tuple(x) for x in out]


SPANS = "array<struct<start:int,stop:int>>"
_SPANS = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))


def _search(phrases: Phrases):
    """mapInArrow: (row, key, text) -> (row, key, n_words, spans, items)."""
    get = phrases.vocabulary.get

    def rows(held: list[tuple], seq: list) -> pa.RecordBatch:
        starts = np.cumsum([0, *(n + 1 for *_, n in held)])[:-1]
        place, which = find_phrases(np.concatenate(seq) if seq else np.zeros(0, np.int64), phrases)
        doc = np.searchsorted(starts, place, "right") - 1
        by_doc: dict[int, list[int]] = {}
        for i, d in enumerate(doc.tolist()):
            by_doc.setdefault(d, []).append(i)
        spans, items = [], []
        for d in range(len(held)):
            hit = np.array(by_doc.get(d, []), np.int64)
            begin = place[hit] - starts[d]
            spans.append([{"start": s, "stop": e} for s, e in merge_spans(begin, begin + phrases.length[which[hit]])])
            items.append(sorted({str(x) for w in set(which[hit].tolist()) for x in phrases.items[w]}))
        return pa.RecordBatch.from_arrays([
            pa.concat_arrays([x[0] for x in held]), pa.concat_arrays([x[1] for x in held]), pa.array([x[2] for x in held], pa.int64()),
            pa.array(spans, _SPANS), pa.array(items, pa.list_(pa.string()))], ["row", "key", "n_words", "spans", "items"])

    def run(batches):
        held, seq, total = [], [], 0
        stop = np.full(1, -1, np.int64)
        for batch in batches:
            for i, text in enumerate(batch.column(2).cast(pa.binary())):
                found = split_words(text.as_py())
                held.append((batch.column(0).slice(i, 1), batch.column(1).slice(i, 1), len(found)))
                seq += [np.fromiter((get(w, -1) for w in found), np.int64, len(found)), stop]
                total += len(found) + 1
                if total >= SHARD_WORDS:
                    yield rows(held, seq)
                    held, seq, total = [], [], 0
        if held:
            yield rows(held, seq)

    return run


def phrase_blocks(items: DataFrame, width: int):
    """The query set ``items(item, text)`` in blocks of at most BLOCK_BYTES of text (or one item)."""
    block, size = [], 0
    for x in items.toLocalIterator():
        if block and size + len(x["text"]) > BLOCK_BYTES:
            yield Phrases(block, width)
            block, size = [], 0
        block.append((x["item"], bytes(x["text"])))
        size += len(x["text"])
    yield Phrases(block, width)


def contamination(docs: DataFrame, benchmark: DataFrame, width: int = 10, doc_id: str = "doc_id", text: str = "text",
                  item_id: str = "item_id", item_text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Per document: the words that lie in an occurrence of a test phrase.

    A phrase is ``width`` consecutive words of an item, or all words of a
    shorter one.  Returns one row per document: ``row`` (a struct of the
    columns ``keep``, the id by default), ``n_words``, ``spans`` (merged word ranges) and ``items``
    (sorted ids of the items found).  A null or empty text has no words and no
    spans; a null item text gives no phrase; a null item id counts as "null";
    repeated rows each get their own row.  Other columns are neither read nor
    returned, so their names can't clash.
    """
    rows = small_batches(docs).select(whole(keep or [doc_id]), row_key(doc_id, text).alias("key"), F.col(text).cast("string").alias("text"))
    items = benchmark.select(F.coalesce(F.col(item_id).cast("string"), F.lit("null")).alias("item"), F.encode(F.col(item_text).cast("string"), "UTF-8").alias("text")).where(F.col("text").isNotNull())
    out = None
    for phrases in phrase_blocks(items, width):
        found = rows.mapInArrow(_search(phrases), schema(rows.schema["row"], f"key struct<id:string,h:bigint>, n_words long, spans {SPANS}, items array<string>"))
        if out is None:
            out = found
        else:
            more = stage(found.where(F.size("items") > 0), "found").groupBy("key").agg(F.first("spans").alias("spans2"), F.first("items").alias("items2"))
            out = stage(out, "found").join(more, "key", "left").select(
                "row", "key", "n_words", merged("spans", "spans2").alias("spans"),
                F.array_sort(F.array_union("items", F.coalesce("items2", F.array().cast("array<string>")))).alias("items"))
    return out.drop("key")


_WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")


@F.pandas_udf(T.StringType())
def cut(text: pd.Series, spans: pd.Series) -> pd.Series:
    """The texts without the words of their spans (and what stands between those)."""
    out = []
    for t, found in zip(text, spans, strict=True):
        if t is None or not len(found):
            out.append(t)
            continue
        raw, parts, at = t.encode(), [], 0
        place = [m.span() for m in _WORD.finditer(raw)]
        for s in found:
            parts.append(raw[at:place[s["start"]][0]])
            at = place[s["stop"] - 1][1]
        out.append(b"".join([*parts, raw[at:]]).decode())
    return pd.Series(out)


def merged(a: str, b: str):
    """Union of two sorted lists of spans as one merged list."""
    both = F.array_sort(F.concat(a, F.coalesce(b, F.array().cast(SPANS))))
    last = lambda acc: F.element_at(acc, -1)
    return F.aggregate(both, F.array().cast(SPANS), lambda acc, x: F.when(
        (F.size(acc) > 0) & (x["start"] <= F.get(acc, F.size(acc) - 1)["stop"]),
        F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(last(acc)["start"].alias("start"), F.greatest(last(acc)["stop"], x["stop"]).alias("stop")))),
    ).otherwise(F.concat(acc, F.array(x))))


def n_in_spans(spans: str = "spans"):
    return F.aggregate(spans, F.lit(0).cast("long"), lambda acc, x: acc + x["stop"] - x["start"])
