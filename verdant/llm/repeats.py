"""Which windows of ``width`` symbols occur more than once in a corpus: the
routing that the substring operators share.

Every window names one anchor, the least-hashed gram in it, by its content
alone; so equal windows name equal anchors at the same place.  The windows that
an anchor owns form one segment of text.  An anchor that occurs once owns no
repeated window; one whose segments are all equal owns only repeated ones.  The
segments of the remaining anchors ("mixed") go, equal ones collapsed, to the
index that an operator brings: a task gets all segments of an anchor, or, of an
anchor with very many, single windows that are counted by a shuffle.

So work and traffic grow with the corpus, not with its square, and no task has
to hold more than a bounded number of segments.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from verdant.llm.groups import together, whole_groups
from verdant.llm.shared import schema, small_batches, stage, whole
from verdant.llm.text import GRAMS, PLAIN, Slice, mix, prefix_sums, slices, span_hash, word_hashes, words

#: An anchor with more distinct segments than this is dealt out window by window.
CROWD = 1000
_PLACE = np.uint64((1 << 31) - 1)

SPANS = "array<struct<start:int,stop:int>>"
_SPANS = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))


class WordKind:
    """Symbols are words between ASCII white space; kept words are joined by one space."""

    def __init__(self, width: int, gram: int):
        self.width, self.gram = width, gram

    def hashes(self, s: Slice) -> tuple[np.ndarray, np.ndarray]:
        w = words(s, PLAIN)
        return word_hashes(s, w, PLAIN), w.first

    def symbols(self, text: bytes) -> list[bytes]:
        return text.split()

    def join(self, symbols: list[bytes]) -> bytes:
        return b" ".join(symbols)

    def windows(self, segment: str, n: str, at: str):
        return F.array_join(F.slice(F.split(F.col(segment).cast("string"), " ", -1), F.col(at) + 1, self.width), " ")

    def length(self, segment: str):
        return F.size(F.split(F.col(segment).cast("string"), " ", -1))


class ByteKind:
    """Symbols are bytes."""

    def __init__(self, width: int, gram: int):
        self.width, self.gram = width, gram

    def hashes(self, s: Slice) -> tuple[np.ndarray, np.ndarray]:
        return PLAIN.values[s.data], s.offsets

    def symbols(self, text: bytes) -> bytes:
        return text

    def join(self, symbols) -> bytes:
        return symbols if isinstance(symbols, bytes) else b"".join(symbols)

    def windows(self, segment: str, n: str, at: str):
        return F.substring(F.col(segment), F.col(at) + 1, F.lit(self.width))

    def length(self, segment: str):
        return F.octet_length(segment)


def anchors(values: np.ndarray, first: np.ndarray, width: int, gram: int):
    """Of rows of symbol hashes: row, anchor hash, segment hash, first owned window and number of owned windows."""
    none = np.zeros(0, np.int64)
    ends = first[1:]
    count = np.maximum(np.diff(first) - width + 1, 0)
    if not count.sum():
        return none, none, none, none, none
    sums = prefix_sums(values, GRAMS)
    at = np.arange(len(values) - gram + 1)
    grams = mix(span_hash(sums, at, at + gram, GRAMS))
    least = (grams & ~_PLACE) | at.astype(np.uint64)
    step, span = 1, width - gram + 1  # sliding minimum by doubling
    while 2 * step <= span:
        least = np.minimum(least[:-step], least[step:])
        step *= 2
    if span > step:
        least = np.minimum(least[:step - span], least[span - step:])
    row = np.repeat(np.arange(len(count)), count)
    start = np.repeat(ends - width + 1 - np.cumsum(count), count) + np.arange(count.sum())
    place = (least[start] & _PLACE).astype(np.int64)
    new = np.ones(len(start), bool)
    new[1:] = (place[1:] != place[:-1]) | (row[1:] != row[:-1])
    head = np.flatnonzero(new)
    owned = np.diff(np.append(head, len(start)))
    begin, place, row = start[head], place[head], row[head]
    shape = (owned * (1 << 20) + place - begin).astype(np.uint64)
    segment = mix(span_hash(sums, begin, begin + owned + width - 1, GRAMS) ^ mix(shape))
    return row, grams[place].view(np.int64), segment.view(np.int64), begin - first[row], owned


def _anchor_rows(kind):
    def run(batches):
        for batch in batches:
            k1, k2 = batch.column(0), batch.column(1)
            for s in slices(batch.column(2)):
                values, first = kind.hashes(s)
                row, a, g, begin, owned = anchors(values, first, kind.width, kind.gram)
                row = pa.array(row + s.lo)
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(g), k1.take(row), k2.take(row), pa.array(begin, pa.int32()), pa.array(owned, pa.int32())], ["a", "g", "k1", "k2", "s", "n"])
    return run


def merge(start: np.ndarray, stop: np.ndarray) -> list[tuple[int, int]]:
    """Union of ranges as sorted ranges that don't touch."""
    if not len(start):
        return []
    order = np.argsort(start, kind="stable")
    start, stop = start[order], np.maximum.accumulate(stop[order])
    new = np.append(True, start[1:] > stop[:-1])
    return list(zip(start[new].tolist(), stop[np.append(np.flatnonzero(new)[1:] - 1, len(stop) - 1)].tolist(), strict=True))


def without(symbols, spans: list[tuple[int, int]]):
    at, out = 0, []
    for lo, hi in spans:
        out.append(symbols[at:lo])
        at = hi
    out.append(symbols[at:])
    return b"".join(out) if isinstance(symbols, bytes) else [x for part in out for x in part]


_SEGMENT = pa.struct([("a", pa.int64()), ("s", pa.int32()), ("segment", pa.binary())])


def _ranges(column: pa.Array, i: int):
    return column.values, column.value_offsets[i].as_py(), column.value_offsets[i + 1].as_py()


def _texts(batch: pa.RecordBatch, inside: str | None) -> pa.Array:
    """Texts of rows: the column ``text``, or the field ``inside`` of ``row`` where that carries them."""
    column = batch.column("text") if inside is None else batch.column("row").field(inside)
    return column.cast(pa.string()).cast(pa.binary())


def _apply(kind, as_is: bool, inside: str | None):
    """(row, k1, k2, text, plain[(s, n)], mixed[(a, s, n)]) -> spans and kept
    text; of a row with mixed anchors their segments instead, and the text unless
    ``row`` carries it.  A text that stays as it is and lies in ``row`` is not
    written again: its ``kept`` is null."""
    def run(batches):
        for batch in batches:
            texts = _texts(batch, inside)
            plain, mixed = batch.column("plain").to_pylist(), batch.column("mixed").to_pylist()
            size, spans, kept, text, segments = [], [], [], [], []
            for t, w, m in zip(texts, plain, mixed, strict=True):
                raw = t.as_py() or b""
                symbols = kind.symbols(raw)
                size.append(len(symbols))
                start = np.array([x["s"] for x in w or ()], np.int64)
                found = merge(start, start + np.array([x["n"] for x in w or ()], np.int64) + kind.width - 1)
                spans.append([{"start": a, "stop": b} for a, b in found])
                text.append(raw if m and inside is None else None)
                segments.append([{"a": x["a"], "s": x["s"], "segment": kind.join(symbols[x["s"]:x["s"] + x["n"] + kind.width - 1])} for x in m or ()])
                same = as_is and not found
                kept.append(None if m or same and inside else raw if same else kind.join(without(symbols, found) if found else symbols))
            yield pa.RecordBatch.from_arrays([
                batch.column("row"), batch.column("k1"), batch.column("k2"), pa.array(size, pa.int64()), pa.array(spans, _SPANS), pa.array(kept, pa.binary()),
                pa.array(text, pa.binary()), pa.array(segments, pa.list_(_SEGMENT))], ["row", "k1", "k2", "size", "spans", "kept", "text", "segments"])
    return run


def _finish(kind, as_is: bool, inside: str | None):
    """(row, size, spans, text, more spans) -> (row, size, spans, kept)."""
    def run(batches):
        for batch in batches:
            spans, kept = [], []
            for old, t, more in zip(batch.column("spans").to_pylist(), _texts(batch, inside), batch.column("more").to_pylist(), strict=True):
                every = [*old, *(more or ())]
                found = merge(np.array([x["start"] for x in every], np.int64), np.array([x["stop"] for x in every], np.int64))
                spans.append([{"start": a, "stop": b} for a, b in found])
                raw = t.as_py() or b""
                same = as_is and not found
                kept.append(None if same and inside else raw if same else kind.join(without(kind.symbols(raw), found)))
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("size"), pa.array(spans, _SPANS), pa.array(kept, pa.binary())], ["row", "size", "spans", "kept"])
    return run


_RUNS = pa.list_(pa.struct([("lo", pa.int32()), ("n", pa.int32())]))


def flag_runs(flags: np.ndarray) -> list[dict]:
    """Runs of true flags."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
    return [{"lo": lo, "n": hi - lo} for lo, hi in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True)]


def _index_rows(index: Callable, shard: int):
    """Sorted (g=a, x1, x2, segment, rows) -> runs of repeated windows by segment.

    ``index(segments, weights)`` gets the segments of whole anchors, about
    ``shard`` bytes of them, and returns the window flags of each."""
    def run(batches):
        for batch, bounds in whole_groups(batches):
            size = np.cumsum([0, *(len(x.as_py()) for x in batch.column(3))])
            lo = 0
            while lo < len(bounds) - 1:
                hi = lo + 1
                while hi < len(bounds) - 1 and size[bounds[hi + 1]] - size[bounds[lo]] <= shard:
                    hi += 1
                part = batch.slice(bounds[lo], bounds[hi] - bounds[lo])
                flags = index(part.column(3).to_pylist(), part.column(4).to_numpy())
                runs = [flag_runs(f) for f in flags]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), part.column(2), pa.array(runs, _RUNS)], ["a", "x1", "x2", "runs"])
                lo = hi
    return run


def remove_repeats(docs: DataFrame, kind, index: Callable, shard: int, doc_id: str, text: str, keep: list[str], as_is: bool) -> DataFrame:
    """Rows (row, size, spans, kept): a struct of the columns ``keep``, the number
    of symbols of the text, the merged ranges of those covered by a window that
    also starts elsewhere, and what is left (with ``as_is``, the text itself where
    nothing is removed).  Where ``keep`` names the text, it travels in ``row`` alone."""
    rows = small_batches(docs).select(whole(keep), F.xxhash64(text).alias("k1"), F.xxhash64(F.lit("id"), F.col(doc_id).cast("string")).alias("k2"), F.col(text).cast("string").alias("text"))
    row_type = T.StructField("row", rows.schema["row"].dataType)
    inside = text if text in keep else None
    own = ["text"] if inside is None else []
    places = stage(rows.select("k1", "k2", "text").mapInArrow(_anchor_rows(kind), "a long, g long, k1 long, k2 long, s int, n int"), "anchors")
    # written out, so that the join below is between two fresh exchanges and a hot anchor's rows are split
    twice = stage(places.groupBy("a").agg(F.count("*").alias("times"), F.min("g").alias("g0"), F.max("g").alias("g1")).where("times > 1").select("a", (F.col("g0") != F.col("g1")).alias("mixed")), "twice")
    told = places.select("a", "k1", "k2", "s", "n").join(twice, "a")
    flagged = told.groupBy("k1", "k2").agg(
        F.collect_set(F.when(~F.col("mixed"), F.struct("s", "n"))).alias("plain"), F.collect_set(F.when(F.col("mixed"), F.struct("a", "s", "n"))).alias("mixed"))
    flags = schema(row_type, f"k1 long, k2 long, size long, spans {SPANS}, kept binary, text binary, segments array<struct<a:long,s:int,segment:binary>>")
    first = stage(rows.select("row", "k1", "k2", *own).join(flagged, ["k1", "k2"], "left").select("row", "k1", "k2", *own, "plain", "mixed").mapInArrow(_apply(kind, as_is, inside), flags), "first")
    unsettled = F.size("segments") > 0
    segments = first.where(unsettled).select("k1", "k2", F.explode("segments").alias("x")).select("k1", "k2", "x.*")
    segments = segments.withColumns({"x1": F.xxhash64("segment"), "x2": F.xxhash64(F.lit("segment"), F.col("segment"))})
    distinct = stage(segments.groupBy("a", "x1", "x2", "segment").agg(F.count("*").alias("weight")), "segments")
    crowds = distinct.groupBy("a").agg(F.count("*").alias("members")).where(F.col("members") > CROWD)
    crowded = stage(crowds, "crowds")
    usual = distinct.join(crowded, "a", "left_anti").select(F.col("a").alias("g"), "x1", "x2", "segment", "weight")
    runs = together(usual).mapInArrow(_index_rows(index, shard), "a long, x1 long, x2 long, runs array<struct<lo:int,n:int>>")
    one = distinct.join(crowded, "a").select("a", "x1", "x2", "segment", "weight", F.explode(F.sequence(F.lit(0), kind.length("segment") - kind.width)).alias("at"))
    window = kind.windows("segment", "n", "at")
    one = one.select("a", "x1", "x2", "weight", "at", F.xxhash64(window).alias("w1"), F.xxhash64(F.lit("window"), window).alias("w2"))
    often = one.groupBy("a", "w1", "w2").agg(F.sum("weight").alias("times")).where("times > 1").select("a", "w1", "w2")
    lone = one.join(often, ["a", "w1", "w2"]).groupBy("a", "x1", "x2").agg(F.collect_list(F.struct(F.col("at").alias("lo"), F.lit(1).alias("n"))).alias("runs"))
    found = runs.where(F.size("runs") > 0).unionByName(lone)
    spans = segments.select("a", "x1", "x2", "k1", "k2", "s").join(found, ["a", "x1", "x2"]).select(
        "k1", "k2", F.transform("runs", lambda r: F.struct((F.col("s") + r["lo"]).alias("start"), (F.col("s") + r["lo"] + r["n"] + (kind.width - 1)).alias("stop"))).alias("more"))
    spans = spans.groupBy("k1", "k2").agg(F.flatten(F.collect_set("more")).alias("more"))
    rest = first.where(unsettled).join(spans, ["k1", "k2"], "left").select("row", "size", "spans", *own, "more").mapInArrow(_finish(kind, as_is, inside), schema(row_type, f"size long, spans {SPANS}, kept binary"))
    told = first.where(~unsettled).select("row", "size", "spans", "kept").unionByName(rest)
    return told if inside is None else told.withColumn("kept", F.coalesce("kept", F.coalesce(F.col(f"row.`{text}`").cast("string"), F.lit("")).cast("binary")))
