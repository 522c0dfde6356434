"""Near-duplicate documents by HyperMinHash.

Each document's shingle set is compressed to 256 one-byte registers: a register
holds the leading-zero count of its bucket's least hash and four mantissa bits.
Bands of six registers name the buckets in which documents meet; for them an empty
register borrows from the first occupied one in an order of its own, so that short
documents have as telling bands as long ones.  In a bucket the Jaccard similarity is estimated from the registers, corrected for chance
collisions, and documents that may be similar are clustered.  Inside a cluster
the links are confirmed on the full shingle sets.

Documents with equal sets count as one from the start.  Buckets and clusters of
any size are compared in blocks, and a task returns no more than a spanning
forest, so a group of many near copies never becomes a list of all its pairs.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verdant.llm.groups import dealt_in_blocks, fixed_width, together, whole_groups
from verdant.llm.shared import components, sieved, small_batches, stage
from verdant.llm.text import GRAMS, LOWER, Slice, mix, prefix_sums, slices, span_hash, word_hashes, words

REGISTERS, ROWS = 256, 6
#: Registers are one byte: four bits of leading zeros, four of mantissa; this value means an empty bucket.
EMPTY = 255
#: Standard deviations by which an estimate may fall short of the threshold and still be confirmed.
SLACK = 5.0
BUCKET_BLOCK, CLUSTER_BLOCK = 2048, 256
#: Hashes looked up at a time when sets are compared.
LOOKUP = 1 << 20


def shingle_sets(s: Slice, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct 64-bit shingle hashes of a slice's rows, sorted by row and hash, and where each row begins."""
    w = words(s, LOWER)
    sums = prefix_sums(word_hashes(s, w, LOWER), GRAMS)
    n = np.diff(w.first)
    count = np.where(n >= k, n - k + 1, np.minimum(n, 1))
    row = np.repeat(np.arange(len(n)), count)
    begin = np.repeat(w.first[:-1] - np.append(0, np.cumsum(count)[:-1]), count) + np.arange(count.sum())
    end = np.minimum(begin + k, w.first[1:][row])
    h = mix(span_hash(sums, begin, end, GRAMS) + (end - begin).astype(np.uint64))
    order = np.lexsort((h, row))
    h, row = h[order], row[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    h, row = h[new], row[new]
    return h, np.searchsorted(row, np.arange(len(n) + 1))


def registers(h: np.ndarray, first: np.ndarray) -> np.ndarray:
    """HyperMinHash registers of each row's hashes (sorted within the row)."""
    out = np.full((len(first) - 1, REGISTERS), EMPTY, np.uint8)
    row = np.repeat(np.arange(len(first) - 1), np.diff(first))
    bucket = (h >> np.uint64(56)).astype(np.int64)
    least = np.ones(len(h), bool)  # the first hash of a bucket is its least
    least[1:] = (bucket[1:] != bucket[:-1]) | (row[1:] != row[:-1])
    rest = (h[least] << np.uint64(8)) >> np.uint64(8)  # 56 bits
    top = np.frexp(rest.astype(np.float64))[1]  # bits in use, give or take rounding
    top -= (rest >> np.maximum(top - 1, 0).astype(np.uint64)) == 0
    zeros = np.minimum(56 - top, 15)
    mantissa = (rest << np.minimum(zeros + 1, 56).astype(np.uint64) >> np.uint64(52)) & np.uint64(15)
    out[row[least], bucket[least]] = np.minimum(zeros * 16 + mantissa.astype(np.int64), EMPTY - 1)
    return out


@lru_cache
def _collisions() -> np.ndarray:
    """Chance that two unrelated registers agree, by log2 of the hashes a bucket gets (-8 to 24)."""
    zeros, mantissa = np.divmod(np.arange(256), 16)
    low = 2.0 ** -(zeros + 1) * (1 + mantissa / 16)
    low[zeros == 15] = 2.0 ** -15 * mantissa[zeros == 15] / 16
    high = np.where(zeros == 15, low + 2.0 ** -19, low + 2.0 ** -(zeros + 5))
    load = 2.0 ** np.arange(-8, 25)[:, None]
    p = np.exp(-load * low) - np.exp(-load * high)
    return ((p / p.sum(1, keepdims=True)) ** 2).sum(1)


def may_be_similar(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, percent: int) -> np.ndarray:
    """Whether the corrected Jaccard estimate leaves the threshold possible (and the set sizes do)."""
    used = (np.minimum(a, b) != EMPTY).sum(-1)
    agree = ((a == b) & (a != EMPTY)).sum(-1)
    load = np.log2(np.maximum(np.sqrt(n_a * 1.0 * n_b), 1) / REGISTERS)
    chance = _collisions()[np.clip(np.rint(load).astype(np.int64) + 8, 0, 32)]
    estimate = (agree / np.maximum(used, 1) - chance) / (1 - chance)
    t = percent / 100
    return (estimate >= t - SLACK * np.sqrt(t * (1 - t) / np.maximum(used, 1))) & (100 * np.minimum(n_a, n_b) >= percent * np.maximum(n_a, n_b))


def _signatures(k: int):
    def run(batches):
        for batch in batches:
            for s in slices(batch.column(1)):
                h, first = shingle_sets(s, k)
                n = np.diff(first)
                sums = np.append(np.zeros(1, np.uint64), np.cumsum(mix(h)))
                both = np.append(np.zeros(1, np.uint64), np.cumsum(mix(h ^ np.uint64(0xA5A5A5A5A5A5A5A5))))
                digest = [(x[first[1:]] - x[first[:-1]]).view(np.int64) for x in (sums, both)]
                sig = registers(h, first)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(s.lo, s.hi - s.lo), pa.array(n, pa.int64()), *(pa.array(d) for d in digest), pa.array([r.tobytes() for r in sig], pa.binary())],
                    ["doc_id", "n", "h1", "h2", "sig"])
    return run


#: For each register, the order in which it looks for an occupied one to borrow from.
_TURN = np.argsort(mix(np.arange(1, REGISTERS * REGISTERS + 1, dtype=np.uint64)).reshape(REGISTERS, REGISTERS), axis=1).argsort(axis=1)


def borrowed(sig: np.ndarray) -> np.ndarray:
    """Registers with the empty ones filled from occupied ones."""
    out = sig.copy()
    for row, own in zip(out, sig, strict=True):
        empty, used = np.flatnonzero(own == EMPTY), np.flatnonzero(own != EMPTY)
        if len(empty) and len(used):
            row[empty] = own[used[_TURN[np.ix_(empty, used)].argmin(1)]]
    return out


def _bands(percent: int):
    """mapInArrow: (rep, n, sig) -> (band, rep).  Sets too small to be similar to
    any other set than their equals need no bands."""
    def run(batches):
        for batch in batches:
            n = batch.column(1).to_numpy()
            some = np.flatnonzero(100 * n >= percent * (n + 1))
            rep = batch.column(0).take(pa.array(some))
            sig = borrowed(fixed_width(batch.column(2), REGISTERS)[some])
            for b in range(0, REGISTERS, ROWS):
                part = np.zeros((len(sig), 8), np.uint8)
                part[:, :min(ROWS, REGISTERS - b)] = sig[:, b:b + ROWS]
                key = mix(part.view(np.uint64).ravel() * np.uint64(REGISTERS + 1) + np.uint64(b + 1))
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), rep], ["band", "rep"])
    return run


def forest(n: int, alike) -> list[tuple[int, int]]:
    """A spanning forest of n members; alike(i, js) says which of js member i links to."""
    root = np.arange(n)
    out = []
    for i in range(n - 1):
        js = np.flatnonzero(root[i + 1:] != root[i]) + i + 1
        if len(js):
            js = js[alike(i, js)]
            for j in js.tolist():
                if root[j] != root[i]:
                    low, high = sorted((root[i], root[j]))
                    root[root == high] = low
                    out.append((i, j))
    return out


def _edges(u: np.ndarray, v: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])


def _bucket_links(percent: int):
    """mapInArrow: (g, rep, n, sig) by bucket -> forest of pairs that may be similar."""
    def run(batches):
        for batch, bounds in whole_groups(batches):
            rep, n, sig = batch.column(1).to_numpy(), batch.column(2).to_numpy(), fixed_width(batch.column(3), REGISTERS)
            size = np.diff(bounds)
            a = bounds[:-1][size == 2]
            for k in range(0, len(a), 4096):
                i = a[k:k + 4096]
                ok = may_be_similar(sig[i], sig[i + 1], n[i], n[i + 1], percent)
                yield _edges(rep[i[ok]], rep[i[ok] + 1])
            u, v = [], []
            for lo, hi in zip(bounds[:-1][size > 2].tolist(), bounds[1:][size > 2].tolist(), strict=True):
                pairs = forest(hi - lo, lambda i, js: may_be_similar(sig[lo + i], sig[lo + js], n[lo + i], n[lo + js], percent))  # noqa: B023
                u += [rep[lo + i] for i, _ in pairs]
                v += [rep[lo + j] for _, j in pairs]
            yield _edges(np.array(u, np.int64), np.array(v, np.int64))
    return run


def _cluster_links(k: int, percent: int):
    """mapInArrow: (g, rep, text) by cluster -> forest of pairs whose full sets are similar."""
    def run(batches):
        for batch, bounds in whole_groups(batches):
            rep, text = batch.column(1).to_numpy(), batch.column(2)
            u, v = [], []
            for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                if hi - lo < 2:
                    continue
                sets = [h[first[r]:first[r + 1]] for s in slices(text.slice(lo, hi - lo)) for h, first in [shingle_sets(s, k)] for r in range(s.hi - s.lo)]
                n = np.array([len(x) for x in sets])
                sig = np.concatenate([registers(x, np.array([0, len(x)])) for x in sets])

                def alike(i, js):
                    out = np.zeros(len(js), bool)
                    maybe = js[may_be_similar(sig[i], sig[js], n[i], n[js], percent) & (np.minimum(n[i], n[js]) > 0)]  # noqa: B023
                    own, at = sets[i], np.append(0, np.cumsum(n[maybe]))  # noqa: B023
                    alike_to = []
                    for part in np.split(maybe, np.flatnonzero(np.diff(at[1:] // LOOKUP)) + 1) if len(maybe) else ():
                        every = np.concatenate([sets[j] for j in part])  # noqa: B023
                        there = own[np.minimum(np.searchsorted(own, every), len(own) - 1)] == every
                        shared = np.add.reduceat(there.astype(np.int64), np.append(0, np.cumsum(n[part])[:-1]))  # noqa: B023
                        alike_to.append(part[100 * shared >= percent * (len(own) + n[part] - shared)])  # noqa: B023
                    if alike_to:
                        out = np.isin(js, np.concatenate(alike_to))
                    return out

                pairs = forest(hi - lo, alike)
                u += [rep[lo + i] for i, _ in pairs]
                v += [rep[lo + j] for _, j in pairs]
            yield _edges(np.array(u, np.int64), np.array(v, np.int64))
    return run


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Classes of documents linked by Jaccard similarity >= percent/100 of their
    sets of ``shingle``-word shingles (words between ASCII white space, A-Z lower-cased).

    Returns per row: ``doc_id``, ``n_shingles``, ``component_id`` (smallest id
    reachable by links), ``kept`` (id = component_id).  A document of fewer words
    has one shingle, its whole word sequence; without words (null, empty, blank)
    it links with nothing.  Rows that share an id count as one vertex of the link
    graph; rows whose id is null link with nothing, have a null component and are
    kept.  Ties go to the smallest id.  Other columns are not read.
    """
    rows = small_batches(docs).select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    signed = stage(rows.mapInArrow(_signatures(shingle), "doc_id long, n long, h1 long, h2 long, sig binary"), "signed")
    classes = stage(signed.where("n > 0 and doc_id is not null").groupBy("h1", "h2", "n").agg(F.min("doc_id").alias("rep"), F.first("sig").alias("sig")).select("rep", "n", "sig", "h1", "h2"), "classes")
    bands = stage(classes.select("rep", "n", "sig").mapInArrow(_bands(percent), "band long, rep long"), "bands")
    crowds = bands.groupBy("band").agg(F.count("*").alias("members")).where("members > 1")
    met = bands.join(crowds, "band")
    met = dealt_in_blocks(met, ["band"], "rep", "members", BUCKET_BLOCK).select("g", "rep")
    met = met.join(classes.select("rep", "n", "sig"), "rep").select("g", "rep", "n", "sig")
    maybe = together(met).mapInArrow(_bucket_links(percent), "u long, v long")
    clusters = stage(components(maybe), "clusters")
    sizes = clusters.groupBy("c").agg(F.count("*").alias("members"))
    near = sieved(rows.where(F.col("doc_id").isNotNull()).withColumnRenamed("doc_id", "u"), clusters.select("u"), "u").where("_maybe").select("u", "text")
    held = near.join(clusters.join(sizes, "c"), "u")
    texts = dealt_in_blocks(held, ["c"], "u", "members", CLUSTER_BLOCK).select("g", "u", "text")
    links = together(texts).mapInArrow(_cluster_links(shingle, percent), "u long, v long")
    labelled = signed.select("doc_id", "n", "h1", "h2").join(classes.select("h1", "h2", "n", "rep"), ["h1", "h2", "n"], "left")
    repeated = signed.groupBy("doc_id").agg(F.count("*").alias("rows")).where("rows > 1").select("doc_id")
    ties = labelled.join(repeated, "doc_id").where("rep <> doc_id").select(F.col("doc_id").alias("u"), F.col("rep").alias("v"))
    found = components(links.unionByName(ties))
    return labelled.join(found.withColumnRenamed("u", "rep"), "rep", "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("c", "rep", "doc_id")).alias("component_id"),
    ).withColumn("kept", F.col("doc_id").isNull() | (F.col("doc_id") == F.col("component_id")))
