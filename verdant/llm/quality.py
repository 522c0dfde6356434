"""Quality scores by nearest-neighbour voting among labelled latent-semantic vectors.

A text becomes weighted counts of hashed terms: letter trigrams, grams of
character classes (case, digits, punctuation, blanks) and word repetitions.  A
truncated singular value decomposition of a bounded labelled sample gives the
latent space.  The sample's vectors are broadcast (their number is bounded);
every document's cosines with all of them are computed exactly, in blocks, and
its nearest neighbours vote with their similarities.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verdant.llm.language_id import counted, gram_codes
from verdant.llm.sampling import per_class
from verdant.llm.shared import schema, small_batches, whole
from verdant.llm.text import PLAIN, Slice, slices, word_hashes, words

#: Labelled documents of each class in the sample.
PER_CLASS = 1000
LATENT, NEIGHBOURS = 48, 25
_CONTENT, _SHAPE, _REPEAT = 10, 10, 5  # bits of each kind of term
DIMENSIONS = (1 << _CONTENT) + (1 << _SHAPE) + (1 << _REPEAT)


def _classes() -> np.ndarray:
    """Punctuation and blanks as they are; letters, capitals, digits and other characters as one each."""
    out = np.arange(256, dtype=np.uint32)
    for first, last in (("a", "z"), ("A", "Z"), ("0", "9")):
        out[ord(first):ord(last) + 1] = ord(first)
    out[128:] = ord("a")
    return out


_CLASS = _classes()


def term_features(s: Slice) -> np.ndarray:
    """Rows of term weights: square-rooted shares within each kind of term."""
    rows = s.hi - s.lo
    row = np.repeat(np.arange(rows), np.diff(s.offsets))
    blocks = []
    for symbols, n, bits in ((s.data.astype(np.uint32), 3, _CONTENT), (_CLASS[s.data], 3, _SHAPE)):
        codes = gram_codes(symbols, n, bits, bits)
        inside = row[:len(codes)] == row[n - 1:] if len(codes) else np.zeros(0, bool)
        blocks.append(counted(codes[inside], row[:len(codes)][inside], rows, 1 << bits))
    w = words(s, PLAIN)
    h, of = word_hashes(s, w, PLAIN), w.row
    same = np.zeros((len(h), 2), np.int64)  # does a word repeat the one before, or the one before that?
    for back in (1, 2):
        same[back:, back - 1] = (h[back:] == h[:-back]) & (of[back:] == of[:-back])
    seen = np.ones(len(h), np.int64)  # has the word stood in the text before?
    order = np.lexsort((np.arange(len(h)), h, of))
    again = (h[order][1:] == h[order][:-1]) & (of[order][1:] == of[order][:-1])
    seen[order[1:]] = np.where(again, 2, 1)
    blocks.append(counted(same[:, 0] * 16 + same[:, 1] * 8 + seen, of, rows, 1 << _REPEAT))
    out = []
    for block, weight in zip(blocks, (0.5, 1.0, 1.0), strict=True):
        total = block.sum(1, keepdims=True)
        out.append(np.float32(weight) * np.sqrt(block / np.where(total == 0, 1, total)))
    return np.hstack(out)


@dataclass
class QualityModel:
    centre: np.ndarray
    project: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray
    prior: float

    def embed(self, x: np.ndarray) -> np.ndarray:
        z = (x - self.centre) @ self.project
        length = np.sqrt((z * z).sum(1, keepdims=True))
        return z / np.where(length == 0, 1, length)

    def score(self, x: np.ndarray) -> np.ndarray:
        cosine = self.embed(x) @ self.vectors.T
        k = min(NEIGHBOURS, cosine.shape[1])
        near = np.argpartition(-cosine, k - 1, axis=1)[:, :k]
        weight = np.maximum(np.take_along_axis(cosine, near, 1), 0) ** 4
        total = weight.sum(1)
        score = (weight * self.labels[near]).sum(1) / np.where(total == 0, 1, total)
        return np.where((total == 0) | (x.sum(1) == 0), self.prior, np.clip(score, 0, 1))


def _sample_features(batches):
    for batch in batches:
        for s in slices(batch.column(2), max_rows=128):
            x = term_features(s)
            yield pa.RecordBatch.from_arrays([*(batch.column(k).slice(s.lo, s.hi - s.lo) for k in (0, 1)), pa.array([r.tobytes() for r in x], pa.binary())], ["id", "label", "x"])


def labelled(docs: DataFrame, labels: DataFrame, label: str, learn: Column, size: int, doc_id: str, text: str) -> DataFrame:
    """A bounded sample (id, label, text) of the labelled documents.  Of repeated
    labels of a document the greatest counts; null labels count for nothing."""
    chosen = labels.where(learn).select(F.col(doc_id).alias("id"), F.col(label).cast("int").alias("label")).where("id is not null and label is not null").groupBy("id").agg(F.max("label").alias("label"))
    chosen = per_class(chosen, "label", "id", size, 16)  # ids and labels only; at most 32 * size rows are expected
    return small_batches(docs).select(F.col(doc_id).alias("id"), F.col(text).cast("string").alias("text")).join(F.broadcast(chosen), "id").select("id", "label", "text")


def fit(docs: DataFrame, labels: DataFrame, learn: Column, label: str = "quality", doc_id: str = "doc_id", text: str = "text") -> QualityModel | None:
    """Latent vectors of about PER_CLASS documents of each label among the rows of ``labels`` where ``learn`` holds."""
    sample = labelled(docs, labels, label, learn, PER_CLASS, doc_id, text).mapInArrow(_sample_features, "id long, label int, x binary").collect()
    if not sample:
        return None
    sample.sort(key=lambda r: (r["id"], r["label"], r["x"]))
    x = np.stack([np.frombuffer(r["x"], np.float32) for r in sample])
    y = np.array([r["label"] for r in sample], np.float32)
    centre = x.mean(0)
    a = (x - centre).astype(np.float64)
    draw = np.random.default_rng(7).standard_normal((a.shape[1], min(LATENT + 16, *a.shape)))
    basis = a @ draw
    for _ in range(4):  # subspace iteration
        basis = a @ (a.T @ np.linalg.qr(basis)[0])
    q = np.linalg.qr(basis)[0]
    project = np.linalg.svd(q.T @ a, full_matrices=False)[2][:LATENT].T.astype(np.float32)
    model = QualityModel(centre, project, np.zeros((0, 0)), y, 0.0)
    model.vectors = model.embed(x).astype(np.float32)
    model.prior = float(y.mean())
    return model


def _score(model: QualityModel | None):
    def run(batches):
        for batch in batches:
            for s in slices(batch.column(0), max_rows=256):
                value = np.full(s.hi - s.lo, 0.5) if model is None else model.score(term_features(s)).astype(np.float64)
                yield pa.RecordBatch.from_arrays([batch.column(1).slice(s.lo, s.hi - s.lo), pa.array(value)], ["row", "score"])
    return run


def score(docs: DataFrame, model: QualityModel | None, keep: list[str], text: str = "text") -> DataFrame:
    """``row`` (a struct of the columns ``keep``) and ``score`` (0 to 1, higher: label 1
    likelier) of every row's whole text.  A null or empty text, or one that is
    near no labelled vector, scores the sample's share of label 1; without any
    labels all score 0.5.  Columns that are not asked for are not read."""
    rows = small_batches(docs).select(F.col(text).cast("string").alias("text"), whole(keep))
    return rows.mapInArrow(_score(model), schema(rows.schema["row"], "score double"))
