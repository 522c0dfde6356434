"""Toxicity grades by cumulative-link ordinal regression on sparse text features.

Features are the hashed words of a text and their first four and five bytes.
Grade 0 is a text labelled clean; labelled toxic texts are grade 1, 2 or 3 by
how many of their words are tied to the label.  One weight per feature is shared
by all thresholds: P(grade > k) = logistic(weights . x - threshold_k).
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verdant.llm.quality import labelled
from verdant.llm.shared import schema, small_batches, whole
from verdant.llm.text import ALNUM, GRAMS, Slice, WordRule, mix, prefix_sums, slices, span_hash, word_hashes, words

#: Labelled documents of each class in the sample, and features that are kept.
PER_CLASS, FEATURES = 2000, 4096
GRADES = 4
_RULE = WordRule(ALNUM.inside | ((np.arange(256) >= 65) & (np.arange(256) <= 90)), WordRule.make(b"", lower=True).values, WordRule.make(b"", lower=True).fold)


def text_features(s: Slice) -> tuple[np.ndarray, np.ndarray]:
    """Row and 64-bit name of each word and of its first four and five bytes."""
    w = words(s, _RULE)
    row = w.row
    names, rows = [word_hashes(s, w, _RULE)], [row]
    sums = prefix_sums(_RULE.values[s.data], GRAMS)
    for n in (4, 5):
        longer = w.end - w.start > n
        names.append(mix(span_hash(sums, w.start[longer], w.start[longer] + n, GRAMS) + np.uint64(n)))
        rows.append(row[longer])
    return np.concatenate(rows), np.concatenate(names)


@dataclass
class ToxicityModel:
    names: np.ndarray  # sorted
    weights: np.ndarray
    thresholds: np.ndarray

    def counts(self, row: np.ndarray, name: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The model's features found: row, feature and how often."""
        if not len(self.names) or not len(name):
            return (np.zeros(0, np.int64),) * 3
        at = np.minimum(np.searchsorted(self.names, name), len(self.names) - 1)
        hit = self.names[at] == name
        pair, times = np.unique(row[hit] * len(self.names) + at[hit], return_counts=True)
        return pair // len(self.names), pair % len(self.names), times

    def score(self, row: np.ndarray, name: np.ndarray, rows: int) -> np.ndarray:
        """P(grade > k) of each row for k = 0, 1, ..."""
        r, f, times = self.counts(row, name)
        total = np.bincount(r, np.log2(1 + times) * self.weights[f], minlength=rows)
        return 1 / (1 + np.exp(-np.clip(total[:, None] - self.thresholds, -50, 50)))


def _sample_features(batches):
    for batch in batches:
        for s in slices(batch.column(2)):
            row, name = text_features(s)
            pair, times = np.unique(np.stack([row.astype(np.uint64), name]), axis=1, return_counts=True) if len(row) else (np.zeros((2, 0), np.uint64), np.zeros(0, np.int64))
            at = pa.array(pair[0].astype(np.int64) + s.lo)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(pair[1].view(np.int64)), pa.array(times, pa.int32())], ["id", "label", "feature", "times"])


def fit(docs: DataFrame, labels: DataFrame, learn: Column | None = None, label: str = "toxic", doc_id: str = "doc_id", text: str = "text") -> ToxicityModel | None:
    """Fit on about PER_CLASS documents of each label.

    Features must stand in three or more sampled toxic texts and be tied to the
    label (log-odds above 3); the FEATURES strongest are kept."""
    sample = labelled(docs, labels, label, F.lit(True) if learn is None else learn, PER_CLASS, doc_id, text).mapInArrow(_sample_features, "id long, label int, feature long, times int")
    sample = sample.persist()
    try:
        size = {r["label"]: r["n"] for r in sample.groupBy("label").agg(F.countDistinct("id").alias("n")).collect()}
        if not size.get(1) or not size.get(0):
            return None
        odds = F.log((F.col("t") + 0.5) / (size[1] + 1.0)) - F.log((F.col("c") + 0.5) / (size[0] + 1.0))
        strong = sample.groupBy("feature").agg(F.sum("label").alias("t"), F.sum(1 - F.col("label")).alias("c")).where("t > 2").withColumn("odds", odds).where("odds > 3").orderBy(F.desc(F.col("odds") * F.col("t")), "feature").limit(FEATURES)
        strong = strong.select("feature").collect()
        names = np.sort(np.array([r["feature"] for r in strong], np.int64).view(np.uint64))
        if not len(names):
            return None
        rows = sample.join(F.broadcast(sample.sparkSession.createDataFrame([(int(n),) for n in names.view(np.int64)], "feature long")), "feature").select("id", "label", "feature", "times").collect()
    finally:
        sample.unpersist()
    ids = sorted({r["id"] for r in rows})
    number = {d: k for k, d in enumerate(ids)}
    toxic = np.zeros(len(ids), bool)
    x = np.zeros((len(ids), len(names)))
    for r in rows:
        k = number[r["id"]]
        toxic[k] = r["label"] == 1
        x[k, np.searchsorted(names, np.array([r["feature"]], np.int64).view(np.uint64)[0])] = np.log2(1 + r["times"])
    # texts without any of the features are all alike: they go in with their weight
    blank = {y: size[y] - int((toxic == bool(y)).sum()) for y in (0, 1)}
    amount = x.sum(1)
    cuts = np.quantile(amount[toxic], np.arange(1, GRADES - 1) / (GRADES - 1)) if toxic.any() else np.zeros(GRADES - 2)
    grade = np.where(toxic, 1 + np.searchsorted(cuts, amount, "left"), 0)
    x = np.vstack([x, np.zeros((2, len(names)))])
    grade = np.append(grade, [0, 1])
    weight = np.append(np.ones(len(ids)), [blank[0], blank[1]]).astype(float)
    return ToxicityModel(names, *_fit_cumulative(x, grade, weight / weight.sum()))


def _fit_cumulative(x: np.ndarray, grade: np.ndarray, weight: np.ndarray, rounds: int = 600, penalty: float = 1e-4) -> tuple[np.ndarray, np.ndarray]:
    """Shared weights and rising thresholds by accelerated gradient steps on the
    logistic losses of all the questions "is the grade above k?"."""
    k = GRADES - 1
    above = grade[:, None] > np.arange(k)
    w, t = np.zeros(x.shape[1]), np.linspace(0, 1, k)
    v, s = w.copy(), t.copy()
    step = 1.0 / (0.25 * k * ((x * x).sum(1) * weight).sum() + 0.25 + penalty)
    for n in range(rounds):
        p = 1 / (1 + np.exp(-np.clip((x @ v)[:, None] - s, -50, 50)))
        gap = (p - above) * weight[:, None]
        w_new = v - step * (x.T @ gap.sum(1) + penalty * v)
        t_new = np.maximum.accumulate(s + step * gap.sum(0))  # kept in order
        pace = n / (n + 3)
        v, s = w_new + pace * (w_new - w), t_new + pace * (t_new - t)
        w, t = w_new, t_new
    return w, t


def _grade(model: ToxicityModel | None):
    def run(batches):
        for batch in batches:
            for s in slices(batch.column(0)):
                n = s.hi - s.lo
                above = np.zeros((n, GRADES - 1)) if model is None else model.score(*text_features(s), n)
                grade = (above > 0.5).sum(1)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(1).slice(s.lo, n), pa.array(above[:, 0]), pa.array(above.sum(1)), pa.array(grade, pa.int32())], ["row", "p_toxic", "severity", "grade"])
    return run


def grade(docs: DataFrame, model: ToxicityModel | None, keep: list[str], text: str = "text") -> DataFrame:
    """``row`` (a struct of the columns ``keep``), ``p_toxic`` (chance of a grade above 0), ``severity``
    (expected grade, 0 to 3), ``grade`` (how many thresholds are more likely passed
    than not) and ``toxic`` (grade above 0) of every row's whole text.

    A null or empty text has no features; without a model all are 0.  Columns
    that are not asked for are not read."""
    rows = small_batches(docs).select(F.col(text).cast("string").alias("text"), whole(keep))
    return rows.mapInArrow(_grade(model), schema(rows.schema["row"], "p_toxic double, severity double, grade int")).withColumn("toxic", F.col("grade") > 0)
