"""Hierarchical language identification: the family first, then the language in it.

Texts become square-rooted, length-normalised counts of hashed letter bigrams
and trigrams.  Linear support vector machines (squared hinge), one-versus-rest,
separate the families; within a family a machine for each pair of languages
votes.  They are fitted on a bounded sample; every text is scored whole.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verdant.llm.sampling import per_class, remainder
from verdant.llm.shared import schema, small_batches, whole
from verdant.llm.text import Slice, slices

DIMENSIONS = 4096
#: Documents of each language that the machines are fitted on, and languages at most.
PER_LANGUAGE, LANGUAGES = 300, 200
UNKNOWN = "und"
#: A text is in a learned language if its evidence is at least SHARE of what all but RARE of the fitting
#: sample reach; texts of under SHORT bytes hold too little evidence to tell and count as being in one.
SHARE, RARE, SHORT = 0.25, 0.01, 40
#: Families of language codes; a code not listed is a family of its own.
FAMILIES = {
    "germanic": ("da", "de", "en", "fy", "is", "nb", "nl", "nn", "no", "sv"),
    "romance": ("ca", "es", "fr", "gl", "it", "oc", "pt", "ro"),
    "slavic": ("be", "bg", "cs", "hr", "mk", "pl", "ru", "sk", "sl", "sr", "uk"),
    "uralic": ("et", "fi", "hu"),
    "turkic": ("az", "kk", "tr", "uz"),
    "indo-aryan": ("bn", "gu", "hi", "mr", "pa", "ur"),
}


def _fold() -> np.ndarray:
    """Lower-case ASCII letters and bytes of other characters as they are; the rest are blanks."""
    out = np.full(256, 32, np.uint32)
    out[97:123] = np.arange(97, 123)
    out[65:91] = np.arange(97, 123)
    out[128:] = np.arange(128, 256)
    return out


_LETTERS = _fold()


def counted(codes: np.ndarray, row: np.ndarray, rows: int, dimensions: int) -> np.ndarray:
    return np.bincount(row * dimensions + codes, minlength=rows * dimensions).reshape(rows, dimensions).astype(np.float32)


def gram_codes(symbols: np.ndarray, n: int, seed: int, bits: int) -> np.ndarray:
    """Hashes, of ``bits`` bits, of all n-grams of small numbers."""
    code = np.full(max(0, len(symbols) - n + 1), seed, np.uint32)
    for k in range(n):
        code = code * np.uint32(0x01000193) + symbols[k:k + len(code)]
    code = (code ^ (code >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
    return (code >> np.uint32(32 - bits)).astype(np.int64)


def normalised(x: np.ndarray) -> np.ndarray:
    x = np.sqrt(x)
    length = np.sqrt((x * x).sum(1, keepdims=True))
    return x / np.where(length == 0, 1, length)


def letter_features(s: Slice) -> np.ndarray:
    rows = s.hi - s.lo
    symbols = _LETTERS[s.data]
    row = np.repeat(np.arange(rows), np.diff(s.offsets))
    out = np.zeros((rows, DIMENSIONS), np.float32)
    for n in (2, 3):
        codes = gram_codes(symbols, n, n, 12)
        if len(codes):
            inside = (row[:len(codes)] == row[n - 1:]) & ((symbols[:len(codes)] != 32) | (symbols[1:len(codes) + 1] != 32))
            out += counted(codes[inside], row[:len(codes)][inside], rows, DIMENSIONS)
    return normalised(out)


def fit_machines(x: np.ndarray, y: np.ndarray, classes: int, c: float = 30.0, rounds: int = 300) -> tuple[np.ndarray, np.ndarray]:
    """One-versus-rest linear machines with squared hinge loss, by accelerated gradient."""
    target = np.where(y[:, None] == np.arange(classes), 1.0, -1.0)
    w, b = np.zeros((x.shape[1], classes)), np.zeros(classes)
    v, a = w.copy(), b.copy()
    share = np.maximum((target > 0).sum(0), 1), np.maximum((target < 0).sum(0), 1)
    weight = c * np.where(target > 0, 0.5 / share[0], 0.5 / share[1])
    step = 1.0 / (1.0 + 4 * weight.sum(0).max())
    for k in range(rounds):
        slack = np.maximum(1 - target * (x @ v + a), 0) * weight * target
        w_new, b_new = v - step * (v - 2 * x.T @ slack), a + step * 2 * slack.sum(0)
        pace = k / (k + 3)
        v, a = w_new + pace * (w_new - w), b_new + pace * (b_new - b)
        w, b = w_new, b_new
    return w, b


@dataclass
class LanguageModel:
    languages: list[str]
    families: list[list[int]]
    pairs: list[list[tuple[int, int]]]  # of each family, as places in it
    weights: np.ndarray = field(repr=False)  # columns: families, then pairs
    bias: np.ndarray = field(repr=False)
    least: float = 0.0  # evidence that a text in a learned language has

    def predict(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Number of the language, a score in (0, 1), and the evidence: the smaller one of
        the margin of the family and the least margin of the language over another."""
        margin = x @ self.weights + self.bias
        first = margin[:, :len(self.families)]
        chosen = first.argmax(1)
        score, evidence = _certainty(first), first.max(1).astype(np.float64)
        out, column = np.zeros(len(x), np.int64), len(self.families)
        for f, members in enumerate(self.families):
            rows, pairs = np.flatnonzero(chosen == f), self.pairs[f]
            which, least = vote(margin[rows, column:column + len(pairs)], pairs, len(members))
            out[rows] = np.array(members)[which]
            if pairs:
                score[rows] *= 1 / (1 + np.exp(-6 * np.maximum(least, 0)))
                evidence[rows] = np.minimum(evidence[rows], least)
            column += len(pairs)
        return out, score, evidence


def vote(margin: np.ndarray, pairs: list[tuple[int, int]], classes: int) -> tuple[np.ndarray, np.ndarray]:
    """The class with most pairs won (ties: larger sum of margins, then the first) and its least margin."""
    votes, sums, least = np.zeros((len(margin), classes)), np.zeros((len(margin), classes)), np.full((len(margin), classes), np.inf)
    for k, (i, j) in enumerate(pairs):
        for c, m in ((i, margin[:, k]), (j, -margin[:, k])):
            votes[:, c] += (m > 0) | ((m == 0) & (c == i))
            sums[:, c] += m
            least[:, c] = np.minimum(least[:, c], m)
    won = np.where(votes == votes.max(1, keepdims=True), sums, -np.inf).argmax(1)
    return won, least[np.arange(len(margin)), won]


def _certainty(margin: np.ndarray) -> np.ndarray:
    """Logistic of the gap between the best and the next margin; 1 if there is no other."""
    if margin.shape[1] < 2:
        return np.ones(len(margin))
    top = np.sort(margin, axis=1)
    return 1 / (1 + np.exp(-3 * (top[:, -1] - top[:, -2])))


def family_of(language: str) -> str:
    return next((name for name, members in FAMILIES.items() if language.split("-")[0].lower() in members), language)


def _sample_features(batches):
    for batch in batches:
        for s in slices(batch.column(1), max_rows=128):
            x = letter_features(s)
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(s.lo, s.hi - s.lo), pa.array([r.tobytes() for r in x], pa.binary())], ["lang", "x"])


def fit(docs: DataFrame, learn: Column, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> LanguageModel | None:
    """Fit on a sample of PER_LANGUAGE documents of each language among the rows where ``learn`` holds."""
    rows = small_batches(docs).where(learn & F.col(lang).isNotNull() & (F.trim(F.col(text)) != "")).select(F.col(doc_id).alias("doc_id"), F.col(lang).cast("string").alias("lang"), F.col(text).cast("string").alias("text"))
    sample = per_class(rows, "lang", "doc_id", PER_LANGUAGE, LANGUAGES).select("lang", "text").mapInArrow(_sample_features, "lang string, x binary").collect()
    if not sample:
        return None
    languages = sorted({r["lang"] for r in sample})
    x = np.stack([np.frombuffer(r["x"], np.float32) for r in sample]).astype(np.float64)
    y = np.array([languages.index(r["lang"]) for r in sample])
    order = np.lexsort((x[:, 0], x.sum(1), y))  # whatever order the rows came in
    x, y = x[order], y[order]
    names = sorted({family_of(name) for name in languages})
    family = np.array([names.index(family_of(name)) for name in languages])
    w, b = fit_machines(x, family[y], len(names))
    members = [np.flatnonzero(family == f).tolist() for f in range(len(names))]
    weights, bias = [w], [b]
    pairs = [[(i, j) for j in range(len(group)) for i in range(j)] for group in members]
    for group, inner in zip(members, pairs, strict=True):
        for i, j in inner:
            rows_in = (y == group[i]) | (y == group[j])
            w, b = fit_machines(x[rows_in], (y[rows_in] == group[j]).astype(int), 2)
            weights.append(w[:, :1])
            bias.append(b[:1])
    model = LanguageModel(languages, members, pairs, np.hstack(weights).astype(np.float32), np.concatenate(bias).astype(np.float32))
    model.least = max(0.0, SHARE * float(np.quantile(model.predict(x)[2], RARE)))
    return model


def _predict(model: LanguageModel | None):
    def run(batches):
        for batch in batches:
            usable = batch.column(1).to_numpy(zero_copy_only=False)
            for s in slices(batch.column(0), max_rows=256):
                ok = usable[s.lo:s.hi]
                if model is None:
                    names, score, known = [UNKNOWN] * len(ok), np.zeros(len(ok)), np.zeros(len(ok), bool)
                else:
                    which, score, evidence = model.predict(letter_features(s))
                    names = [model.languages[k] if u else UNKNOWN for k, u in zip(which.tolist(), ok.tolist(), strict=True)]
                    score, known = np.where(ok, score, 0.0), ok.astype(bool) & ((evidence >= model.least) | (np.diff(s.offsets) < SHORT))
                yield pa.RecordBatch.from_arrays([batch.column(2).slice(s.lo, s.hi - s.lo), pa.array(names, pa.string()), pa.array(score, pa.float64()), pa.array(known, pa.bool_())], ["row", "lang_pred", "score", "learned"])
    return run


def identify(docs: DataFrame, model: LanguageModel | None, keep: list[str], text: str = "text") -> DataFrame:
    """``row`` (a struct of the columns ``keep``), ``lang_pred``, ``score`` and ``learned`` (there is
    evidence enough for a learned language) of every row's whole text.

    A null text, one without letters, or any text if nothing could be learned
    gives ("und", 0, false).  Ties go to the first language in alphabetical order.
    Columns that are not asked for are not read.
    """
    t = F.col(text).cast("string")
    rows = small_batches(docs).select(t.alias("text"), F.coalesce(F.regexp_like(t, F.lit(r"\p{L}")), F.lit(False)).alias("usable"), whole(keep))
    return rows.mapInArrow(_predict(model), schema(rows.schema["row"], "lang_pred string, score double, learned boolean"))


def held_out(doc_id: str, of: int, which: int) -> Column:
    return F.coalesce(remainder(doc_id, of) == which, F.lit(False))
