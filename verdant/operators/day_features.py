"""Lags, rolling statistics and fills of a series' day rows: Spark
groups the narrow rows by series, a series is one matrix of at most its days."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def matrix(t: pa.Table, cols) -> tuple[np.ndarray, np.ndarray]:
    """Values (a row per column) and where they are not null."""
    held = [t.column(c).combine_chunks() for c in cols]
    x = np.array([c.to_numpy(zero_copy_only=False) for c in held], float).reshape(len(held), t.num_rows)
    return x, np.array([c.is_valid().to_numpy(zero_copy_only=False) for c in held], bool).reshape(x.shape)


def lagged(x: np.ndarray, there: np.ndarray, n: int):
    before, held = np.full(x.shape, np.nan), np.zeros(x.shape, bool)
    before[:, n:], held[:, n:] = x[:, :-n], there[:, :-n]
    return before, held


def rolling(x: np.ndarray, there: np.ndarray, w: int):
    """Mean, sample standard deviation, least and largest of the last ``w`` rows, where
    all hold a value: one value after the other, as an aggregate of rows takes them."""
    told = [np.full(x.shape, np.nan) for _ in range(4)]
    held = np.zeros(x.shape, bool)
    ends = x.shape[1] - w + 1
    if ends > 0:
        total, mean, m2 = np.zeros((3, len(x), ends))
        least, most, full = x[:, :ends], x[:, :ends], np.ones((len(x), ends), bool)
        for k in range(w):
            v = x[:, k:k + ends]
            full &= there[:, k:k + ends]
            total += v
            delta = v - mean
            step = delta / (k + 1)
            mean += step
            m2 += delta * (delta - step)
            least, most = np.fmin(least, v), np.maximum(most, v)
        for to, values in zip(told, (total / w, np.sqrt(m2 / (w - 1)), least, most), strict=True):
            to[:, w - 1:] = values
        held[:, w - 1:] = full
    return told, held


def filled(x: np.ndarray, there: np.ndarray) -> np.ndarray:
    """The latest value so far, before the first one that, without any 0."""
    latest = np.maximum.accumulate(np.where(there, np.arange(x.shape[1]), -1), axis=1)
    at = np.where(latest < 0, there.argmax(axis=1)[:, None], latest)
    return np.where(there.any(axis=1)[:, None], np.take_along_axis(x, at, axis=1), 0.0)


def by_day(ts: str, label: str, kept, cols, others, lags, windows):
    """applyInArrow: the rows of a series -> the same rows where ``label`` is not null,
    with ``kept`` as they are, and ``cols``, their lags, their rolling statistics and ``others`` filled."""
    def run(t: pa.Table) -> pa.Table:
        t = t.take(pc.sort_indices(t, sort_keys=[(ts, "ascending")], null_placement="at_start"))
        x, there = matrix(t, cols)
        parts = [(x, there), *[lagged(x, there, n) for n in lags]]
        with np.errstate(invalid="ignore", over="ignore"):
            for w in windows:
                told, held = rolling(x, there, w)
                parts += [(values, held) for values in told]
        parts.append(matrix(t, others))
        rows = t.column(label).is_valid().to_numpy()
        values = [filled(v[:, rows], ok[:, rows]) for v, ok in parts] if rows.any() else [v[:, rows] for v, _ in parts]
        keep = t.filter(pa.array(rows))
        return pa.table([*[keep.column(c) for c in kept], *[pa.array(row) for v in values for row in v]],
                        names=[*kept, *[f"c{i}" for i in range(sum(len(v) for v in values))]])
    return run
