"""Vector codes by product quantisation, with adaptive distance bounds
(J. Drake and G. Hamerly, "Accelerated k-means with adaptive distance bounds").

Vectors of whole numbers are cut into parts; each part position has a codebook,
and a vector's code names the nearest entry of each.  Codebooks are refined by
rounds of assignment and averaging.  From one round to the next, every part
keeps its entry, its b next closest entries with ordered lower bounds on their
distances, and one outer bound for all others.  Entries move, so the bounds
sink; a part whose exact distance to its entry still lies under a bound can't
have a nearer entry beyond it, and only the entries before it are looked at, in
exact integer arithmetic.  Parts that no bound settles are measured against the
whole codebook.  b follows what the last round needed, between an eighth and a
quarter of the entries.

The bounds are two-byte floats rounded down, and travel with the vectors in a
table of the shared folder, one for each round.  The driver sees codebooks and
their sums only.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from verdant.llm.groups import fixed_width
from verdant.llm.integers import lists, pack, whole_numbers
from verdant.llm.shared import schema, stage, whole

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: Share of parts that the bounds kept should settle.
SETTLED = 0.99
#: Vectors that a task works on at a time.
SLICE = 2048
_SLACK = 1e-9


def state_type(b: int) -> np.dtype:
    """What is kept of a part: its entry, the next ``b`` with their bounds, the outer bound, and how many it took to settle it."""
    return np.dtype([("own", "u1"), ("near", "u1", (b,)), ("low", "f2", (b,)), ("outer", "f2"), ("used", "u1")])


def half_down(x: np.ndarray) -> np.ndarray:
    """Two-byte floats that are not above ``x``."""
    x = np.clip(x, 0, None)
    finite = np.minimum(x, 65504.0)
    h = finite.astype(np.float16)
    h = np.where(h.astype(np.float64) > finite, np.nextafter(h, np.float16(0)), h)
    return np.where(np.isinf(x), np.float16(np.inf), h)


def measure(x: np.ndarray, book: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows to entries."""
    most = max(int(np.abs(x).max(initial=0)), int(np.abs(book).max(initial=0)))
    if 4 * most * most * x.shape[1] < 1 << 53:  # then doubles are exact
        x, book = x.astype(np.float64), book.astype(np.float64)
        return ((x * x).sum(1)[:, None] - 2 * (x @ book.T) + (book * book).sum(1)).astype(np.int64)
    gap = x[:, None, :] - book[None]
    return (gap * gap).sum(2)


def _to_some(x: np.ndarray, book: np.ndarray, entry: np.ndarray) -> np.ndarray:
    gap = x.reshape(len(x), *[1] * (entry.ndim - 1), -1) - book[entry]
    return (gap * gap).sum(-1)


def assign_all(x: np.ndarray, book: np.ndarray, b: int) -> tuple[np.ndarray, np.ndarray]:
    """State and squared distance of rows measured against all entries; ties go to the lower index."""
    far = measure(x, book)
    order = np.argsort(far, axis=1, kind="stable")
    some = min(b, len(book) - 1)
    state = np.zeros(len(x), state_type(b))
    state["own"], state["near"][:, :some] = order[:, 0], order[:, 1:some + 1]
    state["low"], state["outer"], state["used"] = np.inf, np.inf, b + 1
    root = np.sqrt(np.take_along_axis(far, order[:, :some + 2], 1).astype(np.float64)) * (1 - _SLACK)
    state["low"][:, :some] = half_down(root[:, 1:some + 1])
    if len(book) > some + 1:
        state["outer"] = half_down(root[:, some + 1])
    return state, np.take_along_axis(far, order[:, :1], 1)[:, 0]


def assign_bounded(x: np.ndarray, book: np.ndarray, state: np.ndarray, moved: np.ndarray, b: int) -> tuple[np.ndarray, np.ndarray]:
    """State (of ``b`` bounds, no more than before) and squared distance of rows after entries have moved by ``moved``."""
    held = state["near"].shape[1]
    near, own = state["near"].astype(np.int64), state["own"].astype(np.int64)
    low = np.concatenate([state["low"].astype(np.float64) - moved[near], state["outer"].astype(np.float64)[:, None] - moved.max()], axis=1)
    low = np.minimum.accumulate(low[:, ::-1], axis=1)[:, ::-1]  # each bounds all entries from its place on
    best = _to_some(x, book, own)
    certain = (np.sqrt(best.astype(np.float64)) * (1 + _SLACK) + _SLACK)[:, None] < low
    used = np.where(certain.any(1), certain.argmax(1), held + 1)
    some = np.flatnonzero((used > 0) & (used <= held))
    if len(some):
        far = _to_some(x[some], book, near[some])
        beyond = np.arange(held)[None] >= used[some][:, None]
        entry = np.concatenate([own[some][:, None], near[some]], axis=1)
        gap = np.concatenate([best[some][:, None], np.where(beyond, np.iinfo(np.int64).max, far)], axis=1)
        tie = np.concatenate([own[some][:, None], np.where(beyond, np.arange(held)[None], near[some])], axis=1)
        bound = np.concatenate([np.sqrt(best[some].astype(np.float64))[:, None] * (1 - _SLACK), np.where(beyond, low[some][:, :-1], np.sqrt(far.astype(np.float64)) * (1 - _SLACK))], axis=1)
        order = np.lexsort((tie, gap), axis=1)
        entry, bound = np.take_along_axis(entry, order, 1), np.take_along_axis(bound, order, 1)
        own[some], near[some], best[some] = entry[:, 0], entry[:, 1:], np.take_along_axis(gap, order[:, :1], 1)[:, 0]
        low[some] = np.concatenate([bound[:, 1:], low[some][:, -1:]], axis=1)
    low = half_down(np.minimum.accumulate(low[:, ::-1], axis=1)[:, ::-1])
    out = np.zeros(len(x), state_type(b))
    out["own"], out["near"], out["low"], out["outer"], out["used"] = own, near[:, :b], low[:, :b], low[:, b], used
    open_ = np.flatnonzero(used > held)
    if len(open_):
        out[open_], best[open_] = assign_all(x[open_], book, b)
        out["used"][open_] = held + 1
    return out, best


def _cut(column: pa.Array, parts: int) -> np.ndarray:
    return lists(column).reshape(len(column), parts, -1)


def _assign(books: np.ndarray, moved: np.ndarray | None, held: int, b: int, last: bool):
    """mapInArrow: (row, q[, state]) -> (row, q, state), or at last (row, code, error)."""
    def run(batches):
        for whole_batch in batches:
            for lo in range(0, whole_batch.num_rows, SLICE):
                batch = whole_batch.slice(lo, SLICE)
                x = _cut(batch.column(1), len(books))
                old = None if moved is None else fixed_width(batch.column(2), state_type(held).itemsize * len(books)).reshape(-1).view(state_type(held)).reshape(len(x), -1)
                told = [assign_all(x[:, p], book, b) if old is None else assign_bounded(x[:, p], book, old[:, p], moved[p], b) for p, book in enumerate(books)]
                state = np.stack([s for s, _ in told], axis=1)
                if last:
                    code = [row.tobytes().hex() for row in np.ascontiguousarray(state["own"])]
                    error = np.sum([e for _, e in told], axis=0)
                    yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(code, pa.string()), pa.array(error, pa.int64())], ["row", "code", "error"])
                else:
                    yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pack(state)], ["row", "q", "state"])
    return run


def _sums(parts: int, entries: int, b: int):
    """mapInArrow: (q, state) -> (place, value): what a task adds to each entry's
    count and component sums, and to the numbers of bounds used."""
    def run(batches):
        total = None
        for batch in batches:
            x = _cut(batch.column(0), parts)
            state = fixed_width(batch.column(1), state_type(b).itemsize * parts).reshape(-1).view(state_type(b))
            cell = (np.arange(parts)[None] * entries + state["own"].reshape(len(x), parts)).ravel()
            count = np.bincount(cell, minlength=parts * entries)
            sums = [np.bincount(cell, x[:, :, j].ravel(), parts * entries).astype(np.int64) for j in range(x.shape[2])]
            used = np.bincount(state["used"], minlength=256)
            now = np.concatenate([count, *sums, used])
            total = now if total is None else total + now
        if total is not None:
            place = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(place, pa.int64()), pa.array(total[place], pa.int64())], ["place", "value"])
    return run


@dataclass
class Codes:
    """``rows``: (row, code, error), a struct of the columns kept, two hex digits
    for each part's entry, and the summed squared distances; ``books``: entries by
    part, entry and position; ``bounds``: b after each round."""

    rows: DataFrame
    books: np.ndarray
    bounds: list[int]

    def books_sha256(self) -> str:
        return hashlib.sha256(",".join(map(str, self.books.ravel().tolist())).encode()).hexdigest()


def compress(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE, vec_id: str = "vec_id", vector: str = "embedding", keep: list[str] | None = None) -> Codes:
    """Codes of all usable vectors.

    Left out are vectors that are null, empty, or hold null, non-finite or too
    large components (``integers.whole_numbers``), and those whose dimension is
    not that of the smallest id among the usable ones whose dimension the parts
    divide.  Codebooks start as the parts of the ``entries`` smallest ids (null
    ids last, equal ids by components; fewer vectors, fewer entries).  Rows that
    repeat are coded, and count, each.  An empty table gives no rows and empty
    codebooks.  Other columns pass through in ``row`` if named in ``keep``.
    """
    if entries > 256:
        raise ValueError("a code has two hex digits for each part")
    rows = vectors.select(whole([vec_id] if keep is None else keep), F.col(vec_id).alias("id"), whole_numbers(vector, scale).alias("q"))
    rows = stage(rows.where("q is not null").where(F.size("q") % parts == 0), "vectors")
    in_order = [F.col("id").asc_nulls_last(), F.col("q")]
    first = rows.orderBy(*in_order).select(F.size("q")).first()
    row_type = T.StructField("row", rows.schema["row"].dataType)
    coded = schema(row_type, "code string, error long")
    if first is None:
        return Codes(rows.sparkSession.createDataFrame([], coded), np.zeros((parts, 0, 0), np.int64), [])
    rows = rows.where(F.size("q") == first[0])
    start = np.array([r["q"] for r in rows.orderBy(*in_order).limit(entries).select("q").collect()], np.int64)
    books = start.reshape(len(start), parts, -1).transpose(1, 0, 2).copy()
    k, width = books.shape[1:]
    b = held = max(1, k // 4)
    least, bounds = max(1, k // 8), [b]
    kept, moved = rows.select("row", "q"), None
    for _ in range(rounds):
        kept = stage(kept.mapInArrow(_assign(books, moved, held, b, False), schema(row_type, "q array<bigint>, state binary")), "states")
        held = b
        told = kept.select("q", "state").mapInArrow(_sums(parts, k, held), "place long, value long").groupBy("place").agg(F.sum("value").alias("value")).collect()
        total = np.zeros(parts * k * (1 + width) + 256, np.int64)
        total[[r["place"] for r in told]] = [r["value"] for r in told]
        count = total[:parts * k].reshape(parts, k)
        sums = total[parts * k:parts * k * (1 + width)].reshape(width, parts, k).transpose(1, 2, 0)
        new = np.where(count[:, :, None] > 0, sums // np.maximum(count, 1)[:, :, None], books)
        if moved is not None:  # what would have settled nearly all parts of this round
            used = np.cumsum(total[-256:])
            b = int(min(held, max(least, np.searchsorted(used, SETTLED * used[-1]))))
        bounds.append(b)
        moved = np.sqrt(((new - books) ** 2).sum(2).astype(np.float64)) * (1 + _SLACK)
        books = new
    last = kept.mapInArrow(_assign(books, moved, held, b, True), coded)
    return Codes(last, books, bounds)


#: A table of so many labels is broadcast; a larger one is joined by label and salt.
FEW_LABELS = 10_000
SALTS = 32


def with_group_errors(rows: DataFrame, label: str, error: str = "error") -> DataFrame:
    """Adds ``label_error``: the error summed over rows of an equal label (nulls
    together).  A hot label's rows are dealt over ``SALTS`` keys."""
    rows = stage(rows, "codes")
    sums = stage(rows.groupBy(F.col(label).alias("_label")).agg(F.sum(error).alias("label_error")), "label_errors")
    if sums.count() <= FEW_LABELS:
        return rows.join(F.broadcast(sums), F.col(label).eqNullSafe(F.col("_label"))).drop("_label")
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(*rows.columns), F.lit(SALTS)).cast("int"))
    sums = sums.withColumn("_also", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return salted.join(sums, F.col(label).eqNullSafe(F.col("_label")) & (F.col("_salt") == F.col("_also"))).drop("_label", "_salt", "_also")
