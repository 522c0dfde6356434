"""Exact top-k search by a Voronoi join.

Inner products become distances: with every candidate x extended by
sqrt(M^2 - |x|^2), M the largest norm, and every query q by 0, the squared
distance is |q|^2 + M^2 - 2 q.x, so the highest products of a query are its
nearest candidates.  Pivots cut the space into Voronoi cells; candidates and
queries both go to their nearest pivot.

Summaries are then enough for bounds.  Of every cell: how many candidates lie
how far from its pivot.  Of every group of queries: how near and how far its
queries are from each pivot.  By the triangle inequality they bound the k-th
best distance of any query of the group from above, and so tell for each cell
the ring of candidates that a query of the group could still want.  Only these
are replicated to the group, and solved there by exact integer products.

Where bounds can't tell candidates apart (many dimensions, no clusters), more
groups only mean more copies, so cells of queries are merged until all groups
together take no more than ``REPLICAS`` copies of the table, or one group is
left.  Groups are worked on in blocks of bounded size, a task streams a block of
candidates past a block of queries and returns its k best, and a last ranking
joins the blocks.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from verdant.llm.groups import fixed_width
from verdant.llm.integers import lists, pack, small_type, whole_numbers
from verdant.llm.shared import stage

SCALE = 256
#: Pivots grow with the cube root of the candidates up to this many; summaries hold PIVOTS^2 ranges and PIVOTS x RINGS counts.
PIVOTS, RINGS = 128, 64
#: Copies of the table that the groups may take together, while there are several.
REPLICAS = 4.0
#: Queries that a task holds; candidates that it streams: at least so many, and so many for each query it holds.
QUERY_BLOCK, DATA_BLOCK, DATA_PER_QUERY = 65_536, 4_096, 8
#: Queries and candidates of one matrix product.
_QUERIES, _DATA = 1024, 2048
_SLACK = 1e-6


def choose_pivots(rows: DataFrame, n: int) -> dict[int, np.ndarray]:
    """By dimension, the vectors with the least hashes; together as many as suit ``n`` rows."""
    wanted = int(min(PIVOTS, max(8, 4 * round(n ** (1 / 3)))))
    by: dict[int, list] = {}
    for r in rows.select("q").orderBy(F.xxhash64(F.lit("pivot"), F.col("vec_id")), "q").limit(wanted).collect():
        by.setdefault(len(r["q"]), []).append(r["q"])
    return {d: np.unique(np.array(v, np.float64), axis=0) for d, v in by.items()}


def _extended(x: np.ndarray, most: float) -> np.ndarray:
    """Candidates, with the component that makes their norms equal."""
    x = x.astype(np.float64)
    return np.concatenate([x, np.sqrt(np.maximum(most - (x * x).sum(1), 0))[:, None]], axis=1)


def _gaps(x: np.ndarray, points: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((x * x).sum(1)[:, None] + (points * points).sum(1) - 2 * (x @ points.T), 0))


def _points(pivots: dict[int, np.ndarray], d: int, most: float) -> np.ndarray:
    """Pivots of a dimension; the origin alone where none was chosen."""
    return _extended(pivots.get(d, np.zeros((1, d))), most)


def _place(pivots: dict[int, np.ndarray], most: float, kind: np.dtype):
    """mapInArrow: (at, vec_id, wanted, q) -> (at, vec_id, dim, cell, far, home, v): a
    candidate's cell and distance to its pivot, a query's own cell (else null), the packed vector."""
    def run(batches):
        for whole_batch in batches:
            for lo in range(0, whole_batch.num_rows, _DATA):
                batch = whole_batch.slice(lo, _DATA)
                size = np.array([len(x) for x in batch.column(3)])
                for d in np.unique(size):
                    some = np.flatnonzero(size == d)
                    part = batch.take(pa.array(some))
                    x, points = lists(part.column(3)), _points(pivots, int(d), most)
                    far = _gaps(_extended(x, most), points)
                    wanted = part.column(2).to_numpy(zero_copy_only=False)
                    home = _gaps(np.concatenate([x.astype(np.float64), np.zeros((len(x), 1))], axis=1), points).argmin(1)
                    cell = far.argmin(1)
                    yield pa.RecordBatch.from_arrays([
                        part.column(0), part.column(1), pa.array(np.full(len(x), d, np.int32)), pa.array(cell.astype(np.int32)), pa.array(far[np.arange(len(x)), cell]),
                        pa.array(home.astype(np.int32), mask=~wanted), pack(x.astype(kind))], ["at", "vec_id", "dim", "cell", "far", "home", "v"])
    return run


def _ranges(pivots: dict[int, np.ndarray], most: float, kind: np.dtype):
    """mapInArrow: (dim, home, v) of queries -> (dim, home, cell, lo, hi): distances of a task's queries to every pivot."""
    def run(batches):
        held: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            dim, home = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for d in np.unique(dim):
                some = np.flatnonzero(dim == d)
                x = fixed_width(batch.column(2).take(pa.array(some)), int(d) * kind.itemsize).view(kind).astype(np.float64)
                gap = _gaps(np.concatenate([x, np.zeros((len(x), 1))], axis=1), _points(pivots, int(d), most))
                for h in np.unique(home[some]):
                    mine = gap[home[some] == h]
                    lo, hi = held.get((int(d), int(h)), (np.inf, -np.inf))
                    held[int(d), int(h)] = np.minimum(lo, mine.min(0)), np.maximum(hi, mine.max(0))
        for (d, h), (lo, hi) in held.items():
            n = len(lo)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(n, d, np.int32)), pa.array(np.full(n, h, np.int32)), pa.array(np.arange(n, dtype=np.int32)), pa.array(lo), pa.array(hi)], ["dim", "home", "cell", "lo", "hi"])
    return run


def bound(counts: np.ndarray, width: float, lo: np.ndarray, hi: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of groups whose queries are ``lo..hi`` from each pivot, with ``counts`` of
    candidates by cell and ring: per group and cell the ring that must be
    replicated (``low``, ``high``), and the candidates replicated at most, by group."""
    rings = counts.shape[1]
    edge = (np.arange(rings) + 1) * width
    upper = (hi[:, :, None] + edge).reshape(len(hi), -1)
    order = np.argsort(upper, axis=1, kind="stable")
    have = np.cumsum(counts.ravel()[order], axis=1)
    enough = have >= k + 1  # a query may itself be one of the candidates
    at = np.where(enough.any(1), enough.argmax(1), 0)
    limit = np.where(enough.any(1), np.take_along_axis(upper, np.take_along_axis(order, at[:, None], 1), 1)[:, 0], np.inf)[:, None]
    low, high = np.maximum(lo - limit - _SLACK * edge[-1], 0), hi + limit + _SLACK * edge[-1]
    so_far = np.concatenate([np.zeros((len(counts), 1), np.int64), np.cumsum(counts, axis=1)], axis=1)
    cell = np.arange(len(counts))[None]
    first = np.clip(np.floor(low / width), 0, rings).astype(np.int64)
    last = np.clip(np.floor(np.minimum(high, edge[-1]) / width) + 1, 0, rings).astype(np.int64)
    return low, high, np.maximum(so_far[cell, last] - so_far[cell, first], 0).sum(1)


def merge(points: np.ndarray, homes: np.ndarray, groups: int) -> np.ndarray:
    """Groups of query cells: each goes to the nearest of the first ``groups`` of them."""
    return _gaps(points[homes], points[homes[:groups]]).argmin(1)


def plan(points: np.ndarray, counts: np.ndarray, width: float, ranges: dict[int, tuple[np.ndarray, np.ndarray]], k: int, replicas: float):
    """Group of each home cell, and the rings and replicas of each group: the
    finest merging whose groups take ``replicas`` candidates together, or one group."""
    homes = np.array(sorted(ranges))
    groups = len(homes)
    while True:
        of = merge(points, homes, groups)
        lo = np.stack([np.min([ranges[h][0] for h in homes[of == g]], axis=0) for g in range(groups)])
        hi = np.stack([np.max([ranges[h][1] for h in homes[of == g]], axis=0) for g in range(groups)])
        low, high, copies = bound(counts, width, lo, hi, k)
        if groups == 1 or copies.sum() <= replicas:
            return dict(zip(homes.tolist(), of.tolist(), strict=True)), low, high, copies
        groups = max(1, groups * 3 // 4)


def _best(rows: np.ndarray, score: np.ndarray, ids: np.ndarray, k: int):
    order = np.lexsort((ids, -score, rows))
    rows, score, ids = rows[order], score[order], ids[order]
    start = np.flatnonzero(np.append(True, rows[1:] != rows[:-1])) if len(rows) else np.zeros(0, np.int64)
    place = np.arange(len(rows)) - np.repeat(start, np.diff(np.append(start, len(rows))))
    top = place < k
    return rows[top], score[top], ids[top]


def _solve(k: int, kind: np.dtype, exact_in_double: bool):
    """mapInArrow: (unit, kind, dim, at, vec_id, v), a unit's queries before its candidates -> (at, query_id, vec_id, score)."""
    number = np.float64 if exact_in_double else np.int64

    def told(queries, found):
        for (at, ids, _), (rows, score, other) in zip(queries, found, strict=True):
            yield pa.RecordBatch.from_arrays([pa.array(at[rows]), pa.array(ids[rows]), pa.array(other), pa.array(score.astype(np.int64))], ["at", "query_id", "vec_id", "score"])

    def against(block, found, ids, x):
        _, own, q = block
        score = q @ x.T
        few = min(k, len(ids))
        theirs = own[:, None] == ids[None]
        least = np.iinfo(np.int64).min if number is np.int64 else -np.inf
        if theirs.any():
            score[theirs] = least
        cut = np.partition(score, len(ids) - few, axis=1)[:, len(ids) - few]
        have = np.bincount(found[0], minlength=len(own))
        full = np.flatnonzero(have == k)
        if len(full):  # rows of ``found`` are in order of query and score
            last = np.cumsum(have)[full] - 1
            cut[full] = np.maximum(cut[full], found[1][last])
        r, c = np.nonzero((score >= cut[:, None]) & ~theirs)
        return _best(np.concatenate([found[0], r]), np.concatenate([found[1], score[r, c]]), np.concatenate([found[2], ids[c]]), k)

    def run(batches):
        unit, queries, found = None, [], []
        for batch in batches:
            units, sides = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            edges = np.flatnonzero((units[1:] != units[:-1]) | (sides[1:] != sides[:-1])) + 1
            for lo, hi in zip([0, *edges.tolist()], [*edges.tolist(), len(units)], strict=True):
                if hi == lo:
                    continue
                if units[lo] != unit:
                    yield from told(queries, found)
                    unit, queries, found = units[lo], [], []
                wide = batch.column(2)[lo].as_py() * kind.itemsize
                for at in range(lo, hi, _QUERIES if sides[lo] == 0 else _DATA):
                    part = batch.slice(at, min(hi - at, _QUERIES if sides[lo] == 0 else _DATA))
                    x = fixed_width(part.column(5), wide).view(kind).astype(number)
                    ids = part.column(4).to_numpy()
                    if sides[lo] == 0:
                        queries.append((part.column(3).to_numpy(), ids, x))
                        found.append((np.zeros(0, np.int64), np.zeros(0, number), np.zeros(0, np.int64)))
                    else:
                        found = [against(block, have, ids, x) for block, have in zip(queries, found, strict=True)]
        yield from told(queries, found)
    return run


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, scale: int = SCALE, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """The ``k`` highest inner products of each query among all other rows.

    Components become ``floor(scale * x)``; products are whole.  Returns
    ``query_id``, ``rank`` (from 1), ``vec_id``, ``score``; ties go to the smaller
    id, and a query with fewer candidates has them all.  A query's candidates are
    the usable rows of its dimension with another id, so rows that share its id
    are not among them.  Rows that repeat are candidates each, and queries each.
    Vectors that are null, empty, or hold null, non-finite or too large components
    (``integers.whole_numbers``), and rows with a null id, take no part.  Other
    columns are not read.
    """
    spark = vectors.sparkSession
    out = "query_id long, rank int, vec_id long, score long"
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.coalesce(is_query, F.lit(False)).alias("wanted"), whole_numbers(vector, scale).alias("q"))
    rows = stage(rows.where("q is not null and vec_id is not null"), "vectors").withColumn("at", F.monotonically_increasing_id())
    squares = F.aggregate("q", F.lit(0).cast("bigint"), lambda a, x: a + x * x)
    largest = F.greatest(F.array_max("q"), -F.array_min("q"))
    n, most, top = rows.agg(F.count("*"), F.max(squares), F.max(largest)).first()
    if not n:
        return spark.createDataFrame([], out)
    pivots, kind, most = choose_pivots(rows, n), small_type(int(top)), float(most) * (1 + 1e-12)
    cells = stage(rows.select("at", "vec_id", "wanted", "q").mapInArrow(_place(pivots, most, kind), "at long, vec_id long, dim int, cell int, far double, home int, v binary"), "cells")
    width = 2.0 * float(np.sqrt(most)) / RINGS * (1 + 1e-9) or 1.0  # extended vectors all have one norm, so no two are farther apart than twice that
    asked = cells.where("home is not null")
    known = cells.groupBy("dim", "cell", F.floor(F.col("far") / width).cast("int").alias("ring")).count().collect()
    told = asked.select("dim", "home", "v").mapInArrow(_ranges(pivots, most, kind), "dim int, home int, cell int, lo double, hi double").groupBy("dim", "home", "cell").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).collect()
    per_home = {(r["dim"], r["home"]): r["count"] for r in asked.groupBy("dim", "home").count().collect()}
    if not per_home:
        return spark.createDataFrame([], out)
    rings, homes, first_unit, group = [], [], 0, 0
    for d in sorted({d for d, _ in per_home}):
        points = _points(pivots, d, most)
        counts = np.zeros((len(points), RINGS), np.int64)
        for r in known:
            if r["dim"] == d:
                counts[r["cell"], min(r["ring"], RINGS - 1)] += r["count"]
        ranges: dict[int, tuple[np.ndarray, np.ndarray]] = {h: (np.zeros(len(points)), np.zeros(len(points))) for e, h in per_home if e == d}
        for r in told:
            if r["dim"] == d:
                ranges[r["home"]][0][r["cell"]], ranges[r["home"]][1][r["cell"]] = r["lo"], r["hi"]
        of, low, high, copies = plan(points, counts, width, ranges, k, REPLICAS * counts.sum())
        for g in range(len(low)):
            own = sum(per_home[d, h] for h, x in of.items() if x == g)
            if not own:
                continue
            sides = -(-own // QUERY_BLOCK)
            blocks = max(1, -(-int(copies[g]) // max(DATA_BLOCK, DATA_PER_QUERY * -(-own // sides))))
            rings += [(d, c, float(low[g, c]), float(high[g, c]), group, first_unit, int(blocks), int(sides)) for c in np.flatnonzero(counts.sum(1)).tolist() if low[g, c] <= high[g, c]]
            homes += [(d, h, first_unit, int(blocks), int(sides)) for h, x in of.items() if x == g]
            first_unit += blocks * sides
            group += 1
    ring_table = spark.createDataFrame(rings, "dim int, cell int, low double, high double, `group` int, first long, blocks int, sides int")
    home_table = spark.createDataFrame(homes, "dim int, home int, first long, blocks int, sides int")
    dealt = lambda salt, over: F.pmod(F.xxhash64(F.lit(salt), F.col("at")), F.col(over)).cast("int")
    every = lambda of: F.explode(F.sequence(F.lit(0), F.col(of) - 1))
    unit = (F.col("first") + F.col("block") * F.col("sides") + F.col("side")).alias("unit")
    data = cells.join(F.broadcast(ring_table), ["dim", "cell"]).where("far between low and high").withColumn("block", dealt("data", "blocks")).withColumn("side", every("sides"))
    queries = asked.join(F.broadcast(home_table), ["dim", "home"]).withColumn("side", dealt("queries", "sides")).withColumn("block", every("blocks"))
    units = queries.select(unit, F.lit(0).alias("kind"), "dim", "at", "vec_id", "v").unionByName(data.select(unit, F.lit(1).alias("kind"), "dim", "at", "vec_id", "v"))
    number = float(top) ** 2 * max(d for d, _ in per_home) < 2.0 ** 53
    solved = units.repartition("unit").sortWithinPartitions("unit", "kind").mapInArrow(_solve(k, kind, number), "at long, query_id long, vec_id long, score long")
    from_best = F.row_number().over(Window.partitionBy("at").orderBy(F.desc("score"), "vec_id"))
    return solved.withColumn("rank", from_best).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
