"""Near-duplicate vectors by a pivot-permutation index.

Each vector is described by the order of its nearest reference points (pivots).
Inverted lists hold, for every three pivots, the vectors that have all three
among their nearest: two vectors meet in as many lists as they share such
triples, and at all if their shared-pivot count is three or more.  Vectors that
meet are verified by their cosine in double precision.  Links are then counted
within each component, block by block.

Equal vectors count as one from the start.  Lists and components of any size are
worked on in blocks, and tasks return spanning forests and counts, never all
pairs.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verdant.llm.groups import dealt_in_blocks, together, whole_groups
from verdant.llm.shared import components, find_roots, stage

#: Nearest pivots that describe a vector, and pivots that two vectors must share.
NEAREST, SHARED = 8, 3
#: Pivots grow with the cube root of the vectors, so that a list's length hardly does, up to this many.
PIVOTS = 2048
BLOCK = 1024


def valid(vector: str) -> Column:
    """Whether a vector has components, all of them finite, and not all of them zero."""
    v = F.col(vector)
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce((F.size(v) > 0) & ~bad & F.exists(v, lambda x: x != 0), F.lit(False))


def matrix(column: pa.Array) -> np.ndarray:
    """Unit vectors, in double precision, of a list column of one dimension."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    x = flat.reshape(len(column), -1)
    x = x / np.abs(x).max(1, keepdims=True)  # no overflow in the squares
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def by_dimension(column: pa.Array):
    """Rows of each dimension and their unit vectors."""
    size = np.diff(np.append(column.offsets.to_numpy(), [])) if len(column) else np.zeros(0, np.int64)
    for d in np.unique(size):
        rows = np.flatnonzero(size == d)
        yield int(d), rows, matrix(column.take(pa.array(rows)))


def _permutations(pivots: dict[int, np.ndarray], shared: int):
    """mapInArrow: (c, v) -> (list, c): the lists of a vector's nearest pivots."""
    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 1024):
                part = batch.slice(lo, 1024)
                for d, rows, unit in by_dimension(part.column(1)):
                    points = pivots.get(d)
                    c = part.column(0).take(pa.array(rows))
                    if points is None:  # too rare a dimension for a pivot: one list
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(rows), -d, np.int64)), c], ["list", "c"])
                        continue
                    k = min(NEAREST, len(points))
                    order = np.argsort(-(unit @ points.T), axis=1, kind="stable")[:, :k]
                    near = np.sort(order, axis=1)
                    for some in combinations(range(k), min(shared, k)):
                        name = np.full(len(rows), d, np.int64)
                        for j in some:
                            name = name * (PIVOTS + 1) + near[:, j]
                        yield pa.RecordBatch.from_arrays([pa.array(name), c], ["list", "c"])
    return run


def _linked(unit: np.ndarray, cosine: float) -> np.ndarray:
    return unit @ unit.T >= cosine


def _forests(cosine: float):
    """mapInArrow: (g, c, v) by list -> a spanning forest of the verified links."""
    def run(batches):
        for batch, bounds in whole_groups(batches):
            for_u, for_v = [], []
            ids = batch.column(1).to_numpy()
            lonely = np.diff(bounds) < 2
            for lo, hi in zip(bounds[:-1][~lonely].tolist(), bounds[1:][~lonely].tolist(), strict=True):
                for _, rows, unit in by_dimension(batch.column(2).slice(lo, hi - lo)):
                    own = ids[lo + rows]
                    u, v = np.nonzero(np.triu(_linked(unit, cosine), 1))
                    root = find_roots(len(rows), u, v)
                    joined = np.flatnonzero(root != np.arange(len(rows)))
                    for_u.append(own[joined])
                    for_v.append(own[root[joined]])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x) if x else np.zeros(0, np.int64), pa.int64()) for x in (for_u, for_v)], ["u", "v"])
    return run


def _counts(cosine: float):
    """mapInArrow: (g, block, c, times, v) by component -> (c, links) of the group's pairs."""
    def run(batches):
        for batch, bounds in whole_groups(batches):
            block, ids, times = (batch.column(k).to_numpy() for k in (1, 2, 3))
            found = np.zeros(batch.num_rows, np.int64)
            for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                for _, rows, unit in by_dimension(batch.column(4).slice(lo, hi - lo)):
                    at = lo + rows
                    first = block[at] == block[lo:hi].min()
                    if (block[lo:hi] == block[lo]).all():
                        link = _linked(unit, cosine)
                        np.fill_diagonal(link, False)
                        found[at] = link @ times[at]
                    else:
                        link = unit[first] @ unit[~first].T >= cosine
                        found[at[first]] = link @ times[at[~first]]
                        found[at[~first]] = link.T @ times[at[first]]
            some = np.flatnonzero(found)
            yield pa.RecordBatch.from_arrays([pa.array(ids[some]), pa.array(found[some])], ["c", "links"])
    return run


def choose_pivots(classes: DataFrame, n: int) -> dict[int, np.ndarray]:
    """Reference points by dimension: the vectors with the least hashes, as many
    as suit ``n`` vectors, PIVOTS at most."""
    wanted = int(min(PIVOTS, max(64, 6 * round(n ** (1 / 3)))))
    rows = classes.orderBy(F.xxhash64(F.lit("pivot"), F.col("c")), "c").limit(wanted).select("v").collect()
    by: dict[int, list] = {}
    for r in rows:
        by.setdefault(len(r["v"]), []).append(r["v"])
    out = {}
    for d, vectors in by.items():
        if len(vectors) >= SHARED:
            flat = pa.array([x for v in vectors for x in v], pa.float64())
            out[d] = matrix(pa.FixedSizeListArray.from_arrays(flat, d))
    return out


def near_duplicates(vectors: DataFrame, cosine: float = 0.95, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """Links of vectors with cosine >= ``cosine`` and the classes they form.

    Returns per row: ``vec_id``, ``n_links`` (other rows linked directly),
    ``component_id`` (smallest id reachable), ``kept`` (id = component_id).
    Vectors that are null, empty, zero or hold null or non-finite components link
    with nothing, nor do vectors of different dimensions with each other.  Rows
    that share an id count as one vertex; a row with a null id links with
    nothing, has a null component and is kept.  Other columns are not read.
    """
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("v"))
    rows = rows.withColumn("usable", valid("v") & F.col("vec_id").isNotNull()).withColumn("v", F.when(F.col("usable"), F.col("v")))
    classes = stage(rows.where("usable").groupBy("v").agg(F.min("vec_id").alias("c"), F.count("*").alias("times")), "classes")
    pivots = choose_pivots(classes, classes.count())
    lists = stage(classes.select("c", "v").mapInArrow(_permutations(pivots, SHARED), "list long, c long"), "lists")
    crowds = lists.groupBy("list").agg(F.count("*").alias("members")).where("members > 1")
    met = dealt_in_blocks(lists.join(crowds, "list"), ["list"], "c", "members", BLOCK).select("g", "c").join(classes.select("c", "v"), "c").select("g", "c", "v")
    joined = stage(components(together(met).mapInArrow(_forests(cosine), "u long, v long")).withColumnRenamed("u", "id").withColumnRenamed("c", "component"), "components")
    sizes = joined.groupBy("component").agg(F.count("*").alias("members"))
    held = classes.join(joined, F.col("c") == F.col("id")).join(sizes, "component")
    dealt = dealt_in_blocks(held, ["component"], "c", "members", BLOCK, once=True).select("g", "block", "c", "times", "v")
    links = together(dealt).mapInArrow(_counts(cosine), "c long, links long").groupBy("c").agg(F.sum("links").alias("links"))
    told = classes.join(links, "c", "left").join(joined.withColumnRenamed("id", "c"), "c", "left").select("v", "c", "times", "links", "component")
    return rows.join(told, "v", "left").select(
        "vec_id", F.when(F.col("usable"), F.col("times") - 1 + F.coalesce("links", F.lit(0))).otherwise(F.lit(0)).cast("long").alias("n_links"),
        F.when(F.col("usable"), F.coalesce("component", "c")).otherwise(F.col("vec_id")).alias("component_id"),
    ).withColumn("kept", F.col("vec_id").isNull() | (F.col("vec_id") == F.col("component_id")))
