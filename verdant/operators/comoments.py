"""Co-moments of all column pairs: columns become one array,
each task adds its rows up in matrix products, and the tasks' blocks are merged.
A pair counts the rows that have both values, as a pairwise correlation does."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Keys whose blocks a task holds; beyond, it passes on what it has and starts anew.
KEYS = 8


def _blocks(shift: np.ndarray):
    """mapInArrow: (key, v) -> (key, i, sums): for the pairs (i, j >= i) of a key,
    what a task's rows add to n, x_i, x_j, x_i x_j, x_i^2, x_j^2, all about ``shift``."""
    width = len(shift)

    def told(held):
        for key, m in held.items():
            yield pa.RecordBatch.from_arrays([
                pa.array([key] * width, pa.string()), pa.array(range(width), pa.int32()),
                pa.array([m[:, i, i:].ravel() for i in range(width)], pa.list_(pa.float64()))], ["key", "i", "sums"])

    def run(batches):
        held: dict[str | None, np.ndarray] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, width) - shift
            keys, at = np.unique(np.array([str(k) if k is not None else "" for k in batch.column(0).to_pylist()]), return_inverse=True)
            null = np.array(batch.column(0).is_null())
            for k in range(len(keys)):
                for missing in (False, True):
                    rows = x[(at == k) & (null == missing)]
                    if not len(rows):
                        continue
                    there = np.isfinite(rows)
                    z, one = np.where(there, rows, 0.0), there.astype(float)
                    s, q = z.T @ one, (z * z).T @ one
                    name = None if missing else str(keys[k])
                    now = np.stack([one.T @ one, s, s.T, z.T @ z, q, q.T])
                    if name in held:
                        held[name] += now
                    else:
                        if len(held) >= KEYS:
                            yield from told(held)
                            held = {}
                        held[name] = now
        yield from told(held)
    return run


def _merge(width: int):
    """mapInArrow: (key, i, sums) sorted by key and i -> (key, i, j, n, r)."""
    def one(key, i, m):
        n, si, sj, sij, qi, qj = m.reshape(6, -1)
        with np.errstate(divide="ignore", invalid="ignore"):
            cov, vi, vj = sij - si * sj / n, qi - si * si / n, qj - sj * sj / n
            flat = (vi <= 1e-12 * qi) | (vj <= 1e-12 * qj) | (n < 2)  # a constant column has no correlation
            r = np.where(flat, np.nan, np.clip(cov / np.sqrt(vi * vj), -1, 1))
        many = len(n)
        return pa.RecordBatch.from_arrays([
            pa.array([key] * many, pa.string()), pa.array(np.full(many, i, np.int32)), pa.array(np.arange(i, width, dtype=np.int32)),
            pa.array(n.astype(np.int64)), pa.array(r, mask=np.isnan(r))], ["key", "i", "j", "n", "r"])

    def run(batches):
        at, m = None, None
        for batch in batches:
            for key, i, sums in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                x = sums.values.to_numpy()
                if (key, i) == at:
                    m = m + x
                else:
                    if at is not None:
                        yield one(*at, m)
                    at, m = (key, i), x
        if at is not None:
            yield one(*at, m)
    return run


def pair_correlations(df: DataFrame, cols, key: str | None = None) -> DataFrame:
    """(key, i, j, n, r) for all pairs i <= j of the positions of ``cols``: rows with
    both values (finite), and their Pearson correlation (null without variation).
    ``key``, if given, is compared as a string; without one it is null."""
    cols = list(cols)
    v = [F.col(c).cast("double") for c in cols]
    rows = df.select((F.col(key).cast("string") if key else F.lit(None).cast("string")).alias("key"),
                     F.array(*[F.coalesce(x, F.lit(float("nan"))) for x in v]).alias("v"))
    finite = [F.avg(F.when(F.abs(x) < float("inf"), x)) for x in v]  # NaN is greater than all
    shift = np.array([0.0 if m is None else m for m in df.agg(*[f.alias(f"m{i}") for i, f in enumerate(finite)]).first()])
    sums = rows.mapInArrow(_blocks(shift), "key string, i int, sums array<double>")
    return sums.repartition("key", "i").sortWithinPartitions("key", "i").mapInArrow(_merge(len(cols)), "key string, i int, j int, n long, r double")
