"""Isolation forest shared by all series.

Values are standardised within their series.  Trees grow on 256 values each,
drawn from a pool of at most ``POOL`` rows that a hash of (key, date, measure)
chooses over all series; so fitting sees a bounded sample however large the
table.  With one feature a tree is a step function of the value, and so is the
mean path over all trees: the forest becomes a table of a few ten thousand steps,
which is broadcast and joined on a grid cell.  Scoring every row is then an
equality join and a comparison, without Python.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verdant.functions import semantics as S
from verdant.functions.semantics import KEY, TS

#: Trees, values that a tree grows on, and rows that the values are drawn from.
TREES, SAMPLE, POOL = 100, 256, 16_384
#: Series with fewer values get no score (fixed value of the reference).
LEAST = 10
#: Grid cells for each standard deviation, and cells on either side of zero; the outermost are open.
GRID, REACH = 128, 1024
_DRAWN = 1 << 30


def mean_path(n: int) -> float:
    """Mean path length of an unsuccessful search among ``n`` values: what stands for a leaf's own subtree."""
    return 0.0 if n <= 1 else 2.0 * (np.log(n - 1) + 0.5772156649) - 2.0 * (n - 1) / n


@dataclass
class Tree:
    """Nodes in arrays: ``left`` of a leaf is -1, ``path`` is the length down to it and its mean path."""

    split: np.ndarray
    left: np.ndarray
    right: np.ndarray
    path: np.ndarray

    def walk(self, x: float) -> float:
        node = 0
        while self.left[node] >= 0:
            node = self.left[node] if x < self.split[node] else self.right[node]
        return float(self.path[node])

    def steps(self) -> tuple[np.ndarray, np.ndarray]:
        """Splits in order, and the path on each interval between them."""
        edges, paths, waiting = [], [], [(0, False)]
        while waiting:
            node, passed = waiting.pop()
            if self.left[node] < 0:
                paths.append(self.path[node])
            elif passed:
                edges.append(self.split[node])
            else:
                waiting += [(self.right[node], False), (node, True), (self.left[node], False)]
        return np.array(edges), np.array(paths)


def grow(sample: np.ndarray, rng: np.random.Generator) -> Tree:
    """A tree of uniform splits, as deep as the logarithm of its sample."""
    limit = int(np.ceil(np.log2(max(len(sample), 2))))
    split, left, right, path = [0.0], [-1], [-1], [0.0]
    waiting = [(0, np.sort(sample), 0)]
    while waiting:
        node, values, depth = waiting.pop()
        if depth >= limit or len(values) <= 1 or values[0] == values[-1]:
            path[node] = depth + mean_path(len(values))
            continue
        at = rng.uniform(values[0], values[-1])
        cut = int(np.searchsorted(values, at, "left"))
        split[node], left[node], right[node] = at, len(split), len(split) + 1
        for part in (values[:cut], values[cut:]):
            waiting.append((len(split), part, depth + 1))
            split.append(0.0), left.append(-1), right.append(-1), path.append(0.0)
    return Tree(*(np.array(x) for x in (split, left, right, path)))


@dataclass
class Forest:
    trees: list[Tree]
    sample: int

    def score(self, x: float) -> float:
        """Anomaly score by walking every tree."""
        return float(2.0 ** (-np.mean([t.walk(x) for t in self.trees]) / (mean_path(self.sample) or 1.0)))

    def table(self) -> pd.DataFrame:
        """Steps of the score, by grid cell: cell, lo, hi, score."""
        each = [t.steps() for t in self.trees]
        edges = np.unique(np.concatenate([e for e, _ in each]))
        starts = np.concatenate([[-np.inf], edges])
        total = sum(p[np.searchsorted(e, starts, "right")] for e, p in each)
        score = 2.0 ** (-(total / len(each)) / (mean_path(self.sample) or 1.0))
        first = np.clip(np.floor(starts * GRID), -REACH, REACH - 1).astype(np.int64)
        last = np.append(np.clip(np.floor(edges * GRID), -REACH, REACH - 1).astype(np.int64), REACH - 1)
        many = last - first + 1
        row = np.repeat(np.arange(len(starts)), many)
        cell = np.repeat(first, many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        return pd.DataFrame({"cell": cell, "lo": starts[row], "hi": np.append(edges, np.inf)[row], "score": score[row]})


def _standardised(df: DataFrame, cols, key) -> DataFrame:
    """Adds ``__z{i}`` (value by its series' mean and deviation; a constant series has zeros) and ``__n{i}`` (values of the series)."""
    w = S.whole(key)
    made = {}
    for i, c in enumerate(cols):
        x = F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double"))
        made[f"__z{i}"] = F.when(x.isNotNull(), F.coalesce(F.try_divide(x - F.avg(x).over(w), F.stddev_pop(x).over(w)), F.lit(0.0)))
        made[f"__n{i}"] = F.count(x).over(w)
    return df.withColumns(made)


def fit(df: DataFrame, cols, trees: int = TREES, sample: int = SAMPLE, seed: int = 42, *, key=KEY, ts=TS) -> dict[str, Forest]:
    """A forest for each column that has values."""
    cols = list(cols)
    z = _standardised(df.select(key, ts, *cols), cols, key)
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("measure"), F.col(f"__z{i}").alias("z"), F.col(f"__n{i}").alias("n")) for i, c in enumerate(cols)]))
    rows = z.select(F.col(key).cast("string").alias("k"), F.col(ts).cast("string").alias("t"), each.alias("x")).select("k", "t", "x.*").where(f"z is not null and n >= {LEAST}")
    draw = F.xxhash64(F.lit(seed), "measure", "k", "t")
    rows = rows.select("measure", "z", draw.alias("draw"))
    counts = {r["measure"]: r["count"] for r in rows.groupBy("measure").count().collect()}
    if not counts:
        return {}
    # about four times the pool passes, so that what is ranked stays bounded too
    share = F.coalesce(*[F.when(F.col("measure") == c, F.lit(min(_DRAWN, int(4 * POOL / n * _DRAWN) + 1))) for c, n in counts.items()])
    some = rows.where(F.pmod("draw", F.lit(_DRAWN)) < share)
    pool = some.withColumn("rank", F.row_number().over(S.Window.partitionBy("measure").orderBy("draw", "z"))).where(F.col("rank") <= POOL)
    values: dict[str, list] = {}
    for r in pool.select("measure", "rank", "z").collect():
        values.setdefault(r["measure"], []).append((r["rank"], r["z"]))
    out = {}
    for c in sorted(values):
        x = np.array([v for _, v in sorted(values[c])])
        rng = np.random.default_rng([seed, cols.index(c)])
        n = min(sample, len(x))
        out[c] = Forest([grow(x[rng.choice(len(x), n, replace=False)], rng) for _ in range(trees)], n)
    return out


def isolation_scores(df: DataFrame, forests: dict[str, Forest], cols, *, key=KEY) -> DataFrame:
    """Adds ``{c}_isolation`` (score; null without a value, or in a series of fewer
    than ``LEAST``) and ``{c}_isolation_status`` (scored, short, empty)."""
    spark, cols = df.sparkSession, list(cols)
    d = _standardised(df, cols, key)
    for i, c in enumerate(cols):
        if c in forests:
            steps = spark.createDataFrame(forests[c].table()).toDF(f"__cell{i}", f"__lo{i}", f"__hi{i}", f"__score{i}")
            z = F.col(f"__z{i}")
            d = d.withColumn("__at", F.greatest(F.least(F.floor(z * GRID), F.lit(REACH - 1)), F.lit(-REACH)).cast("long"))
            d = d.join(F.broadcast(steps), (F.col("__at") == F.col(f"__cell{i}")) & (z >= F.col(f"__lo{i}")) & (z < F.col(f"__hi{i}")), "left")
            d = d.withColumn(f"{c}_isolation", F.when(z.isNotNull() & (F.col(f"__n{i}") >= LEAST), F.col(f"__score{i}"))).drop("__at", f"__cell{i}", f"__lo{i}", f"__hi{i}", f"__score{i}")
        else:
            d = d.withColumn(f"{c}_isolation", F.lit(None).cast("double"))
        d = d.withColumn(f"{c}_isolation_status", F.when(F.col(f"__n{i}") >= LEAST, "scored").when(F.col(f"__n{i}") > 0, "short").otherwise("empty"))
    return d.drop(*[f"__{x}{i}" for x in "zn" for i in range(len(cols))])


def isolation_anomalies(df: DataFrame, cols, contamination: float = 0.1, forests: dict[str, Forest] | None = None, *, key=KEY, ts=TS) -> DataFrame:
    """W18 adds ``{c}_anomaly``: 1 for the ``contamination`` share of a series'
    most isolated values.  Rows without a value and series with fewer than
    ``LEAST`` values get 0; ``{c}_isolation_status`` tells why."""
    cols = [c for c in cols if c in df.columns]
    forests = fit(df, cols, key=key, ts=ts) if forests is None else forests
    d = isolation_scores(df, forests, cols, key=key)
    w = S.whole(key)
    return d.withColumns({f"{c}_anomaly": S.flag(F.col(f"{c}_isolation") > F.percentile(f"{c}_isolation", 1 - contamination).over(w)) for c in cols})
