"""Tables that cut lineage, row keys and connected components for the operators."""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from verdant.session import ensure_checkpoint_dir


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to a fresh table in the shared checkpoint folder and read it
    back: lost executors then cost a re-read, not a re-run of what made it."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/llm-{uuid.uuid4().hex}/{name}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def row_key(doc_id: str = "doc_id", text: str = "text") -> Column:
    """Names a row for joins: its id with a hash of its text.  Rows that agree
    in both are copies, for which every operator gives the same answer."""
    return F.struct(F.col(doc_id).cast("string").alias("id"), F.xxhash64(F.col(text)).alias("h"))


#: Rows that a Python task gets at a time: texts may be long, and the default of 10,000 rows is too many.
BATCH_ROWS = 1000


def small_batches(df: DataFrame) -> DataFrame:
    """``df``, in a session that hands rows to Python BATCH_ROWS at a time at most."""
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(name)) <= BATCH_ROWS:
        conf.set(name, str(BATCH_ROWS))
    return df


def schema(first: T.StructField, rest: str) -> T.StructType:
    """A field and the fields of a DDL string."""
    return T.StructType([first, *T.StructType.fromDDL(rest).fields])


def whole(columns: list[str]) -> Column:
    """The named columns as one struct, so that no other column's name can clash with theirs."""
    return F.struct(*(F.col(f"`{c}`") for c in columns)).alias("row")


#: 64-bit words of a sieve: its size is fixed, so that it can be broadcast whatever it holds.
SIEVE_WORDS = 1 << 18


def sieved(rows: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """``rows`` with ``_maybe``: false only if ``key`` is in no row of ``wanted`` (its only column).

    Keeps most rows that a join would drop out of its shuffle.  ``wanted`` is
    hashed into a bit table of SIEVE_WORDS rows at most; when it outgrows that,
    more rows pass, and the join after it still decides."""
    def place(column: str) -> list[Column]:
        h = F.xxhash64(F.lit("sieve"), F.col(column))
        return [h.bitwiseAND(SIEVE_WORDS - 1).alias("_word"), F.shiftright(h, 40).bitwiseAND(63).cast("int").alias("_bit")]

    bits = wanted.select(*place(wanted.columns[0])).groupBy("_word").agg(F.bit_or(F.expr("shiftleft(1L, _bit)")).alias("_bits"))
    told = rows.select("*", *place(key)).join(F.broadcast(bits), "_word", "left")
    return told.withColumn("_maybe", F.coalesce(F.expr("(_bits & shiftleft(1L, _bit)) <> 0"), F.lit(False))).drop("_word", "_bit", "_bits")


def _forest(batches):
    """Edges of a spanning forest of a partition's edges (union-find), so that a
    dense group leaves one edge per vertex."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (p := parent.setdefault(x, x)) != x:
            parent[x] = p = parent[p]
            x = p
        return x

    for b in batches:
        src, dst = [], []
        for u, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            a, c = root(u), root(v)
            if a != c:
                parent[max(a, c)] = min(a, c)
                src.append(max(u, v))
                dst.append(min(u, v))
        yield pa.RecordBatch.from_pydict({"u": pa.array(src, pa.int64()), "v": pa.array(dst, pa.int64())})


#: Forests of at most so many edges (a few MB) are labelled by one task; larger ones by rounds of joins.
FEW_EDGES = 200_000


def _label(batches):
    """Components of a whole forest (union-find)."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (p := parent.setdefault(x, x)) != x:
            parent[x] = p = parent[p]
            x = p
        return x

    for b in batches:
        for u, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            a, c = root(u), root(v)
            parent[max(a, c)] = min(a, c)
    every = list(parent)
    yield pa.RecordBatch.from_pydict({"u": pa.array(every, pa.int64()), "c": pa.array([root(x) for x in every], pa.int64())})


def components(links: DataFrame) -> DataFrame:
    """Connected components of ``links(u, v)`` (longs): rows ``(u, c)`` with c the
    smallest vertex reachable, for every vertex of a link.

    Each partition's edges shrink to a forest first.  A forest of FEW_EDGES is
    then labelled by one task.  A larger one goes through alternating large-star
    and small-star steps over joins, to the same result: neighbour lists are never
    gathered, hubs are split by the skew-join rule, and every round is written to
    the shared folder.  Ends when a round changes nothing.
    """
    edges = stage(links.select(F.col("u").cast("long"), F.col("v").cast("long")).where("u <> v").mapInArrow(_forest, "u long, v long"), "edges")
    if edges.count() <= FEW_EDGES:
        return edges.coalesce(1).mapInArrow(_label, "u long, c long")
    seen = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").where("u <> v").distinct()
        edges = stage(small, "round")
        now = edges.agg(F.count("*"), F.sum(F.hash("u", "v").cast("long")), F.max(F.struct("u", "v"))).first()
        if now == seen:
            return edges.groupBy("u").agg(F.min("v").alias("c")).unionByName(edges.select(F.col("v").alias("u"), F.col("v").alias("c")).distinct())
        seen = now


def find_roots(n: int, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Component root of each of n local vertices (vectorised label passing)."""
    root = np.arange(n)
    while len(u):
        low = np.minimum(root[u], root[v])
        before = root.copy()
        np.minimum.at(root, root[u], low)
        np.minimum.at(root, root[v], low)
        root = root[root]
        if (root == before).all():
            return root
    return root
