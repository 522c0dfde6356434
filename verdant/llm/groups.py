"""Rows of a key brought together in tasks, in blocks of bounded size."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dealt_in_blocks(df: DataFrame, key: list[str], member: str, count: str, block: int, once: bool = False) -> DataFrame:
    """Adds ``g``: rows of one ``g`` are to be compared with each other.

    A key with at most ``block`` rows is one group.  A larger key is split into
    blocks by a hash of ``member``, and each pair of blocks is a group, so that
    any two rows of the key meet in some task and no task gets more than about
    two blocks.  (Groups are named by a hash; should two names agree, some rows
    are compared without need.)

    With ``once``, each pair of rows has exactly one place: a block is also a
    group of its own, and in a group of two blocks, told apart by the column
    ``block``, only pairs across them count.
    """
    blocks = F.ceil(F.col(count) / F.lit(float(block))).cast("int")
    own = F.pmod(F.xxhash64(member, F.lit(17)), F.col("_blocks")).cast("int")
    name = [*(F.col(k) for k in key), F.least("_own", "_other"), F.greatest("_own", "_other")]
    return (df.withColumn("_blocks", blocks).withColumn("_own", own)
            .withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1) if once else other_blocks()))
            .withColumn("g", F.xxhash64(*name)).withColumn("block", F.col("_own")).drop("_blocks", "_own", "_other"))


def other_blocks() -> Column:
    """The blocks to meet: all others where there are several, else the only one."""
    every = F.sequence(F.lit(0), F.col("_blocks") - 1)
    return F.when(F.col("_blocks") > 1, F.filter(every, lambda b: b != F.col("_own"))).otherwise(F.array(F.lit(0)))


def together(df: DataFrame, n: int | None = None) -> DataFrame:
    """Each ``g`` whole and consecutive in one partition."""
    return (df.repartition(n, "g") if n else df.repartition("g")).sortWithinPartitions("g")


def whole_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Batches that hold whole groups, with the bounds of the groups; the first column is ``g``."""
    held: list[pa.RecordBatch] = []  # the last group so far
    for batch in batches:
        if not batch.num_rows:
            continue
        g = batch.column(0).to_numpy()
        last = int(np.searchsorted(g, g[-1], "left"))
        goes_on = bool(held) and held[-1].column(0)[-1].as_py() == g[0]
        if last or not goes_on:
            if held or last:
                yield _bounded([*held, batch.slice(0, last)])
            held = []
        held.append(batch.slice(last))
    if held:
        yield _bounded(held)


def _bounded(parts: list[pa.RecordBatch]) -> tuple[pa.RecordBatch, np.ndarray]:
    parts = [p for p in parts if p.num_rows]
    batch = parts[0] if len(parts) == 1 else pa.concat_batches(parts)
    g = batch.column(0).to_numpy()
    return batch, np.concatenate([[0], np.flatnonzero(g[1:] != g[:-1]) + 1, [len(g)]])


def fixed_width(column: pa.Array, width: int) -> np.ndarray:
    """Rows of a binary column that all have ``width`` bytes."""
    first = np.frombuffer(column.buffers()[1], np.int32, offset=4 * column.offset, count=1)[0] if len(column) else 0
    return np.frombuffer(column.buffers()[2], np.uint8, offset=int(first), count=width * len(column)).reshape(-1, width)
