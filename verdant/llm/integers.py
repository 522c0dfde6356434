"""Vectors as whole numbers, and their packed form."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def whole_numbers(vector: str, scale: int) -> Column:
    """``floor(scale * x)`` of every component (array<bigint>); null for a vector
    that is null or empty, or that holds null or non-finite components, or
    components so large (over 2^30 / sqrt(dimension) after scaling) that a squared
    distance or an inner product might not fit into a long."""
    v = F.col(vector).cast("array<double>")
    most = 2.0 ** 30 / F.sqrt(F.size(v))
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) * scale > most))
    return F.when((F.size(v) > 0) & ~bad, F.transform(v, lambda x: F.floor(x * scale).cast("bigint")))


def pack(rows: np.ndarray) -> pa.Array:
    """Rows of one width as a binary column."""
    rows = np.ascontiguousarray(rows)
    n, width = len(rows), rows.nbytes // max(len(rows), 1)
    first = (np.arange(n + 1) * width).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(first.tobytes()), pa.py_buffer(rows.tobytes())])


def lists(column: pa.Array) -> np.ndarray:
    """A list column, all of whose rows have one length, as a matrix."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


def small_type(largest: int) -> np.dtype:
    """The smallest integer type that holds ``-largest - 1 .. largest``."""
    return np.dtype(next(t for t in (np.int8, np.int16, np.int32, np.int64) if largest <= np.iinfo(t).max))
