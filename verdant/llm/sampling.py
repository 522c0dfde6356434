"""Bounded, repeatable samples of labelled rows to fit models on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def remainder(doc_id: str, of: int) -> Column:
    """crc32 of the id as text, modulo ``of`` (null for a null id)."""
    return F.crc32(F.encode(F.col(doc_id).cast("string"), "UTF-8")) % of


def per_class(rows: DataFrame, label: str, doc_id: str, size: int, classes: int) -> DataFrame:
    """About ``size`` rows of each of the ``classes`` most frequent labels, by a
    hash of the id: a label with fewer rows is taken whole.  At most twice
    ``size`` rows of a label are expected; their number doesn't grow with the
    table."""
    counts = rows.groupBy(label).agg(F.count("*").alias("n")).orderBy(F.desc("n"), label).limit(classes).collect()
    if not counts:
        return rows.limit(0)
    share = F.coalesce(*(F.when(F.col(label) == F.lit(r[label]), F.lit(min(1.0, size / r["n"]))) for r in counts))
    return rows.where(F.pmod(F.xxhash64(F.lit("sample"), F.col(doc_id).cast("string")), F.lit(1 << 30)) < share * float(1 << 30))
