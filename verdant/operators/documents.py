"""Consolidated result documents: several JSON documents of nested
sections, written as one run and published by one rename.

A document is a folder of JSON lines, one for each section's key (a region, a
province; none for a summary): ``{"section", "key", "body"}``, the body an
object of the row's other columns.  So a document grows by lines, and no row,
task or driver ever holds all regions.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LINE = "section string, key string, body string"


def lines(section: str, rows: DataFrame, key: str | None = None) -> DataFrame:
    """A section's lines; fields without a value are left out of the body."""
    fields = [c for c in rows.columns if c != key]
    return rows.select(F.lit(section).alias("section"), (F.col(key).cast("string") if key else F.lit(None).cast("string")).alias("key"),
                       F.to_json(F.struct(*fields)).alias("body"))


def _place(spark, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def write_documents(documents: dict[str, list[DataFrame]], base: str, run: str) -> str:
    """Writes every document of a run below a draft name and renames the whole to
    ``base/run``: readers see all documents or none.  A run that is there already
    is not replaced (FileExistsError), and its draft goes; so does that of a write
    that fails."""
    spark = next(iter(documents.values()))[0].sparkSession
    draft, fs = _place(spark, f"{base}/drafts/{uuid.uuid4().hex}")
    final, _ = _place(spark, f"{base}/runs/{run}")
    try:
        for name, sections in documents.items():
            rows = sections[0]
            for more in sections[1:]:
                rows = rows.unionByName(more)
            rows.write.json(f"{draft.toString()}/{name}")
        fs.mkdirs(final.getParent())
        if fs.exists(final) or not fs.rename(draft, final):
            raise FileExistsError(f"{base}/runs/{run}")
        nested, _ = _place(spark, f"{base}/runs/{run}/{draft.getName()}")
        if fs.exists(nested):  # another run took the name between the two calls, and ours went into it
            fs.delete(nested, True)
            raise FileExistsError(f"{base}/runs/{run}")
    finally:
        if fs.exists(draft):
            fs.delete(draft, True)
    return f"{base}/runs/{run}"


def read_document(spark, path: str, name: str) -> DataFrame:
    """(document, section, key, body) of one document of a run."""
    return spark.read.schema(LINE).json(f"{path}/{name}").select(F.lit(name).alias("document"), "section", "key", "body")


def fields(document: DataFrame) -> DataFrame:
    """(document, section, key, name, value): a row for each field of each line."""
    return document.select("document", "section", "key", F.explode(F.from_json("body", "map<string,string>")).alias("name", "value"))
