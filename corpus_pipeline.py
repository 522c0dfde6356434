"""Corpus preparation: stages over ``documents``, each written and read again.

Language identification drops documents without a language; near-duplicate
groups keep one document; passages that repeat, and passages of the benchmark,
are cut from the texts; sources are mixed to target weights.  Every stage but
the last returns the columns of ``documents``, with ``n_chars`` brought up to
date where a text has changed.

A null or empty text has no letters, so the first stage drops it; rows that repeat an
id and its text count as one in the second; null ids, sources and other columns pass
through, a null source being one of its own; an empty table leaves every stage empty.
Extra columns travel along, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verdant.llm import decontaminate, hyperminhash, language_id, mixing, substring
from verdant.llm.sampling import remainder
from verdant.llm.shared import sieved, stage, whole


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents with evidence enough for a language of the model."""
    model = language_id.fit(docs, remainder("doc_id", 4) != 2)
    told = language_id.identify(docs, model, docs.columns)
    return told.where("learned").select("row.*")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each near-duplicate group, once.

    Only rows that may have to go are shuffled with their texts."""
    found = stage(hyperminhash.near_duplicates(docs.select("doc_id", "text")).select("doc_id", "kept"), "found")
    copies = found.where(~F.col("kept")).select("doc_id").distinct()
    repeated = found.groupBy("doc_id").agg(F.count("*").alias("rows")).where("rows > 1").select("doc_id")
    rows = sieved(docs.select(F.col("doc_id").alias("id"), whole(docs.columns)), copies.union(repeated), "id")
    suspect = rows.where("_maybe").join(copies.withColumnRenamed("doc_id", "id"), "id", "left_anti")
    suspect = suspect.withColumn("h", F.xxhash64("row.text")).dropDuplicates(["id", "h"])
    return rows.where("not _maybe").select("row.*").union(suspect.select("row.*"))


def changed(text, docs: DataFrame):
    """``row`` with a new text; rows that lose all their words go."""
    columns = {"text": text, "n_chars": F.length(text).cast("long")}
    return [columns.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns]


def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts every word that lies in a window that occurs more than once."""
    told = substring.remove_repeated_spans(docs, keep=docs.columns, as_is=True)
    left = F.col("size") > decontaminate.n_in_spans()
    return told.where((F.size("spans") == 0) | left).select(*changed(F.when(F.size("spans") > 0, F.col("kept").cast("string")).otherwise(F.col("row.text")), docs))


def cut_benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts the words that lie in benchmark passages."""
    told = decontaminate.contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), keep=docs.columns)
    left = F.col("n_words") > decontaminate.n_in_spans()
    return told.where((F.size("spans") == 0) | left).select(*changed(decontaminate.cut("row.text", "spans"), docs))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixture: a row for each pass over a document, with ``n_tokens``, ``pass``
    and ``position``, which replace columns of these names."""
    kept = [c for c in docs.columns if c.lower() not in ("n_tokens", "pass", "position")]
    return mixing.realise(mixing.mix(docs)).select(*(F.col(f"`{c}`") for c in kept), F.col("_mix.n_tokens").alias("n_tokens"), "pass", "position")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language ID", identify_language),
    ("MinHash near-dedup", drop_near_duplicates),
    ("substring dedup", cut_repeated_passages),
    ("benchmark decontamination", cut_benchmark_passages),
    ("mixing sources to target weights", mix_sources),
]

#: The first stage is a trained model, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), name.replace(" ", "_"))
    return STAGES[-1][1](spark, docs, sf_dir)
