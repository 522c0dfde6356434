"""Retention store: data sets are written as parquet
partitioned by class / data type / store date / identifier, with one index
record each.  Writing the same data set again replaces it and its record.
Expiry and summaries are queries over the index; clean-up drops the expired
records and the partitions they name."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verdant.operators.privacy import dataset_fingerprint, row_hash
from verdant.session import cut_lineage

# Fixed values of the reference: essential (kept forever) and temporary
# (kept ``max_storage_days``) data types.
ESSENTIAL_TYPES = ["model_parameters", "prescription_maps", "alert_history", "crop_parameters",
                   "validation_results"]
TEMPORARY_TYPES = ["raw_satellite_data", "intermediate_calculations", "temp_weather_data", "debug_outputs"]
MAX_STORAGE_DAYS = 30


def classify(data_type, max_days: int = MAX_STORAGE_DAYS):
    ess = F.col(data_type).isin(ESSENTIAL_TYPES) if isinstance(data_type, str) else data_type.isin(ESSENTIAL_TYPES)
    return ess, F.when(~ess, F.lit(max_days))


def index_records(records: DataFrame, max_days: int = MAX_STORAGE_DAYS) -> DataFrame:
    """Index rows (identifier, data_type, timestamp, ...) -> with class,
    retention and storage path columns."""
    ess, ret = classify("data_type", max_days)
    return (records.withColumn("is_essential", ess).withColumn("retention_days", ret)
                   .withColumn("storage_class", F.when(ess, "essential").otherwise("temporary"))
                   .withColumn("storage_path", F.concat_ws("/", "storage_class", "data_type", "identifier")))


def store_data(df: DataFrame, base_path: str, data_type: str, identifier: str, store_date: str,
               metadata: dict | None = None, max_days: int = MAX_STORAGE_DAYS) -> DataFrame:
    """S10 write one data set and return the index.

    The data set is the partition (class, data_type, store_date, identifier) of
    ``base_path/data``; its record is the partition (data_type, store_date,
    identifier) of ``base_path/index``.  Both are replaced alone, so other data
    sets stay and a repeated write changes nothing.  Hash and size are computed
    by aggregates."""
    spark = df.sparkSession
    ess = data_type in ESSENTIAL_TYPES
    klass = "essential" if ess else "temporary"
    parts = {"storage_class": klass, "data_type": data_type, "store_date": store_date, "identifier": identifier}
    out = df.withColumns({k: F.lit(v) for k, v in parts.items()})
    _replace(out, f"{base_path}/data", list(parts))
    stats = df.select(row_hash(*df.columns).alias("h")).agg(
        dataset_fingerprint(F.col("h")).alias("data_hash"), F.count("*").alias("n_rows"))
    meta = F.create_map(*[x for k, v in (metadata or {}).items() for x in (F.lit(k), F.lit(str(v)))]) \
        if metadata else F.create_map().cast("map<string,string>")
    rec = stats.select(F.lit(store_date).cast("date").alias("timestamp"), F.lit(ess).alias("is_essential"),
                       F.lit(None if ess else max_days).cast("int").alias("retention_days"),
                       meta.alias("metadata"), "data_hash", "n_rows",
                       F.lit("/".join(["data", *(_folder(k, v) for k, v in parts.items())])).alias("storage_path"),
                       F.lit(data_type).alias("data_type"), F.lit(store_date).alias("store_date"), F.lit(identifier).alias("identifier"))
    _replace(rec, f"{base_path}/index", ["data_type", "store_date", "identifier"])
    return read_index(spark, base_path)


def _replace(df: DataFrame, path: str, partitions: list[str]) -> None:
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*partitions).parquet(path)


INDEX_SCHEMA = ("timestamp date, is_essential boolean, retention_days int, metadata map<string,string>, data_hash string, "
                "n_rows long, storage_path string, data_type string, store_date string, identifier string")


def read_index(spark, base_path: str) -> DataFrame:
    return spark.read.schema(INDEX_SCHEMA).parquet(f"{base_path}/index")


def _folder(name: str, value: str | None) -> str:
    """A partition's folder, its value escaped as Spark does."""
    unsafe = set('"#%\'*/:=?\\{[]^\x7f') | {chr(c) for c in range(1, 32)}
    held = "__HIVE_DEFAULT_PARTITION__" if value in (None, "") else "".join(f"%{ord(c):02X}" if c in unsafe else c for c in value)
    return f"{name}={held}"


def _places(r) -> list[str]:
    """A record's folders below the store: its data, then its index record."""
    klass = "essential" if r.is_essential else "temporary"
    own = [("data_type", r.data_type), ("store_date", r.store_date), ("identifier", r.identifier)]
    return ["/".join(["data", _folder("storage_class", klass), *(_folder(k, v) for k, v in own)]),
            "/".join(["index", *(_folder(k, v) for k, v in own)])]


def _remove(fs, path) -> bool:
    """Deletes a folder; whether it is gone afterwards."""
    if fs.exists(path):
        fs.delete(path, True)
    return not fs.exists(path)


def clean_up(spark, base_path: str, as_of: str) -> DataFrame:
    """Q4 remove the data sets that have expired at ``as_of`` and their index
    records, and note the run.  Returns the records really removed: those whose
    data and record are both gone afterwards.  The record goes last and only after
    its data, so an interrupted or failed removal is found again by the next run.

    The driver deletes one folder after the other and holds a batch of records at a
    time; what it tells is written in batches, too."""
    gone = expiry(read_index(spark, base_path), as_of).where("expired").drop("expired")
    gone = cut_lineage(gone)    # before its partitions go
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    told = f"{base_path}/removals/run={uuid.uuid4().hex}"
    names = "data_type string, store_date string, identifier string"

    def note(rows):
        spark.createDataFrame(rows, names).coalesce(1).write.mode("append").parquet(told)

    batch = []
    note(batch)
    for r in gone.select("is_essential", "data_type", "store_date", "identifier").toLocalIterator():
        paths = [jvm.org.apache.hadoop.fs.Path(f"{base_path}/{place}") for place in _places(r)]
        if all(_remove(path.getFileSystem(conf), path) for path in paths):
            batch.append((r.data_type, r.store_date, r.identifier))
        if len(batch) >= 10_000:
            note(batch)
            batch = []
    if batch:
        note(batch)
    spark.range(1).select(F.lit(as_of).cast("timestamp").alias("cleanup_ts")).write.mode("append").parquet(f"{base_path}/cleanups")
    really = spark.read.schema(names).parquet(told).toDF("__t", "__d", "__i")
    same = F.col("data_type").eqNullSafe(F.col("__t")) & F.col("store_date").eqNullSafe(F.col("__d")) & F.col("identifier").eqNullSafe(F.col("__i"))
    return gone.join(really, same, "left_semi")


def expiry(index: DataFrame, as_of: str) -> DataFrame:
    """Q4 flag records past ``timestamp + retention_days`` at ``as_of``
    (essential records never expire)."""
    exp = (F.col("retention_days").isNotNull()
           & (F.lit(as_of).cast("timestamp") > F.col("timestamp").cast("timestamp")
              + F.make_interval(days=F.col("retention_days"))))
    return index.withColumn("expired", F.coalesce(exp, F.lit(False)))


def cleanup_stats(index: DataFrame, as_of: str, size_col: str = "size_mb") -> DataFrame:
    """Q4 number of expired records and megabytes they free (one row)."""
    e = expiry(index, as_of)
    return e.agg(F.count_if("expired").alias("files_removed"),
                 F.coalesce(F.sum(F.when(F.col("expired"), F.col(size_col))), F.lit(0.0)).alias("space_freed_mb"))


def storage_summary(index: DataFrame, size_col: str = "size_mb") -> DataFrame:
    """A20 records, size, essential / temporary counts per data type with a
    grand-total row (data_type NULL), via ROLLUP."""
    return index.rollup("data_type").agg(
        F.count("*").alias("total_records"), F.round(F.sum(size_col), 2).alias("total_size_mb"),
        F.count_if("is_essential").alias("essential_data_count"),
        F.count_if(~F.col("is_essential")).alias("temporary_data_count"))


def last_cleanup(log: DataFrame, ts: str = "cleanup_ts") -> DataFrame:
    """A20 time of the latest clean-up run."""
    return log.agg(F.max(ts).alias("last_cleanup"))
