"""Registered privacy and retention queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from verdant.operators import privacy as PV
from verdant.operators import retention as RT
from verdant.plans.q_features import PIXEL, PKEYS, _psel
from verdant.plans.q_timeseries import out
from verdant.plans.registry import query
from verdant.session import output_path
from verdant.sources import fixtures as FX

STORE = FX.with_sql(FX.STORAGE_SQL)
AS_OF = "1998-01-01"


@query("anonymize_location", PIXEL + _psel(["round(round_even(lon / 0.05, 0) * 0.05, 6) AS lon",
                                            "round(round_even(lat / 0.05, 0) * 0.05, 6) AS lat"]))
def q_anonymize_location(spark, sf):
    p = FX.pixel(spark, sf).select(*PKEYS, "lon", "lat")
    return out(PV.anonymize_location(p, 0.05), keep=PKEYS, cols=["lon", "lat"])


def metadata_docs(spark, sf):
    d = FX.table(spark, sf, "documents")
    return d.select(
        "doc_id", (F.col("doc_id") % 97).alias("user_id"), "lang",
        F.struct(F.col("source").alias("Farm_ID"), F.col("lang").alias("name"),
                 F.col("source").alias("contact_info")).alias("farm"),
        F.create_map(F.lit("owner_name"), F.col("source"), F.lit("crop"), F.col("lang"),
                     F.lit("Field_ID"), F.col("n_chars").cast("string")).alias("tags"))


@query("drop_sensitive", "SELECT doc_id, lang, lang AS farm_name, 'name' AS farm_fields, 'crop' AS tag_keys, "
                         "lang AS tag_crop, 4 AS n_cols FROM documents")
def q_drop_sensitive(spark, sf):
    c = PV.drop_sensitive(metadata_docs(spark, sf))
    farm_fields = ",".join(f.name for f in c.schema["farm"].dataType.fields)
    return c.select("doc_id", "lang", F.col("farm.name").alias("farm_name"), F.lit(farm_fields).alias("farm_fields"),
                    F.array_join(F.sort_array(F.map_keys("tags")), ",").alias("tag_keys"),
                    F.element_at("tags", F.lit("crop")).alias("tag_crop"), F.lit(len(c.columns)).alias("n_cols"))


def _form(column: str) -> str:
    text = f"CAST({column} AS VARCHAR)"
    return f"coalesce(length({text}) || ':' || {text}, '-')"


_HASH_SQL = "md5(" + " || ".join(_form(c) for c in ("doc_id", "text", "lang", "source", "n_chars")) + ")"


@query("content_hash", f"WITH h AS (SELECT source, {_HASH_SQL} AS h FROM documents)\n"
       "SELECT source, count(*) AS n_docs, CAST(sum(CAST(CAST('0x' || substr(h, 1, 15) AS BIGINT) AS HUGEINT)) AS VARCHAR)"
       " AS fingerprint, min(h) AS min_row_hash FROM h GROUP BY source")
def q_content_hash(spark, sf):
    d = FX.table(spark, sf, "documents")
    h = d.select("source", PV.row_hash("doc_id", "text", "lang", "source", "n_chars").alias("h"))
    return h.groupBy("source").agg(F.count("*").alias("n_docs"), PV.dataset_fingerprint(F.col("h")).alias("fingerprint"),
                                   F.min("h").alias("min_row_hash"))


@query("retention_index", STORE + (
    "SELECT identifier, data_type, timestamp, round(size_mb, 6) AS size_mb, is_essential, retention_days, "
    "CASE WHEN is_essential THEN 'essential' ELSE 'temporary' END AS storage_class, "
    "concat_ws('/', CASE WHEN is_essential THEN 'essential' ELSE 'temporary' END, data_type, identifier) AS storage_path "
    "FROM storage_index"))
def q_retention_index(spark, sf):
    idx = RT.index_records(FX.storage_records(spark, sf))
    return out(idx.drop("metadata"), keep=("identifier", "data_type", "timestamp"),
               cols=["size_mb", "is_essential", "retention_days", "storage_class", "storage_path"])


@query("retention_expiry", STORE + (
    f"SELECT count(*) FILTER (WHERE expired) AS files_removed, round(coalesce(sum(size_mb) FILTER (WHERE expired), 0.0), 6)"
    f" AS space_freed_mb FROM (SELECT *, coalesce(retention_days IS NOT NULL AND TIMESTAMP '{AS_OF}' > "
    f"timestamp + to_days(retention_days), false) AS expired FROM storage_index)"))
def q_retention_expiry(spark, sf):
    idx = RT.index_records(FX.storage_records(spark, sf))
    return out(RT.cleanup_stats(idx, AS_OF), keep=(), cols=["files_removed", "space_freed_mb"])


@query("storage_summary", STORE + (
    "SELECT data_type, count(*) AS total_records, round(sum(size_mb), 2) AS total_size_mb, "
    "count(*) FILTER (WHERE is_essential) AS essential_data_count, "
    "count(*) FILTER (WHERE NOT is_essential) AS temporary_data_count FROM storage_index GROUP BY ROLLUP (data_type)"))
def q_storage_summary(spark, sf):
    idx = RT.index_records(FX.storage_records(spark, sf))
    return RT.storage_summary(idx)


# S10 / Q4 write paths -------------------------------------------------------
_SETS = [("raw_satellite_data", "customers", "1997-11-20", "customer", ("c_custkey", "c_nationkey", "c_acctbal")),
         ("raw_satellite_data", "suppliers", "1997-11-20", "supplier", ("s_suppkey", "s_nationkey")),
         ("raw_satellite_data", "suppliers/2024-06-01T10:00 x=y 50%", "1997-11-20", "supplier", ("s_suppkey", "s_nationkey")),
         ("temp_weather_data", "orders", "1997-12-25", "orders", ("o_orderkey", "o_orderpriority")),
         ("model_parameters", "parts", "1997-01-05", "part", ("p_partkey", "p_size"))]


def _stored(spark, sf, name):
    """Five data sets, three of one type and day, one of them stored twice and one with a name that folders escape."""
    path = output_path(spark, name)
    for kind, identifier, day, table, cols in [*_SETS, _SETS[0]]:
        index = RT.store_data(FX.table(spark, sf, table).select(*cols), path, kind, identifier, day)
    return path, index


def _records_sql():
    def one(kind, identifier, day, table, cols):
        form = "md5(" + " || ".join(_form(c) for c in cols) + ")"
        ess = kind == "model_parameters"
        return (f"SELECT '{kind}' AS data_type, '{identifier}' AS identifier, '{day}' AS store_date, {str(ess).lower()} AS is_essential, "
                f"{'NULL::INTEGER' if ess else '30'} AS retention_days, count(*) AS n_rows, "
                f"CAST(sum(CAST(CAST('0x' || substr({form}, 1, 15) AS BIGINT) AS HUGEINT)) AS VARCHAR) AS data_hash FROM "
                f"(SELECT {', '.join(cols)} FROM {table})")
    return " UNION ALL ".join(one(*x) for x in _SETS)


@query("store_data", "SELECT * FROM (" + _records_sql() + ")")
def q_store_data(spark, sf):
    path, index = _stored(spark, sf, "store")
    cols = ["data_type", "identifier", "store_date", "is_essential", "retention_days", "n_rows", "data_hash"]
    held = spark.read.parquet(f"{path}/data").groupBy("identifier").agg(F.count("*").alias("held"))
    return index.select(*cols).join(held, "identifier").where("held = n_rows").select(*cols)


@query("clean_up", "SELECT identifier, n_rows, identifier IN ('customers', 'suppliers', 'suppliers/2024-06-01T10:00 x=y 50%') AS removed, TIMESTAMP '1998-01-01' AS "
       "last_cleanup FROM (" + _records_sql() + ")")
def q_clean_up(spark, sf):
    """Stores, cleans up twice, and tells which data sets are gone."""
    path, _ = _stored(spark, sf, "store")
    gone = RT.clean_up(spark, path, AS_OF)
    again = RT.clean_up(spark, path, AS_OF)
    left = RT.read_index(spark, path)
    held = spark.read.parquet(f"{path}/data").select("identifier").distinct()
    told = (gone.unionByName(again).select("identifier", "n_rows", F.lit(True).alias("removed")).join(held, "identifier", "left_anti")
            .unionByName(left.join(held, "identifier").select("identifier", "n_rows", F.lit(False).alias("removed"))))
    last = RT.last_cleanup(spark.read.parquet(f"{path}/cleanups")).first()[0]
    return told.withColumn("last_cleanup", F.lit(last))
