"""Retention store writes and the streaming ingest path."""
import json
import os

from pyspark.sql import functions as F

from verdant.operators import retention as RT
from verdant.operators.privacy import row_hash
from verdant.sources import fixtures as FX
from verdant.sources import payloads as PL
from verdant.streaming.ingest import start_weather_ingest

SF = "/root/testdata/sf0.001"


def test_store_and_expire(spark, tmp_dir):
    d = FX.daily(spark, SF)
    RT.store_data(d, tmp_dir, "raw_satellite_data", "daily_a", "2024-01-01")
    idx = RT.store_data(d.limit(10), tmp_dir, "model_parameters", "params_a", "2024-01-02")
    rows = {r.identifier: r for r in idx.collect()}
    assert rows["daily_a"].retention_days == 30 and not rows["daily_a"].is_essential
    assert rows["params_a"].retention_days is None and rows["params_a"].is_essential
    back = spark.read.parquet(f"{tmp_dir}/data").where("identifier = 'daily_a'")
    assert back.count() == d.count()
    e = {r.identifier: r.expired for r in RT.expiry(idx, "2024-03-01").collect()}
    assert e == {"daily_a": True, "params_a": False}


def test_data_sets_of_one_type_and_day(spark, tmp_dir):
    d = FX.daily(spark, SF)
    RT.store_data(d, tmp_dir, "raw_satellite_data", "region_a", "2024-01-01")
    first = RT.store_data(d.limit(3), tmp_dir, "raw_satellite_data", "region_b", "2024-01-01").collect()
    again = RT.store_data(d, tmp_dir, "raw_satellite_data", "region_a", "2024-01-01").collect()
    assert sorted(map(str, first)) == sorted(map(str, again)) and len(again) == 2
    held = {r.identifier: r["count"] for r in spark.read.parquet(f"{tmp_dir}/data").groupBy("identifier").count().collect()}
    assert held == {"region_a": d.count(), "region_b": 3}


def test_clean_up_removes_only_what_expired(spark, tmp_dir):
    d = FX.daily(spark, SF).limit(5)
    for kind, name, day in (("debug_outputs", "old", "2024-01-01"), ("debug_outputs", "new", "2024-02-20"), ("model_parameters", "kept", "2020-01-01")):
        RT.store_data(d, tmp_dir, kind, name, day)
    assert [r.identifier for r in RT.clean_up(spark, tmp_dir, "2024-03-01").collect()] == ["old"]
    assert RT.clean_up(spark, tmp_dir, "2024-03-02").count() == 0
    assert {r.identifier for r in RT.read_index(spark, tmp_dir).collect()} == {"new", "kept"}
    assert {r.identifier for r in spark.read.parquet(f"{tmp_dir}/data").select("identifier").distinct().collect()} == {"new", "kept"}
    assert str(RT.last_cleanup(spark.read.parquet(f"{tmp_dir}/cleanups")).first()[0]) == "2024-03-02 00:00:00"


def test_row_hash_tells_rows_apart(spark):
    rows = [("a|b", "c"), ("a", "b|c"), ("x", None), ("x", ""), (None, "x"), ("-", "x"), ("1:x", None)]
    h = spark.createDataFrame(rows, "a string, b string").select(row_hash("a", "b").alias("h"))
    assert h.distinct().count() == len(rows)


def test_weather_stream_ingest(spark, tmp_dir):
    d = FX.daily_gaps(spark, SF).select("series_id", "date", "T2M", "T2M_MAX", "T2M_MIN", "PRECTOTCORR", "PET_PT_JPL")
    docs = PL.weather_payload(d).select("location_id", "payload")
    landing = os.path.join(tmp_dir, "landing")
    docs.write.json(landing)
    out = os.path.join(tmp_dir, "table")
    q = start_weather_ingest(spark, landing, out, checkpoint=os.path.join(tmp_dir, "ckpt"))
    q.awaitTermination(300)
    got = spark.read.parquet(out)
    assert got.count() == d.count()
    assert got.where(F.col("T2M").isNull()).count() == d.where(F.col("T2M").isNull()).count()
