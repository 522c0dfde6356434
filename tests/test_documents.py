"""Documents are published whole, once, and read back as written."""
import os

import pytest
from pyspark.sql import functions as F

from verdant.operators import documents as DOC


def test_documents_are_published_whole(spark, tmp_dir):
    rows = spark.createDataFrame([("r/1", 1.5, None, [1, 2]), ("r2", None, "x", []), (None, 2.0, "é", None)], "region string, score double, note string, zones array<int>")
    summary = rows.agg(F.count("*").alias("total"))
    made = {"one": [DOC.lines("summary", summary), DOC.lines("regions", rows, "region")], "two": [DOC.lines("regions", rows.limit(0), "region")]}
    path = DOC.write_documents(made, tmp_dir, "2024-01-01T10:00".replace(":", "-"))
    told = {(r.section, r.key): r.body for r in DOC.read_document(spark, path, "one").collect()}
    assert told == {("summary", None): '{"total":3}', ("regions", "r/1"): '{"score":1.5,"zones":[1,2]}', ("regions", "r2"): '{"note":"x","zones":[]}', ("regions", None): '{"score":2.0,"note":"é"}'}
    assert DOC.read_document(spark, path, "two").count() == 0
    assert {(r.key, r.name, r.value) for r in DOC.fields(DOC.read_document(spark, path, "one")).where("section = 'regions'").collect()} >= {("r/1", "zones", "[1,2]"), ("r2", "note", "x"), (None, "score", "2.0")}
    with pytest.raises(FileExistsError):
        DOC.write_documents({"one": [DOC.lines("summary", summary.withColumn("total", F.lit(9)))]}, tmp_dir, "2024-01-01T10-00")
    assert DOC.read_document(spark, path, "one").where("section = 'summary'").first().body == '{"total":3}'
    assert sorted(os.listdir(path)) == ["one", "two"] and os.listdir(os.path.join(tmp_dir, "drafts")) == []


def test_a_failed_write_leaves_nothing(spark, tmp_dir):
    bad = spark.range(3).select(F.raise_error(F.lit("no")).cast("string").alias("x"))
    with pytest.raises(Exception, match="no"):
        DOC.write_documents({"a": [DOC.lines("s", spark.range(1))], "b": [DOC.lines("s", bad)]}, tmp_dir, "r")
    assert not os.path.exists(os.path.join(tmp_dir, "runs", "r")) and os.listdir(os.path.join(tmp_dir, "drafts")) == []
