"""Rows made from a small table, or packed well, are still dealt to many tasks."""
from verdant.operators import soil as SO
from verdant.plans import q_stats as QS
from verdant.sources import fixtures as FX


def test_soil_rows_are_made_by_many_tasks(spark, tmp_dir):
    part = f"{tmp_dir}/part.parquet"
    spark.range(0, 60_000, 1, 1).selectExpr("id AS p_partkey", "CAST(id % 50 AS INT) AS p_size").write.parquet(part)
    long = FX.soil_long(spark, tmp_dir)
    assert long.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    assert long.count() == sum(18 if i % 13 == 0 else 24 for i in range(60_000))


def test_pivot_holds_one_group_for_a_depth(spark):
    rows = [("p", "0-5cm", 0, 5, "sand", 1.0), ("p", "0-5cm", 0, 5, "sand", 3.0), ("p", "0-5cm", 0, 5, "other", 2.0), (None, "0-5cm", 0, 5, "clay", None)]
    wide = SO.pivot_soil(spark.createDataFrame(rows, "location_id string, depth_label string, depth_top_cm int, depth_bottom_cm int, property string, value double"))
    assert wide._jdf.queryExecution().executedPlan().toString().count("HashAggregate(") == 2
    told = {r.location_id: r for r in wide.collect()}
    assert wide.columns == [*SO.SOIL_KEYS, *SO.SOIL_PROPERTIES]
    assert told["p"].sand == 3.0 and told["p"].clay is None and told[None].clay is None and len(told) == 2


def test_series_are_not_merged_into_few_tasks(spark):
    from conftest import SF
    assert QS._a1_input(spark, SF).rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
