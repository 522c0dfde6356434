"""Fits take all rows of their table: nothing is drawn from a large one."""
import pytest
from pyspark.ml.classification import RandomForestClassifier
from pyspark.sql import functions as F

from verdant.operators import models as ML
from verdant.plans import q_models as QM


def rows_of(spark, days):
    """A hundred series of ``days`` days."""
    i = F.col("id")
    d = spark.range(0, 100 * days, 1, 4).select((i % 100).cast("string").alias("series_id"), F.date_add(F.lit("1990-01-01"), (i / 100).cast("int")).alias("date"),
                                                F.rand(1).alias("x0"), F.rand(2).alias("x1"))
    return d.withColumn("label", (F.col("x0") > 0.5).cast("double"))


@pytest.fixture
def seen(monkeypatch):
    """Rows of each fit."""
    told, real = [], ML.fit_estimator
    monkeypatch.setattr(ML, "fit_estimator", lambda train, est: told.append(train.count()) or real(train, est))
    monkeypatch.setattr(ML, "random_forest", (lambda make: lambda task, **p: make(task, **{"numTrees": 2, "maxDepth": 2, **p}))(ML.random_forest))
    monkeypatch.setattr(ML, "boosted_trees", (lambda make: lambda task, **p: make(task, **{"maxIter": 2, "maxDepth": 2, **p}))(ML.boosted_trees))
    return told


@pytest.mark.parametrize("task", ["classification", "regression"])
@pytest.mark.parametrize("model", ["random_forest", "boosted"])
def test_training_fits_on_all_rows(spark, seen, model, task):
    _, metrics, told = ML.train(rows_of(spark, 2_600), model, task)
    assert seen == [208_000] and told.count() == 52_000
    assert metrics.get("test_accuracy", 1) > 0.9


def test_search_fits_on_all_rows(spark, seen):
    ML.tune(rows_of(spark, 30), grid={"numTrees": [1], "maxDepth": [2]}, n_splits=2)
    assert sorted(seen) == [1_000, 2_000]


def test_elimination_fits_on_all_rows(spark, monkeypatch):
    told = []

    class Recorded(RandomForestClassifier):
        def fit(self, d, params=None):
            told.append(d.count())
            return super().fit(d, params)

    monkeypatch.setattr(ML, "RandomForestClassifier", Recorded)
    assert ML.select_rfe(rows_of(spark, 250), ["x1", "x0"], k=1, step_trees=2) == ["x0"]
    assert told == [25_000]


def test_registered_models_have_no_row_limit(spark, monkeypatch, tmp_path):
    i = F.col("id")
    item = {"l_returnflag": F.lit("A"), "l_linestatus": F.lit("F"), "l_suppkey": i % 3, "l_partkey": i * 7, "l_linenumber": (i % 5).cast("int"),
            "l_quantity": (i % 50).cast("double"), "l_extendedprice": (i * 131 % 9000).cast("double"), "l_discount": (i % 11) / 100, "l_tax": (i % 9) / 100,
            "l_shipdate": F.date_add(F.lit("2020-01-01"), (i / 2).cast("int")).cast("timestamp")}
    spark.range(100).select(*[x.alias(c) for c, x in item.items()]).write.parquet(f"{tmp_path}/lineitem.parquet")
    asked, fits = [], []

    class Registry:
        def __init__(self, spark):
            pass

        def get(self, name, inputs, params, fit):
            asked.append(params)
            fit()

    monkeypatch.setattr(QM, "ModelRegistry", Registry)
    monkeypatch.setattr(ML, "train", lambda table, *a, **p: fits.append((table.count(), p)) or (None, {}))
    QM._registered(spark, str(tmp_path))
    QM._registered(spark, str(tmp_path), "boosted", 0, "regression")
    assert not any("rows" in k for p in asked for k in p)
    assert fits == [(50, {"cv_folds": 0}), (49, {"cv_folds": 0})]


def test_parts_of_a_fit(spark, monkeypatch):
    cores = spark.sparkContext.defaultParallelism
    many = ML.in_tasks(spark.range(0, 1_000, 1, 8 * cores))
    assert many.rdd.getNumPartitions() == cores and many.count() == 1_000
    assert "Exchange" not in many._jdf.queryExecution().executedPlan().toString()
    few = ML.in_tasks(spark.range(0, 1_000, 1, 1), "id")
    assert few.rdd.getNumPartitions() == cores and few.count() == 1_000
    few.unpersist()
    monkeypatch.setattr(ML, "TASK_ROWS", 100)
    more = ML.in_tasks(spark.range(0, 1_000, 1, 1), "id")
    assert more.rdd.getNumPartitions() == cores * -(-1_000 // (100 * cores)) and more.count() == 1_000
    more.unpersist()
    large = ML.in_tasks(spark.range(0, 1_000, 1, cores), "id")
    assert "Exchange" not in large._jdf.queryExecution().executedPlan().toString() and not large.is_cached and large.count() == 1_000


def test_rows_without_a_date_are_fitted_too(spark, seen):
    d = rows_of(spark, 20).where("series_id < '3'")
    d = d.withColumn("date", F.when(F.dayofmonth("date") != 3, F.col("date"))).withColumn("day", F.dayofmonth("date"))
    n = d.count()
    assert d.where("date IS NULL").count() == n / 20
    assert len(ML.tune(d, grid={"numTrees": [1], "maxDepth": [2]}, n_splits=1)[2]) == 1
    _, metrics, told = ML.train(d)
    assert seen == [n / 2, n - told.count()] and metrics["test_accuracy"] > 0.9
    assert ML.select_rfe(d, ["x1", "x0", "day"], k=1, step_trees=5) == ["x0"]
