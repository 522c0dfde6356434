"""Smoke tests of the model and rows-only statistics paths on sf0.001
(small forests so the suite stays quick)."""
import os

import pytest
from pyspark.sql import functions as F

from verdant.operators import models as ML
from verdant.operators import stats as ST
from verdant.operators.model_registry import ModelRegistry
from verdant.operators.submodels import SubModels
from verdant.plans import q_models as QM
from verdant.sources import fixtures as FX

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def table(spark):
    t = QM.model_table(spark, SF).cache()
    t.count()
    yield t
    t.unpersist()


def test_fit_evaluate_store(spark, table, tmp_dir):
    feats = ML.feature_columns(table)
    split = ML.temporal_split(table)
    tr, te = split.where("is_train"), split.where(~F.col("is_train"))
    pm = ML.fit_pipeline(tr, feats, ML.random_forest(numTrees=10, maxDepth=5))
    acc = ML.evaluate(pm, te)["accuracy"]
    assert 0.0 <= acc <= 1.0
    pred = ML.predict(pm, te)
    assert pred.count() == te.count()
    assert pred.where((F.col("confidence") < 0) | (F.col("confidence") > 1)).count() == 0
    assert sum(r["count"] for r in ML.confusion_matrix(pred).collect()) == te.count()
    assert ML.class_report(pred).count() >= 1
    assert ML.feature_importance(pm, feats, spark).count() == len(feats)
    path = os.path.join(tmp_dir, "rf")
    ML.save_model(pm, path)
    back = ML.predict(ML.load_model(path), te).select("prediction").collect()
    assert back == pred.select("prediction").collect()


@pytest.fixture(scope="module")
def points(spark):
    """Three classes by two of four columns, over two series."""
    x = [F.rand(i).alias(f"x{i}") for i in range(4)]
    d = spark.range(0, 600, 1, 2).select(F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("series_id"), F.date_add(F.lit("2020-01-01"), (F.col("id") / 2).cast("int")).alias("date"), *x)
    d = d.withColumn("label", ((F.col("x0") > 0.4).cast("int") + (F.col("x1") > 0.6).cast("int")).cast("double")).persist()
    yield d
    d.unpersist()


def test_submodels_are_the_smaller_fits(points):
    rows, _ = ML.assembled(ML.k_folds(points), F.lit(True))
    rows = rows.coalesce(1).persist()
    deep = ML.random_forest(numTrees=7, maxDepth=8, minInstancesPerNode=1, featureSubsetStrategy="all").fit(rows)
    told = SubModels(deep, rows, [7], [2, 3, 8], False).predictions().orderBy("label").collect()
    for i, depth in enumerate([2, 3, 8]):
        own = ML.random_forest(numTrees=7, maxDepth=depth, minInstancesPerNode=1, featureSubsetStrategy="all").fit(rows).transform(rows)
        assert sorted((r.label, r[f"p{i}"]) for r in told) == sorted((r.label, r.prediction) for r in own.select("label", "prediction").collect())
    model = ML.boosted_trees("regression", maxIter=9, maxDepth=3, subsamplingRate=1.0, featureSubsetStrategy="all")
    long = model.copy({model.maxIter: 9})
    long.clear(long.validationIndicatorCol)
    short = long.copy({long.maxIter: 4})
    part = SubModels(long.fit(rows), rows, [4, 9], [None], True, "regression").predictions().collect()
    want = sorted(r.prediction for r in short.fit(rows).transform(rows).select("prediction").collect())
    assert sorted(r.p0 for r in part) == pytest.approx(want, abs=1e-9)
    rows.unpersist()


@pytest.mark.parametrize(("model", "task", "grid", "combos"), [
    ("random_forest", "classification", {"numTrees": [2, 4], "maxDepth": [2, 4], "minInstancesPerNode": [1, 5]}, 8),
    ("random_forest", "regression", {"numTrees": [3], "maxDepth": [1, 4]}, 2),
    ("boosted", "classification", {"maxIter": [1, 3], "maxDepth": [2], "stepSize": [0.1, 0.3], "subsamplingRate": [1.0]}, 4)])
def test_tune_scores_every_combination(points, model, task, grid, combos):
    best, score, results = ML.tune(points, model, task, grid=grid, n_splits=2)
    assert len(results) == combos and all(set(p) == set(grid) for p, _ in results)
    assert (best, score) in results and score == max(s for _, s in results)
    if task == "classification":
        assert all(0 <= s <= 1 for _, s in results) and score > 0.7
    else:
        assert all(s <= 0 for _, s in results) and results[1][1] > results[0][1]  # deeper is better here


def test_tune_on_some_rows(points):
    some = ML.some_rows(points, 200).count()
    assert 120 < some < 280 and ML.some_rows(points, 600).count() == 600
    assert len(ML.tune(points, grid={"numTrees": [2], "maxDepth": [3]}, n_splits=2, fit_rows=300)[2]) == 1


def test_each_class_stops_by_itself(points, tmp_dir):
    _, metrics, _ = ML.train(points, "boosted", maxIter=30, maxDepth=2, cv_folds=0)
    assert metrics["test_accuracy"] > 0.8
    split = ML.k_folds(points, 10).withColumn("is_validation", F.col("fold") == 0).drop("fold")
    noisy = split.withColumn("label", F.when(F.col("label") == 2, F.round(2 * F.rand(8))).otherwise(F.col("label")))
    pm = ML.fit_pipeline(noisy, ["x0", "x1", "x2", "x3"], ML.boosted_trees(maxIter=30, maxDepth=2))
    rounds = [m.getNumTrees for m in pm.stages[-1].models]
    assert len(rounds) == 3 and len(set(rounds)) > 1 and min(rounds) < 30
    ML.save_model(pm, os.path.join(tmp_dir, "gbt"))
    told = ML.predict(ML.load_model(os.path.join(tmp_dir, "gbt")), points)
    assert told.where((F.abs(F.aggregate("probabilities", F.lit(0.0), lambda a, b: a + b) - 1) > 1e-9) | (F.size("probabilities") != 3)).count() == 0


def test_cross_validation_and_rfe(spark, points):
    _, metrics, test = ML.train(points, "random_forest", cv_folds=3, numTrees=5, maxDepth=4)
    assert set(metrics) == {"train_accuracy", "test_accuracy", "cv_mean", "cv_std"} and test.count() == 120
    assert set(ML.select_rfe(points, ["x0", "x1", "x2", "x3"], k=2, step_trees=10)) == {"x0", "x1"}
    assert ML.select_rfe(points, ["x3", "x0", "x1"], k=1, step_trees=5, step=0.9)[0] in ("x0", "x1")


def test_registry_fits_once(spark, points, tmp_dir):
    d = points
    d.write.parquet(os.path.join(tmp_dir, "in"))
    table = spark.read.parquet(os.path.join(tmp_dir, "in"))
    registry = ModelRegistry(spark, os.path.join(tmp_dir, "registry"))
    fits = []

    def fit():
        fits.append(1)
        return ML.train(table, "random_forest", numTrees=3, maxDepth=3)[:2]

    at = registry.get("rf", [table], {"trees": 3}, fit)
    assert registry.get("rf", [spark.read.parquet(os.path.join(tmp_dir, "in"))], {"trees": 3}, fit) == at and len(fits) == 1
    other = registry.get("rf", [table], {"trees": 4}, fit)
    assert other != at and len(fits) == 2
    pm = registry.load(at)
    registry.publish(at, "rf", pm, {"x": 1.0}, {"trees": 3})  # late: the first model stays
    assert {r.metric for r in registry.metrics(at).collect()} == {"train_accuracy", "test_accuracy"}
    assert sorted((r.name, r.address) for r in registry.index().collect()) == sorted([("rf", at), ("rf", other)])
    assert not os.listdir(os.path.join(tmp_dir, "registry", "drafts"))
    told = ML.predict(pm, table)
    assert told.count() == 600 and told.where(F.col("prediction") == F.col("label")).count() > 400
    table.limit(5).write.mode("append").parquet(os.path.join(tmp_dir, "in"))
    assert registry.get("rf", [spark.read.parquet(os.path.join(tmp_dir, "in"))], {"trees": 3}, fit) not in (at, other) and len(fits) == 3


def test_change_points(spark):
    d = FX.daily(spark, SF).select("series_id", "date", "NDVI")
    cp = ST.change_points(d, "NDVI", 10)
    assert cp.count() == d.count()
    assert set(r[0] for r in cp.select("NDVI_change_point").distinct().collect()) <= {0, 1}


def test_boosted_regression_stops_early(spark, table):
    t = table.select("series_id", "date", "NDVI", "T2M", "EVI", F.col("NDVI").alias("label"))
    split = ML.k_folds(t, 10).withColumn("is_validation", F.col("fold") == 0).drop("fold")
    pm = ML.fit_pipeline(split, ["T2M", "EVI"], ML.boosted_trees("regression", maxIter=8, maxDepth=2))
    assert 1 <= pm.stages[-1].getNumTrees <= 8
    assert "rmse" in ML.evaluate(pm, split, "regression")
