"""M1 by rows against plain loops, and what its jobs move."""
import datetime as dt
import math
import statistics

import pytest
from pyspark.sql import functions as F

from verdant.operators import models as ML
from verdant.operators.model_registry import ModelRegistry
from verdant.plans import q_models as QM

START = dt.date(2020, 1, 1)


def plain(values, n):
    """Feature columns of one series, a list for each, by loops."""
    told = {"NDVI": values}
    for k in (1, 3, 7, 14):
        told[f"NDVI_lag_{k}"] = [values[i - k] if i >= k else None for i in range(n)]
    for w in (3, 7, 14, 30):
        for name, f in (("mean", statistics.fmean), ("std", statistics.stdev), ("min", min), ("max", max)):
            frames = [values[i - w + 1:i + 1] if i >= w - 1 else [None] for i in range(n)]
            told[f"NDVI_rolling_{name}_{w}"] = [None if None in x else f(x) for x in frames]
    for name, x in told.items():
        first = next((v for v in x if v is not None), 0.0)
        kept, last = [], None
        for v in x:
            last = v if v is not None else last
            kept.append(first if last is None else last)
        told[name] = kept
    return told


@pytest.fixture(scope="module")
def series():
    long = [None if i % 11 == 3 and i < 40 else round(math.sin(i) + i / 50, 3) for i in range(90)]
    return {"a": long, "b": [None, 0.5, None, 0.25], "c": [None, None], None: [1.0, 2.0, 3.0, 4.0]}


def rows_of(spark, series):
    rows = [(s, START + dt.timedelta(i), v, i % 7) for s, x in series.items() for i, v in enumerate(x)]
    return spark.createDataFrame(rows[::-1], "series_id string, date date, NDVI double, tag int").repartition(3)


def test_features_against_loops(spark, series):
    t = ML.prepare_features(rows_of(spark, series), keep=["tag"])
    assert t.columns[:3] == ["series_id", "date", "tag"] and t.columns[-1] == "label"
    told = {(r.series_id, r.date): r for r in t.collect()}
    assert len(told) == sum(len(x) for x in series.values())
    for s, x in series.items():
        for name, want in plain(x, len(x)).items():
            got = [told[s, START + dt.timedelta(i)][name] for i in range(len(x))]
            assert got == pytest.approx(want, rel=1e-12, abs=1e-12), (s, name)
        assert [told[s, START + dt.timedelta(i)].tag for i in range(len(x))] == [i % 7 for i in range(len(x))]


def test_rows_without_a_target_count_for_lags_only(spark):
    d = rows_of(spark, {"a": [1.0, 2.0, 3.0, 4.0]}).withColumn("y", F.when(F.col("NDVI") != 2, F.col("NDVI")))
    told = ML.prepare_features(d, target="y").orderBy("date").select("NDVI", "NDVI_lag_1", "label").collect()
    assert [tuple(r) for r in told] == [(1.0, 2.0, 1.0), (3.0, 2.0, 3.0), (4.0, 3.0, 4.0)]


def test_a_day_given_twice_keeps_both_rows(spark):
    d = rows_of(spark, {"a": [1.0, 2.0]})
    assert ML.prepare_features(d.unionByName(d)).count() == 4


def test_wide_rows_are_not_shuffled(spark, series):
    t = ML.prepare_features(rows_of(spark, series))
    plan = t._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" in plan and "Exchange" not in plan[:plan.index("FlatMapGroupsInArrow")]
    f = ML.anova_f(t, ML.feature_columns(t))._jdf.queryExecution().executedPlan().toString()
    assert f.count("FlatMapGroupsInArrow") == 1


@pytest.mark.parametrize("task", ["classification", "regression"])
def test_only_rows_of_the_fit_are_written(spark, monkeypatch, task):
    x = [F.rand(i).alias(f"x{i}") for i in range(2)]
    d = spark.range(0, 400, 1, 2).select(F.lit("a").alias("series_id"), F.date_add(F.lit("2020-01-01"), F.col("id").cast("int")).alias("date"), *x)
    d = d.withColumn("label", (F.col("x0") > 0.5).cast("double"))
    written = []
    real = ML.cut_lineage
    monkeypatch.setattr(ML, "cut_lineage", lambda df: (lambda kept: written.append(kept.count()) or kept)(real(df)))
    _, metrics, told = ML.train(d, task=task, fit_rows=100, numTrees=3, maxDepth=3)
    assert told.count() == 80 and 60 < sum(written) < 140
    own = ML.temporal_split(d)
    again = ML.train(own, task=task, fit_rows=100, numTrees=3, maxDepth=3)[1]
    assert again == pytest.approx(metrics)


def test_a_fit_and_its_scoring_make_the_input_once(spark, monkeypatch, tmp_path):
    i = F.col("id")
    item = {"l_returnflag": F.when(i % 2 == 0, "A").otherwise("N"), "l_linestatus": F.lit("F"), "l_suppkey": i % 3, "l_partkey": i * 7,
            "l_linenumber": (i % 5).cast("int"), "l_quantity": (i % 50).cast("double"), "l_extendedprice": (i * 131 % 9000).cast("double"),
            "l_discount": (i % 11) / 100, "l_tax": (i % 9) / 100, "l_shipdate": F.date_add(F.lit("2020-01-01"), (i / 4).cast("int")).cast("timestamp")}
    spark.range(400).select(*[x.alias(c) for c, x in item.items()]).write.parquet(f"{tmp_path}/lineitem.parquet")
    made = spark.sparkContext.accumulator(0)

    def one(x):
        made.add(1)
        return x

    real, forest = QM.model_input, ML.random_forest
    monkeypatch.setattr(QM, "model_input", lambda *a: real(*a).select("series_id", "date", "NDVI", F.udf(one, "double")("SAVI").alias("SAVI")))
    monkeypatch.setattr(ML, "random_forest", lambda task, **p: forest(task, numTrees=2, maxDepth=2, **p))
    monkeypatch.setattr(QM, "ModelRegistry", lambda s: ModelRegistry(s, f"{tmp_path}/registry"))
    p = QM.q_score(spark, str(tmp_path))
    told = {(r.series_id, r.date): (r.prediction, r.confidence) for r in p.collect()}
    assert len(told) == made.value == real(spark, str(tmp_path)).count() == 200
    assert "parquet" not in p._jdf.queryExecution().executedPlan().toString()
    again = QM.q_score(spark, str(tmp_path))            # the model is there: nothing is written
    assert "parquet" in again._jdf.queryExecution().executedPlan().toString() and made.value == 200
