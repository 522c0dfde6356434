"""Pairwise correlations against numpy; verdicts on infinite, empty and mismatched inputs."""
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from verdant.operators import comoments as CM
from verdant.operators import models as ML
from verdant.operators import quality as QA
from verdant.plans import q_models as QM

NAN, INF = float("nan"), float("inf")


def brute(rows, cols):
    x = np.array([[NAN if v is None else v for v in r] for r in rows], float).reshape(-1, cols)
    x[np.isinf(x)] = NAN
    out = {}
    for i in range(cols):
        for j in range(i, cols):
            ok = ~np.isnan(x[:, i]) & ~np.isnan(x[:, j])
            a, b = x[ok, i], x[ok, j]
            flat = len(a) < 2 or np.ptp(a) == 0 or np.ptp(b) == 0
            out[i, j] = (int(ok.sum()), None if flat else float(np.corrcoef(a, b)[0, 1]))
    return out


@pytest.mark.parametrize("keys", [1, 5])
def test_pairs(spark, keys, monkeypatch):
    monkeypatch.setattr(CM, "KEYS", keys)
    rng = random.Random(2)
    rows = []
    for i in range(500):
        a = rng.gauss(1e6, 1)
        row = [a, 2 * a + rng.gauss(0, 0.1), rng.choice([None, NAN, INF, rng.random()]), 7.0, rng.random()]
        rows.append((rng.choice(["p", "q", "", None]), *row))
    d = spark.createDataFrame(rows, "k string, a double, b double, c double, d double, e double").repartition(6)
    cols = ["a", "b", "c", "d", "e"]
    for key in (None, "k"):
        told = CM.pair_correlations(d, cols, key).collect()
        for name in {r.key for r in told}:
            want = brute([r[1:] for r in rows if key is None or r[0] == name], 5)
            got = {(r.i, r.j): (r.n, r.r) for r in told if r.key == name}
            assert got.keys() == want.keys()
            for p, (n, r) in want.items():
                assert got[p][0] == n and (got[p][1] is None) == (r is None) and (r is None or got[p][1] == pytest.approx(r, abs=1e-6))
        assert len({r.key for r in told}) == (4 if key else 1)
    assert CM.pair_correlations(d.limit(0), cols).count() == 0


def test_selection_by_correlation_on_the_feature_table(spark):
    t = QM.model_table(spark, "/root/testdata/sf0.001").persist()
    cols = ML.feature_columns(t)
    rows = t.select(*cols, "label").toPandas().astype(float)
    x = rows[cols].to_numpy()
    with np.errstate(invalid="ignore", divide="ignore"):
        r = np.abs(np.corrcoef(x.T))
    told = {(q.a, q.b): q.r for q in ML.correlation_pairs(t, cols).collect()}
    assert len(told) == len(cols) * (len(cols) - 1) // 2
    constant = {c for i, c in enumerate(cols) if np.ptp(x[:, i]) == 0}
    for i, a in enumerate(cols):
        for j in range(i + 1, len(cols)):
            b = cols[j]
            assert told[a, b] is None if {a, b} & constant else told[a, b] == pytest.approx(r[i, j], abs=1e-6)
    gone = {b for (a, b), q in told.items() if q is not None and q > 0.95}
    left = [c for c in cols if c not in gone]
    kept = [q.feature for q in ML.select_correlation(t, cols, k=50).collect()]
    assert len(kept) == min(50, len(left)) and set(kept) <= set(left)
    t.unpersist()


def test_verdicts(spark):
    rng = random.Random(1)
    rows = [("ok", rng.random(), rng.random(), float(i % 2)) for i in range(20)]
    rows += [("inf", INF if i in (3, 4) else rng.random(), -INF if i == 4 else rng.random(), float(i % 2)) for i in range(20)]
    rows += [("gone", None if i < 15 else 1.0 + i, NAN if i < 10 else rng.random(), 1.0) for i in range(20)]
    d = spark.createDataFrame(rows, "series_id string, a double, b double, label double")
    told = {r.series_id: r for r in QA.validate_model_inputs(d, ["a", "b"], "label").collect()}
    assert told["ok"].is_valid and told["ok"].errors == [] and told["ok"].infinite_values == 0
    assert told["inf"].errors == ["3 infinite values in features"] and not told["inf"].is_valid
    assert told["gone"].errors == ["Excessive missing data: 62.5%", "Target variable has no variation"]
    y = d.select("series_id", "label").where("series_id <> 'gone'").unionByName(spark.createDataFrame([("ok", 1.0), ("none", 0.0)], "series_id string, label double"))
    told = {r.series_id: r for r in QA.validate_model_inputs(d.drop("label"), ["a", "b"], "label", y).collect()}
    assert told["ok"].errors == ["Feature and target length mismatch"]
    assert told["none"].errors == ["Empty feature matrix"] and told["none"].missing_data_percentage is None
    assert "Feature and target length mismatch" in told["gone"].errors and told["inf"].errors == ["3 infinite values in features"]
    assert QA.validate_model_inputs(d.limit(0), ["a", "b"], "label").count() == 0
    assert math.isclose(told["gone"].missing_data_percentage, 62.5)
    assert d.where(F.col("series_id") == "ok").count() == 20
