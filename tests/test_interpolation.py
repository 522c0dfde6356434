"""Inverse-distance means over exactly the k nearest samples, against all pairs in numpy."""
import numpy as np
import pytest
from pyspark.sql import functions as F

from verdant.operators import interpolation as IP
from verdant.operators import prescription as PM


@pytest.mark.parametrize("k", [1, 4, 7])
def test_inverse_distance(spark, k):
    rng = np.random.default_rng(k)
    ring = [[0.0, 0.0], [1.0, 0.0], [1.0, 0.6], [0.0, 0.6], [0.0, 0.0]]
    regions = spark.createDataFrame([(r, ring) for r in ("crowd", "few", "two", "none", "far")], "region_id string, geometry array<array<double>>")
    crowd = [(0.25 + 0.001 * x, 0.2 + 0.001 * y) for x, y in rng.normal(size=(150, 2))] + [(x, 0.6 * y) for x, y in rng.random((15, 2))] + [(0.5, 0.3)] * 9 + [(0.0, 0.0)]
    rows = [("crowd", i, float(x), float(y), float(s)) for i, ((x, y), s) in enumerate(zip(crowd, rng.random(len(crowd)), strict=True))]
    rows += [("few", i, 0.2 * i, 0.1 * i, 0.3 * i) for i in range(4)] + [("two", 1, 0.1, 0.1, 0.9), ("two", 2, 0.2, 0.2, 0.8), ("two", 3, 0.2, 0.2, None), ("two", 4, 0.3, 0.2, float("nan"))]
    rows += [("far", i, 5.0 + 0.01 * i, 5.0, 2.0 * i) for i in range(30)]
    points = spark.createDataFrame(rows, "region_id string, point_id int, lon double, lat double, alert_score double")
    cells = PM.grid(regions, 5000.0)
    told = IP.inverse_distance(cells, points, k=k).collect()
    assert len(told) == cells.count()
    at = {(r.region_id, r.row, r.col): (r.lon, r.lat) for r in cells.collect()}
    held = {}
    for r in rows:
        if r[4] is not None and r[4] == r[4]:
            held.setdefault(r[0], []).append(r[1:])
    for r in told:
        mine = held.get(r.region_id, [])
        x, y = at[r.region_id, r.row, r.col]
        best = sorted(((x - px) ** 2 + (y - py) ** 2, i, s) for i, px, py, s in mine)[:k]
        if len(mine) < 3:
            want = 0.5
        elif best[0][0] == 0:
            want = np.mean([s for d, _, s in best if d == 0])
        else:
            want = sum(s / d for d, _, s in best) / sum(1 / d for d, _, _ in best)
        assert r.stress == pytest.approx(min(1.0, max(0.0, want)), abs=1e-9), (r, best[:3])


def test_stress_column(spark):
    d = spark.range(1)
    lit = lambda *names: d.select(*[F.lit(1.0).alias(n) for n in names])
    assert IP.stress_column(lit("CWSI", "alert_score", "x")) == "alert_score"
    assert IP.stress_column(lit("my_Stress", "x", "other_stress")) == "my_Stress"
    assert IP.stress_column(lit("lon", "lat", "value").withColumn("name", F.lit("a"))) == "value"
    with pytest.raises(ValueError):
        IP.stress_column(d.select(F.lit("a").alias("n")))
