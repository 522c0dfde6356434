"""I5, W11 and W26 against plain Python, on gaps, ties and short series."""
import datetime as dt
import math
import random
import statistics

import pytest

from verdant.operators import pixels as PX
from verdant.operators import stats as ST
from verdant.operators import timeseries as TSO


@pytest.fixture(scope="module")
def series():
    rng = random.Random(3)
    out = {"gaps": [None if rng.random() < 0.04 else rng.choice([1.0, 2.0, 3.0, rng.random()]) for _ in range(150)],
           "jump": [rng.gauss(0, 0.1) + (5 if i >= 40 else 0) for i in range(80)], "flat": [1.0] * 45, "short": [float(i) for i in range(12)], "rise": [i * 0.5 for i in range(40)]}
    return out


@pytest.fixture(scope="module")
def table(spark, series):
    rows = [(s, dt.date(2020, 1, 1) + dt.timedelta(i), v) for s, y in series.items() for i, v in enumerate(y)]
    return spark.createDataFrame(rows, "series_id string, date date, v double").repartition(5)


@pytest.mark.parametrize("n", [30, 5, 2])
def test_mann_kendall(table, series, n):
    told = {(r.series_id, (r.date - dt.date(2020, 1, 1)).days): r for r in TSO.mann_kendall(table, ["v"], n).collect()}
    for s, y in series.items():
        for t in range(len(y)):
            w = y[t - n + 1:t + 1] if t >= n - 1 else []
            r = told[s, t]
            if len(w) < n or None in w:
                assert r.v_mk_trend is None and r.v_trend_significant == 0
                continue
            k = sum((b > a) - (b < a) for i, a in enumerate(w) for b in w[i + 1:])
            z = (k - (k > 0) + (k < 0)) / math.sqrt(n * (n - 1) * (2 * n + 5) / 18)
            assert r.v_mk_trend == pytest.approx(z, abs=1e-12) and r.v_trend_significant == (abs(z) > 1.96)


def test_change_points(table, series, m=10):
    told = {(r.series_id, (r.date - dt.date(2020, 1, 1)).days): r for r in ST.change_points(table, "v", m).collect()}
    assert len(told) == sum(map(len, series.values()))
    for s, y in series.items():
        there = [v for v in y if v is not None]
        var = statistics.pvariance(there)
        cost = lambda b: len(b) - sum(math.exp(-(p - q) ** 2 / (2 * var)) for p in b for q in b) / len(b)  # noqa: B023,E731
        scores = []
        for t in range(len(y)):
            b = y[t - m:t + m] if m <= t <= len(y) - m else []
            scores.append(cost(b) - cost(b[:m]) - cost(b[m:]) if len(b) == 2 * m and None not in b and var else None)
        for t, want in enumerate(scores):
            r = told[s, t]
            near = [x for x in scores[max(0, t - m):t + m + 1] if x is not None]
            assert (r.v_change_score is None) == (want is None) and (want is None or r.v_change_score == pytest.approx(want, abs=1e-9))
            assert r.v_change_status == ("short" if len(there) < 2 * m else "scored" if want is not None else "edge")
            if want is None or abs(want - max(near)) > 1e-9:
                assert r.v_change_point == 0
    assert told["jump", 40].v_change_point == 1 and sum(r.v_change_point for (s, _), r in told.items() if s == "jump") == 1


def test_median_composite(spark):
    rng = random.Random(1)
    rows = [(rng.choice(["a", "b"]), rng.randrange(3), rng.choice([None, 1.0, 2.0, rng.random()]), rng.gauss(0, 9)) for _ in range(400)]
    rows += [("only", 1, None, 5.0), ("even", 1, 1.0, -1.0), ("even", 1, 4.0, -1.0)]
    d = spark.createDataFrame(rows, "region_id string, x int, red double, nir double").repartition(6)
    told = PX.median_composite(d, ["red", "nir"], ("region_id", "x")).collect()
    groups = {}
    for r, x, *bands in rows:
        groups.setdefault((r, x), []).append(bands)
    assert len(told) == len(groups)
    for r in told:
        for b, got in enumerate((r.red, r.nir)):
            v = [q[b] for q in groups[r.region_id, r.x] if q[b] is not None]
            assert got == (pytest.approx(statistics.median(v), abs=1e-12) if v else None)


@pytest.mark.parametrize(("period", "model"), [(7, "additive"), (6, "multiplicative"), (12, "additive")])
def test_short_series_keep_their_rows(table, series, period, model):
    d = table.where("series_id in ('short', 'rise', 'jump')")
    parts = ST.seasonal_decomposition(d.withColumn("v", d.v + 10), "v", period, model)
    told = ST.join_decomposition(d, parts).collect()
    assert len(told) == sum(len(series[s]) for s in ("short", "rise", "jump"))
    for s in ("short", "rise", "jump"):
        rows = [r for r in told if r.series_id == s]
        long_enough = len(series[s]) >= 2 * period
        assert {r.v_decomposition_status for r in rows} == {"decomposed" if long_enough else "short"}
        for r in rows:
            if not long_enough:
                assert r.v_trend is None and r.v_seasonal is None and r.v_residual is None
            else:
                made = r.v_trend + r.v_seasonal + r.v_residual if model == "additive" else r.v_trend * r.v_seasonal * r.v_residual
                assert made == pytest.approx(r.v + 10, abs=1e-9)
        if s == "rise" and model == "additive":  # a line has no season
            assert all(abs(r.v_seasonal) < 1e-9 and abs(r.v_trend - r.v - 10) < 1e-9 for r in rows)
