"""Scores of all rows equal a plain walk of the same trees; statuses; bounded fitting."""
import random
from collections import defaultdict

import numpy as np
import pytest

from verdant.operators import isolation as IS

DAYS = "series_id string, date date, a double, b double, note string"


@pytest.fixture(scope="module")
def days(spark):
    rng = random.Random(11)
    rows = []
    for s in range(4):
        for i in range(80):
            a = rng.gauss(10 * s, 1 + s) if rng.random() > 0.05 else None
            rows.append((f"s{s}", i, 60.0 if (s, i) == (1, 33) else a, float(s)))
    rows += [("short", i, float(i), None) for i in range(9)] + [("empty", i, None, None) for i in range(3)] + [(None, i, float(i % 3), 1.0) for i in range(12)]
    rows += [("nan", i, float("nan") if i == 4 else float(i), None) for i in range(12)]
    import datetime as dt
    return spark.createDataFrame([(s, dt.date(2024, 1, 1) + dt.timedelta(i), a, b, "kept") for s, i, a, b in rows], DAYS)


def test_scores_equal_a_walk(days):
    forests = IS.fit(days, ["a", "b"], trees=20, sample=64)
    told = IS.isolation_anomalies(days, ["a", "b"], forests=forests).collect()
    assert len(told) == days.count() and {r.note for r in told} == {"kept"}
    series = defaultdict(list)
    for r in told:
        series[r.series_id].append(r)
    for s, rows in series.items():
        x = np.array([r.a for r in rows if r.a is not None and r.a == r.a])
        want = "scored" if len(x) >= 10 else "short" if len(x) else "empty"
        assert {r.a_isolation_status for r in rows} == {want}
        if want != "scored":
            assert all(r.a_isolation is None and r.a_anomaly == 0 for r in rows)
            continue
        scores = {}
        for r in rows:
            if r.a is None or r.a != r.a:
                assert r.a_isolation is None and r.a_anomaly == 0
            else:
                z = (r.a - x.mean()) / x.std() if x.std() else 0.0
                scores[r.date] = r.a_isolation
                assert r.a_isolation == pytest.approx(forests["a"].score(z), abs=1e-9)
        cut = np.percentile(list(scores.values()), 90)
        assert all(r.a_anomaly == (r.date in scores and scores[r.date] > cut) for r in rows)
    far = next(r for r in told if r.a == 60.0)
    assert far.a_anomaly == 1 and far.a_isolation == max(r.a_isolation or 0 for r in series["s1"])
    assert all(r.b_anomaly == 0 for r in series["s2"])  # a constant series has no outlier


def test_fitting_is_bounded_and_repeatable(days, monkeypatch):
    monkeypatch.setattr(IS, "POOL", 40)
    one, two = (IS.fit(d, ["a"], trees=3, sample=16) for d in (days, days.repartition(7)))
    assert all(np.allclose(s.split, t.split) and (s.left == t.left).all() for s, t in zip(one["a"].trees, two["a"].trees, strict=True))
    assert len(one["a"].table()) < 3 * 16 + 2 * IS.REACH + 3 * 16
    assert IS.fit(days.limit(0), ["a"]) == {}
    assert IS.isolation_anomalies(days.limit(0), ["a"]).count() == 0


def test_table_is_the_walk():
    rng = np.random.default_rng(4)
    forest = IS.Forest([IS.grow(rng.normal(size=64), rng) for _ in range(10)], 64)
    steps = forest.table()
    for x in [*rng.normal(size=50), -99.0, 99.0, *forest.trees[0].steps()[0][:5]]:
        cell = int(np.clip(np.floor(x * IS.GRID), -IS.REACH, IS.REACH - 1))
        hit = steps[(steps.cell == cell) & (steps.lo <= x) & (x < steps.hi)]
        assert len(hit) == 1 and hit.score.iloc[0] == pytest.approx(forest.score(x), abs=1e-12)
