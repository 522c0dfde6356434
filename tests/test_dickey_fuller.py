"""A2 against least squares by numpy, for k = 0..3 lagged differences."""
import datetime as dt

import numpy as np
import pytest

from verdant.operators import stats as ST


def least_squares(y, k):
    dy = np.diff(y)
    rows = np.arange(k, len(dy))
    x = np.column_stack([np.ones(len(rows)), y[rows], *[dy[rows - i] for i in range(1, k + 1)]])
    if len(rows) <= x.shape[1]:
        return len(rows), None
    beta, *_ = np.linalg.lstsq(x, dy[rows], rcond=None)
    left = dy[rows] - x @ beta
    cov = np.linalg.inv(x.T @ x) * (left @ left) / (len(rows) - x.shape[1])
    return len(rows), beta[1] / np.sqrt(cov[1, 1])


@pytest.mark.parametrize("k", [0, 1, 2, 3])
def test_statistic(spark, k):
    rng = np.random.default_rng(5)
    series = {"walk": 1e4 + np.cumsum(rng.normal(size=200)), "noise": rng.normal(size=120), "few": rng.normal(size=4 + k), "flat": np.full(30, 2.5)}
    rows = [(s, dt.date(2020, 1, 1) + dt.timedelta(int(i)), float(v)) for s, y in series.items() for i, v in enumerate(y)]
    rows += [("noise", dt.date(2021, 1, i), None) for i in range(1, 4)]
    d = spark.createDataFrame(rows, "series_id string, date date, v double")
    told = {r.series_id: r for r in ST.dickey_fuller(d, ["v"], k).collect()}
    for s in ("walk", "noise", "few"):
        n, want = least_squares(series[s], k)
        assert told[s].n_obs == n
        assert told[s].adf_statistic is None if want is None else told[s].adf_statistic == pytest.approx(want, rel=1e-6)
    assert told["noise"].is_stationary and not told["walk"].is_stationary
    assert told["flat"].adf_statistic is None and not told["flat"].is_stationary
