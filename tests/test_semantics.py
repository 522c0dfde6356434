"""Unit checks of the null / window contract against pandas."""
import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from verdant.functions import semantics as S

VALS = [1.0, 2.0, None, 4.0, 5.0, 6.0, 7.0, None, 9.0, 10.0, 11.0, 12.0]


def _frame(spark):
    rows = [("s", i, v) for i, v in enumerate(VALS)]
    return spark.createDataFrame(rows, "series_id string, date int, v double")


def _pd():
    return pd.Series([np.nan if v is None else v for v in VALS])


def _col(df, expr):
    return [r[0] for r in df.select(expr.alias("x"), "date").orderBy("date").select("x").collect()]


def _eq(a, b):
    assert len(a) == len(b)
    for x, y in zip(a, b):
        if y is None or (isinstance(y, float) and np.isnan(y)):
            assert x is None, (a, b)
        else:
            assert x is not None and abs(x - y) < 1e-9, (a, b)


def test_rolling_full_frame_guard(spark):
    df = _frame(spark)
    _eq(_col(df, S.roll_mean("v", 3)), list(_pd().rolling(3).mean()))
    _eq(_col(df, S.roll_std("v", 3)), list(_pd().rolling(3).std()))
    _eq(_col(df, S.roll_sum("v", 2)), list(_pd().rolling(2).sum()))


def test_centered_offsets(spark):
    df = _frame(spark)
    for n in (4, 5, 6):
        _eq(_col(df, S.center_mean("v", n)), list(_pd().rolling(n, center=True).mean()))


def test_cumsum_skips_null(spark):
    _eq(_col(_frame(spark), S.cumsum("v")), list(_pd().cumsum()))


def test_pct_change_forward_fills(spark):
    df = S.with_pct_change(_frame(spark), "v", 1, "p")
    got = [r[0] for r in df.orderBy("date").select("p").collect()]
    _eq(got, list(_pd().ffill().pct_change()))


def test_streak_and_island(spark):
    rows = [("s", i, f) for i, f in enumerate([1, 1, 0, 1, 1, 1, 0, 0, 1])]
    df = spark.createDataFrame(rows, "series_id string, date int, f int")
    df = S.with_streak(df, "f", "run")
    df = S.with_island_size(df, "f", "size")
    got = [(r.run, r.size) for r in df.orderBy("date").collect()]
    assert got == [(1, 2), (2, 2), (0, 0), (1, 3), (2, 3), (3, 3), (0, 0), (0, 0), (1, 1)]


def test_flag_and_clip_null(spark):
    df = spark.createDataFrame([(None,), (0.5,), (2.0,)], "v double")
    assert [r[0] for r in df.select(S.flag(F.col("v") > 1)).collect()] == [0, 0, 1]
    assert [r[0] for r in df.select(S.clip("v", 0.0, 1.0)).collect()] == [None, 0.5, 1.0]


def test_portable_rounding(spark):
    df = spark.createDataFrame([(0.2696625,), (-1.0000005,), (None,)], "v double")
    assert [r[0] for r in df.select(S.rnd("v", 6)).collect()][2] is None


def test_class_report_counts(spark):
    from verdant.operators.models import class_report, confusion_matrix
    pred = spark.createDataFrame([(0.0, 0.0), (1.0, 1.0), (1.0, 2.0), (2.0, 2.0), (2.0, 1.0), (2.0, 2.0)],
                                 "label double, prediction double")
    r = {x["class"]: x for x in class_report(pred).collect()}
    assert r[0].precision == 1.0 and r[0].recall == 1.0 and r[0].support == 1
    assert abs(r[2].precision - 2 / 3) < 1e-12 and abs(r[2].recall - 2 / 3) < 1e-12 and r[2].support == 3
    assert abs(r[1].precision - 0.5) < 1e-12 and r[1].support == 2
    assert sum(x["count"] for x in confusion_matrix(pred).collect()) == 6


def test_gap_rules_fire(spark):
    """A hole of 36 days is told by both validators."""
    from verdant.operators import quality as QA
    days = [f"1998-{m:02d}-{d:02d}" for m in (5, 6) for d in range(1, 31)] + ["1998-08-05", "1998-08-06"]
    d = spark.createDataFrame([("A", x, 0.5, 0.3, 10.0, 1.0) for x in days], "series_id string, date string, NDVI double, NDWI_Gao double, T2M double, PRECTOTCORR double")
    d = d.withColumn("date", F.to_date("date"))
    sat = QA.validate_satellite(d.select("series_id", "date", "NDVI", "NDWI_Gao")).first()
    wx = QA.validate_weather(d.select("series_id", "date", "T2M", "PRECTOTCORR")).first()
    assert sat.warnings == ["Large temporal gap: 36.0 days"] and wx.warnings == ["Weather data gaps up to 36.0 days"]


def test_anomaly_methods_keep_columns(spark):
    from verdant.operators import timeseries as TSO
    from verdant.sources import fixtures as FX
    d = FX.daily(spark, "/root/testdata/sf0.001").select("series_id", "date", "NDVI", "T2M")
    seen = {m: set(TSO.detect_anomalies(d, ["NDVI"], m).columns) for m in ("iqr", "zscore", "isolation")}
    want = set(d.columns) | {"NDVI_anomaly", "NDVI_rolling_anomaly", "NDVI_seasonal_anomaly"}
    assert all(s == want for s in seen.values())
    assert TSO.detect_anomalies(d, ["NDVI"], "isolation").count() == d.count()
