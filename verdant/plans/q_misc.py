"""Registered queries for the remaining inventory items: static
dimensions (S6, S7), JSON sink (S8), lookback filter (F2), source join (J1),
seasonal window join (J3), threshold lookup (J6), alert parts (L1-L3, L5,
L6), de-duplication (U2), missing columns (U3), weather summary (A3)."""

from __future__ import annotations

from pyspark.sql import functions as F

from verdant.functions import indices as IX
from verdant.functions import semantics as S
from verdant.operators import alerts as AL
from verdant.operators import quality as QA
from verdant.operators import timeseries as TSO
from verdant.plans import q_alerts as QAL
from verdant.plans import sqlgen as Q
from verdant.plans.q_features import PIXEL
from verdant.plans.q_timeseries import DAILY, GAPS, out
from verdant.plans.registry import query
from verdant.session import output_path
from verdant.sources import dims as D
from verdant.sources import fixtures as FX


# Static dimensions joined to the series that use them ---------------
# Written out here and not built from the tables under test, so that a wrong value there shows.
_CROP_VALUES = """crop_values AS (SELECT crop, season_start, season_end, CAST(ndvi_min AS DOUBLE) AS ndvi_min, CAST(ndwi_stress AS DOUBLE) AS ndwi_stress,
  CAST(cwsi_stress AS DOUBLE) AS cwsi_stress, CAST(water_mm_day AS DOUBLE) AS water_mm_day FROM (VALUES
    ('soybean', 10, 4, 0.7, 0.3, 0.4, 5.5),
    ('corn', 9, 3, 0.75, 0.25, 0.35, 6.0),
    ('wheat', 5, 12, 0.6, 0.35, 0.45, 4.0)) v(crop, season_start, season_end, ndvi_min, ndwi_stress, cwsi_stress, water_mm_day))"""
_NAMES = ("ndvi_critical, ndvi_warning, ndwi_critical, ndwi_warning, cwsi_critical, cwsi_warning, water_balance_critical, water_balance_warning, "
          "temp_stress_critical, temp_stress_warning, consecutive_dry_days_critical, consecutive_dry_days_warning")
_THRESHOLD_VALUES = f"""threshold_values AS (SELECT crop, {", ".join(f"CAST({n} AS DOUBLE) AS {n}" for n in _NAMES.split(", "))} FROM (VALUES
    ('soybean', 0.6, 0.7, 0.2, 0.3, 0.6, 0.4, -30, -15, 35, 32, 14, 10),
    ('corn', 0.65, 0.75, 0.15, 0.25, 0.5, 0.35, -40, -20, 38, 35, 12, 8),
    ('wheat', 0.5, 0.65, 0.25, 0.35, 0.65, 0.45, -25, -10, 32, 30, 16, 12)) v(crop, {_NAMES}))"""


@query("dim_crop", DAILY.rstrip() + f",\n{_CROP_VALUES}\n"
       "SELECT c.crop, n_rows, season_start, season_end, ndvi_min, ndwi_stress, cwsi_stress, water_mm_day "
       f"FROM (SELECT {FX.SERIES_CROP_SQL} AS crop, count(*) AS n_rows FROM daily GROUP BY 1) c LEFT JOIN crop_values v ON c.crop = v.crop")
def q_dim_crop(spark, sf):
    d = FX.daily(spark, sf).select(FX.series_crop().alias("crop"))
    cnt = d.groupBy("crop").agg(F.count("*").alias("n_rows"))
    dim = F.broadcast(D.crop_dim(spark))     # 3 rows, fixed by this code base
    j = cnt.join(dim, "crop", "left")        # rows of crops without an entry stay, with NULLs
    return out(j.select("crop", "n_rows", "season_start", "season_end", "ndvi_min", "ndwi_stress", "cwsi_stress",
                        "water_mm_day"), keep=("crop",))


@query("dim_thresholds", DAILY.rstrip() + f",\n{_THRESHOLD_VALUES}\n"
       f"SELECT c.crop, n_rows, {_NAMES} FROM (SELECT CASE WHEN {FX.SERIES_CROP_SQL} IN ('soybean', 'corn', 'wheat') THEN {FX.SERIES_CROP_SQL} "
       "ELSE 'soybean' END AS crop, count(*) AS n_rows FROM daily GROUP BY 1) c JOIN threshold_values v ON c.crop = v.crop")
def q_dim_thresholds(spark, sf):
    c = FX.series_crop()
    d = FX.daily(spark, sf).select(F.when(c.isin(list(D.ALERT_THRESHOLDS)), c).otherwise("soybean").alias("crop"))
    cnt = d.groupBy("crop").agg(F.count("*").alias("n_rows"))
    return out(cnt.join(F.broadcast(D.threshold_dim(spark)), "crop"), keep=("crop",))


@query("dim_lookup", DAILY.rstrip() + f",\n{_THRESHOLD_VALUES}\n"
       f"SELECT series_id, date, ndvi_warning, temp_stress_critical FROM (SELECT *, {FX.SERIES_CROP_SQL} AS c FROM daily) d JOIN threshold_values v "
       "ON v.crop = CASE WHEN d.c IN ('soybean', 'corn', 'wheat') THEN d.c ELSE 'soybean' END")
def q_dim_lookup(spark, sf):
    d = FX.daily(spark, sf).withColumn("crop", FX.series_crop())
    return out(d.select("series_id", "date", *[D.crop_threshold(F.col("crop"), n).alias(n)
                                               for n in ("ndvi_warning", "temp_stress_critical")]))


# S8 ------------------------------------------------------------------------
@query("sink_json", "SELECT * REPLACE (CAST(timestamp AS VARCHAR) AS timestamp), DATE '2001-11-04' AS run_date FROM ("
                    + QAL.ALERT_SQL + ")")
def q_sink_json(spark, sf):
    """Write the alert rows as JSON partitioned by run date into the shared
    folder and read them back."""
    a = QAL.flat(QAL.alerts(spark, sf)).withColumn("run_date", F.lit("2001-11-04"))
    path = output_path(spark, "alerts_json")
    a.write.mode("overwrite").partitionBy("run_date").json(path)
    return spark.read.json(path)


# F2 ------------------------------------------------------------------------
def date_window(df, end: str, lookback_days: int = 120, lag_days: int = 14, ts: str = "date"):
    """F2 analysis window ending ``lag_days`` before ``end`` and reaching
    ``lookback_days`` further back."""
    e = F.date_sub(F.lit(end).cast("date"), lag_days)
    return df.where(F.col(ts).between(F.date_sub(e, lookback_days), e))


@query("date_range", DAILY + "SELECT series_id, date, round(NDVI, 6) AS NDVI FROM daily WHERE date BETWEEN "
                             "DATE '2000-06-01' - 14 - 120 AND DATE '2000-06-01' - 14")
def q_date_range(spark, sf):
    return out(date_window(FX.daily(spark, sf).select("series_id", "date", "NDVI"), "2000-06-01"), cols=["NDVI"])


# J1 ------------------------------------------------------------------------
def combine_sources(sat, wx, key: str = "series_id", ts: str = "date"):
    """J1 full outer join of satellite and weather rows on (key, DATE)."""
    s = sat.withColumn(ts, F.to_date(ts))
    w = wx.withColumn(ts, F.to_date(ts))
    return s.join(w, [key, ts], "full_outer")


@query("combine_sources", PIXEL + (
    ", sat AS (SELECT region_id AS series_id, date, avg(nir) AS nir, avg(red) AS red FROM pixel "
    "WHERE (qa & 1024) = 0 AND (qa & 2048) = 0 GROUP BY 1, 2)\n, wx AS (SELECT l_returnflag AS series_id, "
    "CAST(l_shipdate AS DATE) AS date, max(l_tax) AS rain FROM lineitem GROUP BY 1, 2)\n"
    "SELECT coalesce(sat.series_id, wx.series_id) AS series_id, coalesce(sat.date, wx.date) AS date, "
    "round(nir, 12) AS nir, round(red, 12) AS red, round(rain, 12) AS rain FROM sat FULL OUTER JOIN wx "
    "ON sat.series_id = wx.series_id AND sat.date = wx.date"))
def q_combine_sources(spark, sf):
    p = FX.pixel(spark, sf)
    clear = p.where((p.qa.bitwiseAND(1024) == 0) & (p.qa.bitwiseAND(2048) == 0))
    sat = clear.groupBy(F.col("region_id").alias("series_id"), "date").agg(
        F.avg("nir").alias("nir"), F.avg("red").alias("red"))
    wx = FX.table(spark, sf, "lineitem").groupBy(F.col("l_returnflag").alias("series_id"), F.to_date("l_shipdate").alias("date")).agg(
        F.max("l_tax").alias("rain"))
    return out(combine_sources(sat, wx), cols=["nir", "red", "rain"], digits=12)


# J3 ------------------------------------------------------------------------
_DW = "OVER (PARTITION BY series_id, dayofyear(date))"


@query("join_seasonal_inner", GAPS + f"SELECT series_id, date, round(avg(NDVI) {_DW}, 6) AS doy_mean, "
                                     f"round(stddev_samp(NDVI) {_DW}, 6) AS doy_std FROM daily_gaps")
def q_join_seasonal_inner(spark, sf):
    d = FX.daily_gaps(spark, sf).select("series_id", "date", "NDVI").withColumn("__doy", F.dayofyear("date"))
    w = S.Window.partitionBy("series_id", "__doy")
    return out(d.select("series_id", "date", F.avg("NDVI").over(w).alias("doy_mean"),
                        F.stddev_samp("NDVI").over(w).alias("doy_std")))


# L1-L3, L5, L6 as projections of the alert pass ----------------------------
def _alert_part(cols):
    return QAL.ALERT_SQL.rsplit("\nSELECT series_id, timestamp,", 1)[0] + "\nSELECT series_id, " + ", ".join(cols) + " FROM c7"


@query("indicators", _alert_part([f"CASE WHEN {n}_p THEN {n}_s END AS {n}_status" for n in AL.INDICATOR_ORDER]
                                 + ["round(cur_ndvi, 6) AS ndvi_value", "round(cur_water_balance, 6) AS water_balance_value"]))
def q_indicators(spark, sf):
    a = QAL.alerts(spark, sf)
    return out(a.select("series_id", *[F.when(F.col(f"{n}_present"), F.col(f"{n}_status")).alias(f"{n}_status")
                                       for n in AL.INDICATOR_ORDER],
                        F.col("ndvi_value"), F.col("water_balance_value")), keep=("series_id",))


@query("anomaly_indicator", _alert_part(["anomalies_3d", "CASE WHEN anomalies_p THEN anomalies_s END AS anomalies_status"]))
def q_anomaly_indicator(spark, sf):
    a = QAL.alerts(spark, sf)
    return a.select("series_id", "anomalies_3d", F.when(F.col("anomalies_present"), F.col("anomalies_status"))
                    .alias("anomalies_status"))


@query("alert_level", _alert_part(["alert_level", "round(alert_score, 6) AS alert_score", "critical_count",
                                   "warning_count", "total_indicators"]))
def q_alert_level(spark, sf):
    a = QAL.alerts(spark, sf)
    return out(a.select("series_id", "alert_level", "alert_score", "critical_count", "warning_count",
                        "total_indicators"), keep=("series_id",))


@query("recommendations", "SELECT series_id, recommendations, CASE WHEN recommendations = '' THEN 0 ELSE "
                          "len(string_split(recommendations, ' | ')) END AS n_recommendations FROM (" + QAL.ALERT_SQL + ")")
def q_recommendations(spark, sf):
    a = QAL.alerts(spark, sf)
    return a.select("series_id", F.array_join("recommendations", " | ").alias("recommendations"),
                    F.size("recommendations").alias("n_recommendations"))


@query("forecast", _alert_part([
    "CASE WHEN n_rows >= 7 THEN CASE WHEN len(list_filter([" + ", ".join([
        f"CASE WHEN ndvi_trend = 'decreasing' THEN '{AL.FORECAST_NDVI_DOWN}' END",
        f"CASE WHEN ndvi_trend = 'increasing' THEN '{AL.FORECAST_NDVI_UP}' END",
        f"CASE WHEN mean_wb_7d < -5 THEN '{AL.FORECAST_DEFICIT}' END",
        f"CASE WHEN mean_wb_7d > 2 THEN '{AL.FORECAST_WET}' END",
        f"CASE WHEN mean_temp_7d > 35 THEN '{AL.FORECAST_HEAT}' END"]) + "], lambda x: x IS NOT NULL)) >= 2 "
    "THEN 'medium' ELSE 'low' END END AS confidence",
    "CASE WHEN n_rows >= 7 THEN CASE ndvi_trend WHEN 'decreasing' THEN 'increasing' WHEN 'increasing' THEN 'decreasing' "
    "ELSE 'unknown' END END AS risk_assessment", "round(mean_wb_7d, 6) AS mean_wb_7d",
    "round(mean_temp_7d, 6) AS mean_temp_7d"]))
def q_forecast(spark, sf):
    a = QAL.alerts(spark, sf)
    return out(a.select("series_id", F.col("forecast.confidence").alias("confidence"),
                        F.col("forecast.risk_assessment").alias("risk_assessment"), "mean_wb_7d", "mean_temp_7d"),
               keep=("series_id",))


# U2 ------------------------------------------------------------------------
@query("dedup_recs", GAPS + (
    ", a AS (SELECT series_id, list(CASE WHEN NDVI < 0.6 THEN 'low vegetation' WHEN NDWI_Gao < 0.3 THEN 'dry canopy' "
    "ELSE 'ok' END ORDER BY date) AS l FROM daily_gaps GROUP BY series_id), u AS (SELECT series_id, x, min(i) AS i FROM "
    "(SELECT series_id, unnest(l) AS x, generate_subscripts(l, 1) AS i FROM a) GROUP BY series_id, x)\n"
    "SELECT series_id, string_agg(x, ' | ' ORDER BY i) AS labels FROM u GROUP BY series_id"))
def q_dedup_recs(spark, sf):
    """U2 order-preserving distinct of each series' daily label sequence: the
    first day of each label, so a list per series is as long as the labels."""
    d = FX.daily_gaps(spark, sf)
    lab = F.when(F.col("NDVI") < 0.6, "low vegetation").when(F.col("NDWI_Gao") < 0.3, "dry canopy").otherwise("ok")
    first = d.groupBy("series_id", lab.alias("x")).agg(F.min("date").alias("date"))
    g = first.groupBy("series_id").agg(F.sort_array(F.collect_list(F.struct("date", "x"))).alias("l"))
    return g.select("series_id", F.array_join(F.transform("l", lambda s: s["x"]), " | ").alias("labels"))


# U3 ------------------------------------------------------------------------
_WANTED = {"weather": ["T2M", "PRECTOTCORR", "EVPTRNS"], "satellite": ["NDVI", "NDWI_Gao", "LAI", "NDWI_McFeeters"]}


@query("missing_columns", GAPS + " UNION ALL ".join(
    f"SELECT series_id, '{s}' AS dataset, '{c}' AS \"column\", {'true' if c in FX.DAILY_VALUE_COLS else 'false'} AS present, "
    + (f"count(*) - count({c})" if c in FX.DAILY_VALUE_COLS else "count(*)") + " AS n_missing FROM daily_gaps GROUP BY series_id"
    for s, cols in (("weather", ("T2M", "PRECTOTCORR", "EVPTRNS")), ("satellite", ("NDVI", "NDWI_Gao", "LAI", "NDWI_McFeeters")))
    for c in cols))
def q_missing_columns(spark, sf):
    d = FX.daily_gaps(spark, sf)
    parts = [QA.column_presence(d, cols).withColumn("dataset", F.lit(s)) for s, cols in _WANTED.items()]
    return parts[0].unionByName(parts[1])


# A3 ------------------------------------------------------------------------
def weather_summary(df, period_days: int = 30, key: str = "series_id", ts: str = "date"):
    """A3 last ``period_days`` rows per series: mean / max / min / sums of the
    weather measures (sums of all-missing are 0, as in pandas)."""
    last = AL.latest_rows(df, period_days, key=key, ts=ts)
    return last.groupBy(key).agg(
        F.avg("T2M").alias("mean_temperature"), F.max("T2M_MAX").alias("max_temperature"),
        F.min("T2M_MIN").alias("min_temperature"), F.coalesce(F.sum("PRECTOTCORR"), F.lit(0.0)).alias("total_precipitation"),
        F.avg("EVPTRNS").alias("mean_evapotranspiration"), F.avg("VPD").alias("mean_vpd"),
        F.coalesce(F.sum("GDD"), F.lit(0.0)).alias("gdd_sum"),
        F.coalesce(F.sum("HEAT_STRESS_DAYS"), F.lit(0)).alias("heat_stress_days"),
        F.coalesce(F.sum("WATER_BALANCE"), F.lit(0.0)).alias("water_balance"))


_E = "0.6108 * exp(17.27 * {t} / ({t} + 237.3))"
_VPD = f"(({_E.format(t='T2M_MAX')} + {_E.format(t='T2M_MIN')}) / 2 - {_E.format(t='T2M_MIN')})"


@query("weather_summary", GAPS + (
    f", a AS (SELECT series_id, T2M, T2M_MAX, T2M_MIN, PRECTOTCORR, PET_PT_JPL AS EVPTRNS, {_VPD} AS VPD, "
    "CASE WHEN T2M_MAX IS NOT NULL THEN greatest((T2M_MAX + T2M_MIN) / 2 - 10.0, 0.0) END AS GDD, "
    f"{Q.flag('T2M_MAX > 32')} AS HEAT_STRESS_DAYS, PRECTOTCORR - PET_PT_JPL AS WATER_BALANCE, "
    "row_number() OVER (PARTITION BY series_id ORDER BY date DESC) AS rd FROM daily_gaps)\n"
    "SELECT series_id, round(avg(T2M), 6) AS mean_temperature, round(max(T2M_MAX), 6) AS max_temperature, "
    "round(min(T2M_MIN), 6) AS min_temperature, round(coalesce(sum(PRECTOTCORR), 0.0), 6) AS total_precipitation, "
    "round(avg(EVPTRNS), 6) AS mean_evapotranspiration, round(avg(VPD), 6) AS mean_vpd, "
    "round(coalesce(sum(GDD), 0.0), 6) AS gdd_sum, CAST(coalesce(sum(HEAT_STRESS_DAYS), 0) AS BIGINT) AS heat_stress_days, "
    "round(coalesce(sum(WATER_BALANCE), 0.0), 6) AS water_balance FROM a WHERE rd <= 30 GROUP BY series_id"))
def q_weather_summary(spark, sf):
    d = FX.daily_gaps(spark, sf).select("series_id", "date", "T2M", "T2M_MAX", "T2M_MIN", "PRECTOTCORR",
                                        F.col("PET_PT_JPL").alias("EVPTRNS"))
    d = IX.weather_derived(d)
    s = weather_summary(d)
    return out(s.withColumn("heat_stress_days", F.col("heat_stress_days").cast("bigint")), keep=("series_id",))
