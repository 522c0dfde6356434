"""Registered alert queries (L1-L6, T1, F7, U2, S9) over the combined
per-series daily table (weather + indices + balance + dry spell + anomaly
flags), i.e. the chained E2 pass."""

from __future__ import annotations

from pyspark.sql import functions as F

from verdant.functions import semantics as S

from verdant.operators import alerts as AL
from verdant.operators import timeseries as TSO
from verdant.plans import sqlgen as Q
from verdant.plans.q_timeseries import DAILY, GAPS, out
from verdant.plans.registry import query
from verdant.sources import dims as D
from verdant.session import output_path
from verdant.sources import fixtures as FX

ALERT_COLS = ["NDVI", "NDWI_Gao", "CWSI", "T2M_MAX", "water_balance_daily", "water_balance_7d",
              "consecutive_dry_days", "NDVI_anomaly", "NDVI_rolling_anomaly"]


def combined(spark, sf):
    d = FX.daily(spark, sf)
    d = TSO.water_balance(d)
    d = TSO.dry_spell(d)
    d = TSO.anomaly_zscore(d, ["NDVI"])
    d = TSO.anomaly_rolling(d, ["NDVI"])
    return d.select("series_id", "date", *ALERT_COLS).withColumn("crop", FX.series_crop())


def alerts(spark, sf):
    return AL.generate_alerts(combined(spark, sf), F.col("crop"))


def flat(a):
    names = [n for n in AL.INDICATOR_ORDER if f"{n}_present" in a.columns]
    statuses = F.concat_ws(";", *[F.when(F.col(f"{n}_present"), F.concat(F.lit(f"{n}="), F.col(f"{n}_status")))
                                  for n in names])
    return a.select("series_id", "timestamp", "crop_type", "alert_level", S.rnd("alert_score", 6).alias("alert_score"),
                    "total_indicators", "critical_count", "warning_count", statuses.alias("statuses"),
                    AL.trend_word(F.col("slope_ndvi"), F.col("n_ndvi")).alias("ndvi_trend"),
                    F.array_join("recommendations", " | ").alias("recommendations"),
                    F.col("forecast.confidence").alias("forecast_confidence"),
                    F.col("forecast.risk_assessment").alias("forecast_risk"),
                    F.array_join("forecast.expected_conditions", " | ").alias("forecast_conditions"),
                    "heat_stress_days", S.rnd("max_temp_7d", 6).alias("max_temp_7d"))


# --------------------------------------------------------------- oracle ---
def _th(name):
    i = D.ALERT_THRESHOLD_NAMES.index(name)
    return "CASE crop " + " ".join(f"WHEN '{c}' THEN {float(v[i])}" for c, v in D.ALERT_THRESHOLDS.items()) + " END"


def _status(v, w, c, rev=False):
    op = "<=" if rev else ">="
    return (f"CASE WHEN {v} IS NULL THEN 'unknown' WHEN {v} {op} {c} THEN 'critical' WHEN {v} {op} {w} THEN 'warning' "
            f"ELSE 'normal' END")


def _trend(s, n):
    return (f"CASE WHEN {n} < 3 THEN 'unknown' WHEN {s} > 0.01 THEN 'increasing' WHEN {s} < -0.01 THEN 'decreasing' "
            f"ELSE 'stable' END")


WHOLE = "OVER (PARTITION BY series_id)"
_TC = {"ndvi": "NDVI", "ndwi": "NDWI_Gao", "cwsi": "CWSI", "water_balance": "water_balance_7d"}


def _alert_sql():
    c1 = _sel_all("daily", ["NDVI", "NDWI_Gao", "CWSI", "T2M_MAX", "PRECTOTCORR - PET_PT_JPL AS water_balance_daily",
                                 Q.flag("PRECTOTCORR <= 0.1") + " AS dry", Q.rn(),
                                 f"CASE WHEN {FX.SERIES_CROP_SQL} IN ('soybean', 'corn', 'wheat') THEN {FX.SERIES_CROP_SQL} "
                                 "ELSE 'soybean' END AS crop"])
    c2 = _sel_all("c1", ["NDVI", "NDWI_Gao", "CWSI", "T2M_MAX", "water_balance_daily", "crop",
                         f"{Q.roll('sum', 'water_balance_daily', 7)} AS water_balance_7d",
                         Q.streak_cols("dry", "consecutive_dry_days"),
                         Q.flag(f"abs({Q.div(f'NDVI - avg(NDVI) {WHOLE}', f'stddev_pop(NDVI) {WHOLE}')}) > 2.0")
                         + " AS NDVI_anomaly",
                         Q.flag(f"abs({Q.div('NDVI - ' + Q.center('avg', 'NDVI', 14), Q.center('stddev_samp', 'NDVI', 14))})"
                                " > 2.5") + " AS NDVI_rolling_anomaly"])
    run = "OVER (PARTITION BY series_id ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    c3 = _sel_all("c2", ["*", "row_number() OVER (PARTITION BY series_id ORDER BY date DESC) AS rd"] +
                  [f"CAST(count({c}) {run} AS DOUBLE) AS x_{n}" for n, c in _TC.items()])
    aggs = ["count(*) AS n_rows", "max(date) AS timestamp", "any_value(crop) AS crop"]
    for n, c in _TC.items():
        aggs += [f"max({c}) FILTER (WHERE rd = 1) AS cur_{n}",
                 f"regr_slope({c}, x_{n}) FILTER (WHERE rd <= 7) AS slope_{n}",
                 f"count({c}) FILTER (WHERE rd <= 7) AS n_{n}"]
    aggs += ["max(T2M_MAX) FILTER (WHERE rd <= 7) AS max_temp_7d",
             f"count(*) FILTER (WHERE rd <= 7 AND T2M_MAX > {_th('temp_stress_warning')}) AS heat_stress_days",
             "avg(T2M_MAX) FILTER (WHERE rd <= 7) AS mean_temp_7d",
             "max(consecutive_dry_days) FILTER (WHERE rd = 1) AS cur_dry",
             "avg(water_balance_daily) FILTER (WHERE rd <= 7) AS mean_wb_7d",
             "coalesce(sum(NDVI_anomaly) FILTER (WHERE rd <= 3), 0) + coalesce(sum(NDVI_rolling_anomaly) "
             "FILTER (WHERE rd <= 3), 0) AS anomalies_3d"]
    c4 = f"SELECT series_id, {', '.join(aggs)} FROM c3 GROUP BY series_id"
    st = {
        "ndvi": ("cur_ndvi IS NOT NULL", _status("cur_ndvi", _th("ndvi_warning"), _th("ndvi_critical"), True)),
        "ndwi": ("cur_ndwi IS NOT NULL", _status("cur_ndwi", _th("ndwi_warning"), _th("ndwi_critical"), True)),
        "cwsi": ("true", _status("cur_cwsi", _th("cwsi_warning"), _th("cwsi_critical"))),
        "water_balance": ("true", _status("cur_water_balance", _th("water_balance_warning"),
                                          _th("water_balance_critical"), True)),
        "temperature": ("true", f"CASE WHEN max_temp_7d > {_th('temp_stress_critical')} THEN 'critical' WHEN max_temp_7d > "
                                f"{_th('temp_stress_warning')} THEN 'warning' ELSE 'normal' END"),
        "drought": ("true", _status("cur_dry", _th("consecutive_dry_days_warning"), _th("consecutive_dry_days_critical"))),
        "anomalies": ("anomalies_3d > 0", "CASE WHEN anomalies_3d >= 5 THEN 'critical' WHEN anomalies_3d >= 2 THEN "
                                          "'warning' ELSE 'normal' END"),
    }
    c5 = ("SELECT *, " + ", ".join(f"({p}) AS {n}_p, {s} AS {n}_s" for n, (p, s) in st.items())
          + f", {_trend('slope_ndvi', 'n_ndvi')} AS ndvi_trend FROM c4")
    tot = " + ".join(f"CASE WHEN {n}_p THEN 1 ELSE 0 END" for n in st)
    cc = " + ".join(f"CASE WHEN {n}_p AND {n}_s = 'critical' THEN 1 ELSE 0 END" for n in st)
    wc = " + ".join(f"CASE WHEN {n}_p AND {n}_s = 'warning' THEN 1 ELSE 0 END" for n in st)
    c6 = f"SELECT *, {tot} AS total_indicators, {cc} AS critical_count, {wc} AS warning_count FROM c5"
    base = "CASE WHEN total_indicators > 0 THEN (critical_count + 0.5 * warning_count) / total_indicators ELSE 0.0 END"
    lvl = (f"CASE WHEN {base} >= 0.7 OR critical_count >= 2 THEN 'critical' WHEN {base} >= 0.4 OR warning_count >= 2 "
           f"OR critical_count >= 1 THEN 'warning' ELSE 'normal' END")
    c7 = f"SELECT *, {lvl} AS alert_level, least(1.0, {base}) AS alert_score FROM c6"
    recs = [f"CASE WHEN alert_level = 'critical' THEN '{t}' END" for t in AL.REC_CRITICAL]
    recs += [f"CASE WHEN ndvi_p AND ndvi_s IN ('warning', 'critical') THEN '{AL.REC_NDVI}' END",
             f"CASE WHEN ndvi_p AND ndvi_s IN ('warning', 'critical') AND ndvi_trend = 'decreasing' THEN '{AL.REC_NDVI_TREND}' END",
             f"CASE WHEN water_balance_s IN ('warning', 'critical') THEN '{AL.REC_BALANCE}' END",
             f"CASE WHEN heat_stress_days >= 3 THEN '{AL.REC_HEAT_DAYS}' END",
             f"CASE WHEN temperature_s = 'critical' THEN '{AL.REC_HEAT_CRITICAL}' END",
             "CASE WHEN drought_s IN ('warning', 'critical') THEN 'Extended dry period (' || CAST(coalesce(cur_dry, 0) AS "
             "INTEGER) || ' days) - irrigation strongly recommended' END"]
    for c, (crit, warn) in AL.REC_CROP.items():
        recs += [f"CASE WHEN crop = '{c}' AND alert_level = 'critical' THEN '{t}' END" for t in crit]
        recs += [f"CASE WHEN crop = '{c}' AND alert_level = 'warning' THEN '{t}' END" for t in warn]
    recs += [f"CASE WHEN alert_level IN ('warning', 'critical') THEN '{t}' END" for t in AL.REC_GENERAL]
    rec_list = f"list_distinct_ordered([{', '.join(recs)}])"
    fc = [f"CASE WHEN ndvi_trend = 'decreasing' THEN '{AL.FORECAST_NDVI_DOWN}' END",
          f"CASE WHEN ndvi_trend = 'increasing' THEN '{AL.FORECAST_NDVI_UP}' END",
          f"CASE WHEN mean_wb_7d < -5 THEN '{AL.FORECAST_DEFICIT}' END",
          f"CASE WHEN mean_wb_7d > 2 THEN '{AL.FORECAST_WET}' END",
          f"CASE WHEN mean_temp_7d > 35 THEN '{AL.FORECAST_HEAT}' END"]
    fc_list = f"list_filter([{', '.join(fc)}], lambda x: x IS NOT NULL)"
    statuses = "concat_ws(';', " + ", ".join(f"CASE WHEN {n}_p THEN '{n}=' || {n}_s END" for n in st) + ")"
    final = (f"SELECT series_id, timestamp, crop AS crop_type, alert_level, round(alert_score, 6) AS alert_score, "
             f"total_indicators, critical_count, warning_count, {statuses} AS statuses, ndvi_trend, "
             f"coalesce(array_to_string({rec_list}, ' | '), '') AS recommendations, "
             f"CASE WHEN n_rows >= 7 THEN CASE WHEN len({fc_list}) >= 2 THEN 'medium' ELSE 'low' END END AS forecast_confidence, "
             f"CASE WHEN n_rows >= 7 THEN CASE ndvi_trend WHEN 'decreasing' THEN 'increasing' WHEN 'increasing' THEN "
             f"'decreasing' ELSE 'unknown' END END AS forecast_risk, "
             f"CASE WHEN n_rows >= 7 THEN array_to_string({fc_list}, ' | ') END AS forecast_conditions, heat_stress_days, "
             f"round(max_temp_7d, 6) AS max_temp_7d FROM c7")
    macro = ("")
    return (DAILY.rstrip() + f",\nc1 AS ({c1}),\nc2 AS ({c2}),\nc3 AS ({c3}),\nc4 AS ({c4}),\nc5 AS ({c5}),\n"
            f"c6 AS ({c6}),\nc7 AS ({c7})\n" + final)


def _sel_all(src, exprs):
    return f"SELECT series_id, date, {', '.join(exprs)} FROM {src}"


def _distinct_ordered_sql(sql):
    # keep first occurrence, drop NULLs, preserve order
    return sql.replace("list_distinct_ordered(", "list_distinct_first(")


ALERT_SQL = _alert_sql().replace(
    "list_distinct_ordered([",
    "(SELECT list(x ORDER BY i) FROM (SELECT x, min(i) AS i FROM (SELECT unnest(l) AS x, "
    "generate_subscripts(l, 1) AS i FROM (SELECT [")
ALERT_SQL = ALERT_SQL.replace("]), ' | '), '') AS recommendations",
                              "] AS l)) WHERE x IS NOT NULL GROUP BY x)), ' | '), '') AS recommendations")


@query("alerts", ALERT_SQL)
def q_alerts(spark, sf):
    return flat(alerts(spark, sf))


@query("threshold_status", GAPS + "SELECT series_id, date, " + ", ".join([
    _status("NDVI", 0.7, 0.6, True) + " AS ndvi_status", _status("CWSI", 0.4, 0.6) + " AS cwsi_status"])
    + " FROM daily_gaps")
def q_threshold_status(spark, sf):
    d = FX.daily_gaps(spark, sf)
    return d.select("series_id", "date", AL.threshold_status("NDVI", 0.7, 0.6, True).alias("ndvi_status"),
                    AL.threshold_status("CWSI", 0.4, 0.6).alias("cwsi_status"))


@query("latest_rows", GAPS + "SELECT series_id, date, round(NDVI, 6) AS NDVI FROM (SELECT *, row_number() OVER "
                             "(PARTITION BY series_id ORDER BY date DESC) AS rd FROM daily_gaps) WHERE rd <= 7")
def q_latest_rows(spark, sf):
    d = AL.latest_rows(FX.daily_gaps(spark, sf).select("series_id", "date", "NDVI"), 7)
    return out(d, cols=["NDVI"])


@query("trend_word", GAPS + (
    ", a AS (SELECT series_id, NDVI, CAST(count(NDVI) OVER (PARTITION BY series_id ORDER BY date ROWS BETWEEN UNBOUNDED "
    "PRECEDING AND CURRENT ROW) AS DOUBLE) AS x, row_number() OVER (PARTITION BY series_id ORDER BY date DESC) AS rd "
    "FROM daily_gaps)\nSELECT series_id, " + _trend("regr_slope(NDVI, x) FILTER (WHERE rd <= 7)",
                                                    "count(NDVI) FILTER (WHERE rd <= 7)")
    + " AS ndvi_trend FROM a GROUP BY series_id"))
def q_trend_word(spark, sf):
    a = AL.alert_inputs(FX.daily_gaps(spark, sf).select("series_id", "date", "NDVI"), F.lit("soybean"))
    return a.select("series_id", AL.trend_word(F.col("slope_ndvi"), F.col("n_ndvi")).alias("ndvi_trend"))


@query("export_alerts", "SELECT CAST(timestamp AS VARCHAR) AS timestamp, series_id AS location_id, crop_type, alert_level, "
                        "alert_score, CASE WHEN recommendations = '' THEN 0 ELSE len(string_split(recommendations, ' | ')) "
                        "END AS num_recommendations, CAST(NULL AS INTEGER) AS model_prediction_stress, "
                        "CAST(NULL AS DOUBLE) AS model_confidence FROM (" + ALERT_SQL + ")")
def q_export_alerts(spark, sf):
    """Writes the rows as CSV and as JSON files and reads both back; rows that the
    two files agree on are returned."""
    e = AL.export_alerts(alerts(spark, sf)).withColumn("alert_score", S.rnd("alert_score", 6))
    csv, json = (AL.write_alerts(e, output_path(spark, f"alerts_{kind}"), kind) for kind in ("csv", "json"))
    return csv.intersect(json)
