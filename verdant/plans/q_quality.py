"""Registered data-quality queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from verdant.operators import features as FE
from verdant.operators import quality as QA
from verdant.plans import sqlgen as Q
from verdant.plans.q_timeseries import GAPS, out
from verdant.plans.registry import query
from verdant.sources import fixtures as FX

# Validation inputs: the gap fixture with values moved outside their plausible
# ranges, so that rules fire on some series and not on others (the gap rules
# have a unit test of their own).
def sat_input(spark, sf):
    d = FX.daily_gaps(spark, sf)
    return d.select("series_id", "date", (F.col("NDVI") * 2 - 0.5).alias("NDVI"), "NDWI_Gao", "EVI", "SAVI")


SAT_SQL = "sat AS (SELECT series_id, date, NDVI * 2 - 0.5 AS NDVI, NDWI_Gao, EVI, SAVI FROM daily_gaps)"


def wx_input(spark, sf):
    d = FX.daily_gaps(spark, sf)
    p = F.col("PRECTOTCORR") * 50 - F.when(F.col("series_id").startswith("A"), 5.0).otherwise(0.0)
    return d.select("series_id", "date", (F.col("T2M") * 2).alias("T2M"), p.alias("PRECTOTCORR"))


WX_SQL = ("wx AS (SELECT series_id, date, T2M * 2 AS T2M, PRECTOTCORR * 50 - CASE WHEN series_id LIKE 'A%' "
          "THEN 5.0 ELSE 0.0 END AS PRECTOTCORR FROM daily_gaps)")


def _joined(col):
    return F.array_join(col, " | ")


def sat_verdicts(spark, sf):
    return QA.validate_satellite(sat_input(spark, sf))


_OUTC = ["NDVI", "NDWI_Gao", "EVI", "SAVI"]


def _sat_sql_body():
    q = ", ".join(f"quantile_cont({c}, 0.25) OVER (PARTITION BY series_id) AS q1_{c}, "
                  f"quantile_cont({c}, 0.75) OVER (PARTITION BY series_id) AS q3_{c}" for c in _OUTC)
    a = f"SELECT *, date - lag(date) OVER (PARTITION BY series_id ORDER BY date) AS gap, {q} FROM sat"
    nulls = " + ".join(f"count(*) FILTER (WHERE {c} IS NULL)" for c in ["date"] + _OUTC)
    outl = ", ".join(f"count(*) FILTER (WHERE {c} < q1_{c} - 3 * (q3_{c} - q1_{c}) OR {c} > q3_{c} + 3 * "
                     f"(q3_{c} - q1_{c})) AS outliers_{c}" for c in _OUTC)
    b = (f"SELECT series_id, count(*) AS n, count(*) FILTER (WHERE NDVI < -1 OR NDVI > 1) AS ndvi_out_of_range, "
         f"count(*) FILTER (WHERE NDWI_Gao < -1 OR NDWI_Gao > 1) AS ndwi_out_of_range, ({nulls}) AS n_null, "
         f"max(gap) AS max_temporal_gap_days, {outl} FROM a GROUP BY series_id")
    c = f"SELECT *, n_null / (n * 5.0) * 100 AS pct FROM b"
    fo = {k: f"outliers_{k} > n * 0.1" for k in _OUTC}
    score = ("1.0 * CASE WHEN ndvi_out_of_range > 0 THEN 1 - ndvi_out_of_range / n * 0.5 ELSE 1.0 END "
             "* CASE WHEN ndwi_out_of_range > 0 THEN 1 - ndwi_out_of_range / n * 0.5 ELSE 1.0 END "
             "* CASE WHEN pct <= 50 AND pct > 20 THEN 1 - pct / 100 * 0.3 ELSE 1.0 END "
             "* CASE WHEN n > 1 AND max_temporal_gap_days > 30 THEN 0.9 ELSE 1.0 END "
             + " ".join(f"* CASE WHEN {fo[k]} THEN 0.95 ELSE 1.0 END" for k in _OUTC))
    dd = f"SELECT *, {score} AS quality_score FROM c"
    warn = ("concat_ws(' | ', CASE WHEN ndvi_out_of_range > 0 THEN ndvi_out_of_range || ' NDVI values out of range [-1, 1]' END, "
            "CASE WHEN ndwi_out_of_range > 0 THEN ndwi_out_of_range || ' NDWI values out of range [-1, 1]' END, "
            "CASE WHEN pct <= 50 AND pct > 20 THEN 'High missing data: ' || printf('%.1f', pct) || '%' END, "
            "CASE WHEN n > 1 AND max_temporal_gap_days > 30 THEN 'Large temporal gap: ' || max_temporal_gap_days || '.0 days' END, "
            + ", ".join(f"CASE WHEN {fo[k]} THEN 'High outlier count in {k}: ' || outliers_{k} END" for k in _OUTC) + ")")
    err = ("concat_ws(' | ', CASE WHEN pct > 50 THEN 'Excessive missing data: ' || printf('%.1f', pct) || '%' END, "
           "CASE WHEN quality_score < 0.5 THEN 'Overall data quality too low' END)")
    return f"a AS ({a}), b AS ({b}), c AS ({c}), dd AS ({dd}), v AS (SELECT *, {warn} AS warnings, {err} AS errors FROM dd)"


SAT_V_SQL = GAPS.rstrip() + f", {SAT_SQL}, " + _sat_sql_body()


@query("validate_satellite", SAT_V_SQL + "\nSELECT series_id, errors = '' AS is_valid, round(quality_score, 6) AS quality_score, "
       "warnings, errors, round(pct, 6) AS missing_data_percentage, max_temporal_gap_days, ndvi_out_of_range, "
       "ndwi_out_of_range, " + ", ".join(f"outliers_{k}" for k in _OUTC) + " FROM v")
def q_validate_satellite(spark, sf):
    v = sat_verdicts(spark, sf)
    v = v.withColumns({"warnings": _joined("warnings"), "errors": _joined("errors")})
    return out(v, keep=("series_id",), cols=["is_valid", "quality_score", "warnings", "errors",
                                             "missing_data_percentage", "max_temporal_gap_days",
                                             "ndvi_out_of_range", "ndwi_out_of_range"]
               + [f"outliers_{k}" for k in _OUTC])


def _wx_sql():
    a = "SELECT *, date - lag(date) OVER (PARTITION BY series_id ORDER BY date) AS gap FROM wx"
    b = ("SELECT series_id, count(*) AS n, max(gap) AS max_gap_days, min(T2M) AS temp_min, max(T2M) AS temp_max, "
         "max(PRECTOTCORR) AS max_daily_precipitation, count(*) FILTER (WHERE PRECTOTCORR < 0) AS negative_precipitation "
         "FROM a GROUP BY series_id")
    ft = "(temp_min < -40 OR temp_max > 60)"
    fr = "(max_daily_precipitation > 200)"
    fg = "(n > 1 AND max_gap_days > 5)"
    warn = (f"concat_ws(' | ', CASE WHEN {ft} THEN 'Extreme temperatures: ' || CAST(temp_min AS VARCHAR) || '°C to ' "
            f"|| CAST(temp_max AS VARCHAR) || '°C' END, CASE WHEN {fr} THEN 'Extreme precipitation: ' || "
            f"CAST(max_daily_precipitation AS VARCHAR) || ' mm/day' END, CASE WHEN {fg} THEN "
            f"'Weather data gaps up to ' || max_gap_days || '.0 days' END)")
    err = "concat_ws(' | ', CASE WHEN negative_precipitation > 0 THEN negative_precipitation || ' negative precipitation values' END)"
    score = (f"1.0 * CASE WHEN {ft} THEN 0.9 ELSE 1.0 END * CASE WHEN {fr} THEN 0.95 ELSE 1.0 END "
             f"* CASE WHEN {fg} THEN 0.9 ELSE 1.0 END")
    return (GAPS.rstrip() + f", {WX_SQL}, a AS ({a}), b AS ({b})\n"
            f"SELECT series_id, negative_precipitation = 0 AS is_valid, round({score}, 6) AS quality_score, "
            f"{warn} AS warnings, {err} AS errors, max_gap_days, round(temp_min, 6) AS temp_min, "
            f"round(temp_max, 6) AS temp_max, round(max_daily_precipitation, 6) AS max_daily_precipitation, "
            f"negative_precipitation FROM b")


@query("validate_weather", _wx_sql())
def q_validate_weather(spark, sf):
    v = QA.validate_weather(wx_input(spark, sf))
    v = v.withColumns({"warnings": _joined("warnings"), "errors": _joined("errors")})
    return out(v, keep=("series_id",), cols=["is_valid", "quality_score", "warnings", "errors", "max_gap_days",
                                             "temp_min", "temp_max", "max_daily_precipitation",
                                             "negative_precipitation"])


_MFEATS = list(FX.DAILY_VALUE_COLS)


def _model_sql():
    lab = ("CAST(CASE WHEN ({n}) >= 3 THEN 2 WHEN ({n}) >= 1 THEN 1 ELSE 0 END AS DOUBLE)").format(
        n=" + ".join(Q.flag(c) for c in ("NDVI < 0.6", "NDWI_Gao < 0.3", "T2M_MAX > 35", "CWSI > 0.4")))
    m = f"m AS (SELECT series_id, {', '.join(_MFEATS)}, {lab} AS label FROM daily_gaps)"
    pairs = [(a, b) for i, a in enumerate(_MFEATS) for b in _MFEATS[i + 1:]]
    high = (" + ".join(f"CASE WHEN abs(corr({a}, {b})) > 0.95 THEN 2 ELSE 0 END" for a, b in pairs) + " + "
            + " + ".join(f"CASE WHEN stddev_samp({c}) > 0 THEN 1 ELSE 0 END" for c in _MFEATS) + f" - {len(_MFEATS)}")
    nulls = " + ".join(f"count(*) FILTER (WHERE {c} IS NULL)" for c in _MFEATS)
    b = (f"SELECT series_id, count(*) AS n, ({nulls}) AS n_null, avg(label) AS target_mean, stddev_samp(label) AS "
         f"target_std, min(label) AS target_min, max(label) AS target_max, count(DISTINCT label) + CASE WHEN "
         f"count(*) FILTER (WHERE label IS NULL) > 0 THEN 1 ELSE 0 END AS target_unique, ({high}) AS hc FROM m "
         f"GROUP BY series_id")
    c = f"SELECT *, n_null / (n * {len(_MFEATS)}.0) * 100 AS pct FROM b"
    fc = f"hc > {len(_MFEATS) * 0.5}"
    warn = (f"concat_ws(' | ', CASE WHEN pct <= 30 AND pct > 10 THEN 'High missing data: ' || printf('%.1f', pct) || '%' END, "
            f"CASE WHEN {fc} THEN 'Many highly correlated features: ' || hc END)")
    err = ("concat_ws(' | ', CASE WHEN pct > 30 THEN 'Excessive missing data: ' || printf('%.1f', pct) || '%' END, "
           "CASE WHEN target_unique = 1 THEN 'Target variable has no variation' END)")
    score = f"1.0 * CASE WHEN pct <= 30 AND pct > 10 THEN 0.9 ELSE 1.0 END * CASE WHEN {fc} THEN 0.8 ELSE 1.0 END"
    return (GAPS.rstrip() + f", {m}, b AS ({b}), c AS ({c})\n"
            f"SELECT series_id, {err} = '' AS is_valid, round({score}, 6) AS quality_score, {warn} AS warnings, "
            f"{err} AS errors, round(pct, 6) AS missing_data_percentage, round(target_mean, 6) AS target_mean, "
            f"round(target_std, 6) AS target_std, target_min, target_max, target_unique, hc AS highly_correlated_pairs FROM c")


def model_input(spark, sf):
    d = FX.daily_gaps(spark, sf)
    d = FE.stress_label(d, "label").withColumn("label", F.col("label").cast("double"))
    return d.select("series_id", *_MFEATS, "label")


@query("validate_model_inputs", _model_sql())
def q_validate_model_inputs(spark, sf):
    v = QA.validate_model_inputs(model_input(spark, sf), _MFEATS, "label")
    v = v.withColumns({"warnings": _joined("warnings"), "errors": _joined("errors")})
    return out(v, keep=("series_id",), cols=["is_valid", "quality_score", "warnings", "errors",
                                             "missing_data_percentage", "target_mean", "target_std", "target_min",
                                             "target_max", "target_unique", "highly_correlated_pairs"])


@query("top_issues", SAT_V_SQL + (
    "\n, msgs AS (SELECT unnest(string_split(warnings, ' | ')) AS message FROM v WHERE warnings <> '' "
    "UNION ALL SELECT unnest(string_split(errors, ' | ')) FROM v WHERE errors <> '')\n"
    "SELECT message, count(*) AS count FROM msgs GROUP BY message ORDER BY count DESC, message LIMIT 5"))
def q_top_issues(spark, sf):
    return QA.top_issues(sat_verdicts(spark, sf), ("warnings", "errors"), 5)


@query("quality_report", SAT_V_SQL + (
    "\nSELECT count(*) AS total_validations, count(*) FILTER (WHERE errors = '') AS passed_validations, "
    "count(*) FILTER (WHERE errors <> '') AS failed_validations, round(avg(quality_score), 6) AS average_quality_score, "
    "concat_ws(' | ', CASE WHEN avg(quality_score) < 0.7 THEN 'Overall data quality is low - review data collection "
    "processes' END, CASE WHEN bool_or(lower(warnings || errors) LIKE '%missing data%') THEN 'Address missing data "
    "through improved collection or interpolation' END, CASE WHEN bool_or(lower(warnings || errors) LIKE '%outlier%') "
    "THEN 'Implement outlier detection and correction procedures' END) AS recommendations FROM v"))
def q_quality_report(spark, sf):
    r = QA.quality_report(sat_verdicts(spark, sf))
    r = r.withColumn("recommendations", _joined("recommendations"))
    return out(r, keep=(), cols=r.columns)
