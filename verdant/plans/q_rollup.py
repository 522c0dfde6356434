"""Registered region-dimension and national roll-up queries
(S5, X33, X34, F3, F6, A8, A12-A17, A24, T2)."""

from __future__ import annotations

from pyspark.sql import functions as F

from verdant.operators import rollup as RU
from verdant.plans.q_timeseries import DAILY, out
from verdant.plans.registry import query
from verdant.sources import fixtures as FX

RA = FX.with_sql(FX.REGION_ALERTS_SQL)
RD = FX.with_sql(FX.REGION_SQL)
_PROV = ("CASE WHEN region_id LIKE '%buenos_aires%' THEN 'Buenos Aires' WHEN region_id LIKE '%cordoba%' THEN 'Córdoba' "
         "WHEN region_id LIKE '%santa_fe%' THEN 'Santa Fe' WHEN region_id LIKE '%entre_rios%' THEN 'Entre Ríos' "
         "WHEN region_id LIKE '%la_pampa%' THEN 'La Pampa' ELSE 'Regiones Norteñas' END")
_CROPS = ("CASE WHEN region_id LIKE '%buenos_aires%' THEN 'Soja, Maíz, Trigo' WHEN region_id LIKE '%cordoba%' "
          "THEN 'Soja, Maíz, Trigo' WHEN region_id LIKE '%santa_fe%' THEN 'Soja, Maíz, Algodón' WHEN region_id LIKE "
          "'%entre_rios%' THEN 'Soja, Maíz, Arroz' WHEN region_id LIKE '%la_pampa%' THEN 'Trigo, Girasol, Maíz' "
          "ELSE 'Cultivos Diversos' END")


@query("dim_region", RD + "SELECT region_id, name, priority, region_order, round(lat0, 6) AS lat_min, "
                          "round(lat0 + 0.4, 6) AS lat_max, CASE n_regionkey WHEN 0 THEN 3 WHEN 1 THEN 2 WHEN 2 THEN 1 "
                          "WHEN 3 THEN 2 ELSE 1 END AS n_crops FROM region_dim")
def q_dim_region(spark, sf):
    r = FX.region_dim(spark, sf)
    return out(r.select("region_id", "name", "priority", "region_order",
                        F.get(F.get("geometry", 0), 1).alias("lat_min"), F.get(F.get("geometry", 2), 1).alias("lat_max"),
                        F.size("crops").alias("n_crops")), keep=(), cols=None)


@query("province_of", RD + f"SELECT region_id, {_PROV} AS province, {_CROPS} AS crops, "
                           "split_part(region_id, '_', 1) AS province_token FROM region_dim")
def q_province_of(spark, sf):
    r = FX.region_dim(spark, sf)
    return r.select("region_id", RU.province_of("region_id").alias("province"), RU.crops_text("region_id").alias("crops"),
                    RU.province_token("region_id").alias("province_token"))


@query("centroid", RD + "SELECT region_id, round((-65.05 * 3 + -61.05 * 2) / 5, 6) AS lon, "
                        "round((lat0 * 3 + (lat0 + 0.4) * 2) / 5, 6) AS lat FROM region_dim")
def q_centroid(spark, sf):
    r = FX.region_dim(spark, sf).select("region_id", RU.centroid("geometry").alias("c"))
    return out(r.select("region_id", "c.lon", "c.lat"), keep=("region_id",))


@query("priority_filter", RD + "SELECT region_id, priority FROM (SELECT * FROM region_dim WHERE priority = 'high' "
                               "ORDER BY region_order LIMIT 6)")
def q_priority_filter(spark, sf):
    r = RU.select_regions(FX.region_dim(spark, sf), priority=["high"], first_n=6)
    return r.select("region_id", "priority")


@query("success_only", RA + "SELECT region_id, alert_level, round(alert_score, 6) AS alert_score FROM region_alerts "
                            "WHERE error IS NULL")
def q_success_only(spark, sf):
    return out(RU.success_only(FX.region_alerts(spark, sf)), keep=("region_id",), cols=["alert_level", "alert_score"])


@query("national_summary", RA + (
    "SELECT count(*) AS total_regions_analyzed, count(*) FILTER (WHERE error IS NULL) AS successful_analyses, "
    "count(*) FILTER (WHERE alert_level = 'critical') AS critical_count, "
    "count(*) FILTER (WHERE alert_level = 'warning') AS warning_count, "
    "count(*) FILTER (WHERE alert_level = 'normal') AS normal_count, "
    "coalesce(string_agg(region_id, ',' ORDER BY region_id) FILTER (WHERE alert_level = 'critical'), '') AS high_priority_regions, "
    "coalesce(string_agg(name, ',' ORDER BY name) FILTER (WHERE alert_level IN ('critical', 'warning')), '') AS high_risk_regions, "
    "round(coalesce(avg(alert_score) FILTER (WHERE error IS NULL), 0.0), 6) AS average_alert_score, "
    "CASE WHEN count(*) FILTER (WHERE alert_level = 'critical') > 0 THEN 'critical' "
    "WHEN count(*) FILTER (WHERE alert_level = 'warning') > 0 THEN 'warning' ELSE 'normal' END AS overall_status "
    "FROM region_alerts"))
def q_national_summary(spark, sf):
    s = RU.national_summary(FX.region_alerts(spark, sf))
    s = s.withColumns({"high_priority_regions": F.array_join("high_priority_regions", ","),
                       "high_risk_regions": F.array_join("high_risk_regions", ",")})
    return out(s, keep=(), cols=s.columns)


_STATS_SQL = RA + (
    ", s AS (SELECT count(*) AS total_regions_attempted, count(*) FILTER (WHERE error IS NULL) AS successful_analyses, "
    "count(*) FILTER (WHERE error IS NOT NULL) AS failed_analyses, "
    "count(*) FILTER (WHERE error IS NULL AND alert_level = 'critical') AS critical_count, "
    "count(*) FILTER (WHERE error IS NULL AND alert_level = 'warning') AS warning_count, "
    "count(*) FILTER (WHERE error IS NULL AND alert_level = 'normal') AS normal_count, "
    "coalesce(avg(alert_score) FILTER (WHERE error IS NULL), 0.0) AS average_alert_score, "
    "coalesce(median(alert_score) FILTER (WHERE error IS NULL), 0.0) AS median_alert_score, "
    "coalesce(max(alert_score) FILTER (WHERE error IS NULL), 0.0) AS max_alert_score, "
    "count(*) FILTER (WHERE error IS NULL AND alert_level IN ('critical', 'warning')) AS regions_requiring_attention "
    "FROM region_alerts)\n"
    "SELECT *, CASE WHEN successful_analyses = 0 THEN 'unknown' "
    "WHEN critical_count / successful_analyses * 100 > 15 THEN 'critical' "
    "WHEN critical_count / successful_analyses * 100 > 5 OR warning_count / successful_analyses * 100 > 25 THEN 'elevated' "
    "WHEN warning_count / successful_analyses * 100 > 10 THEN 'moderate' ELSE 'normal' END AS overall_status, "
    "CASE WHEN successful_analyses > 0 THEN regions_requiring_attention / successful_analyses * 100 ELSE 0.0 END "
    "AS percentage_under_stress, CASE WHEN total_regions_attempted > 0 THEN successful_analyses / "
    "total_regions_attempted * 100 ELSE 0.0 END AS success_rate, CASE WHEN successful_analyses > "
    "total_regions_attempted * 0.8 THEN 'high' ELSE 'medium' END AS data_completeness FROM s")


def _stats_cols(keep):
    def sel(sql):
        cols = ", ".join(f"round({c}, 6) AS {c}" if c.endswith(("score", "stress", "rate")) else c for c in keep)
        return f"SELECT {cols} FROM ({sql})"
    return sel


_A13 = ["successful_analyses", "critical_count", "warning_count", "overall_status"]
_A14 = ["average_alert_score", "median_alert_score", "max_alert_score", "regions_requiring_attention",
        "percentage_under_stress", "success_rate", "data_completeness", "failed_analyses"]


@query("national_status_pct", _STATS_SQL.rsplit("\nSELECT", 1)[0] + "\n" + _stats_cols(_A13)(
    "SELECT" + _STATS_SQL.rsplit("\nSELECT", 1)[1]))
def q_national_status_pct(spark, sf):
    s = RU.national_statistics(FX.region_alerts(spark, sf))
    return out(s.select(*_A13), keep=(), cols=_A13)


@query("national_score_stats", _STATS_SQL.rsplit("\nSELECT", 1)[0] + "\n" + _stats_cols(_A14)(
    "SELECT" + _STATS_SQL.rsplit("\nSELECT", 1)[1]))
def q_national_score_stats(spark, sf):
    s = RU.national_statistics(FX.region_alerts(spark, sf))
    return out(s.select(*_A14), keep=(), cols=_A14)


@query("province_breakdown", RA + (
    f"SELECT province, count(*) FILTER (WHERE alert_level = 'critical') AS critical, "
    f"count(*) FILTER (WHERE alert_level = 'warning') AS warning, count(*) FILTER (WHERE alert_level = 'normal') AS normal, "
    f"count(*) AS total FROM (SELECT *, {_PROV} AS province FROM region_alerts WHERE error IS NULL) "
    f"GROUP BY ROLLUP (province)"))
def q_province_breakdown(spark, sf):
    return RU.province_breakdown(FX.region_alerts(spark, sf))


@query("region_ranking", RA + (
    "SELECT region_id, name, alert_level, round(alert_score, 6) AS alert_score, rank, province, crops, recommendation "
    "FROM (SELECT *, row_number() OVER (ORDER BY CASE alert_level WHEN 'critical' THEN 0 WHEN 'warning' THEN 1 ELSE 2 END, "
    f"alert_score DESC, region_id) AS rank, {_PROV} AS province, {_CROPS} AS crops, "
    "CASE alert_level WHEN 'critical' THEN 'Riego inmediato requerido' WHEN 'warning' THEN 'Monitoreo intensivo y preparar "
    "riego' WHEN 'normal' THEN 'Mantenimiento rutinario' ELSE 'Evaluar condiciones' END AS recommendation "
    "FROM region_alerts) WHERE rank <= 10"))
def q_region_ranking(spark, sf):
    r = RU.region_ranking(FX.region_alerts(spark, sf), 10)
    return out(r, keep=("region_id", "name", "alert_level"), cols=["alert_score", "rank", "province", "crops",
                                                                     "recommendation"])


@query("national_area", RA + "SELECT count(*) AS total_regions, count(*) FILTER (WHERE error IS NULL) AS "
                             "successful_regions, count(*) * 1624 AS total_area_km2 FROM region_alerts")
def q_national_area(spark, sf):
    return RU.national_area(FX.region_alerts(spark, sf))


@query("alert_summary", RA + (
    "SELECT count(*) AS total_alerts, " + ", ".join(
        f"count(*) FILTER (WHERE alert_level = '{lv}') AS {lv}_alerts" for lv in ("critical", "warning", "normal", "error"))
    + ", round(coalesce(avg(alert_score) FILTER (WHERE alert_level <> 'error'), 0.0), 6) AS average_alert_score, "
      "round(coalesce(max(alert_score) FILTER (WHERE alert_level <> 'error'), 0.0), 6) AS max_alert_score "
      "FROM region_alerts WHERE alert_date > DATE '1998-01-01' - 30"))
def q_alert_summary(spark, sf):
    s = RU.alert_summary(FX.region_alerts(spark, sf), "1998-01-01", 30)
    return out(s, keep=(), cols=s.columns)


def _lm_sql(c1, c2):
    return (f"SELECT series_id, arg_max({c1}, date) AS l1, arg_max({c2}, date) AS l2 FROM daily GROUP BY series_id")


@query("vegetation_rollup", DAILY + f", r AS ({_lm_sql('NDVI', 'NDWI_Gao')})\n"
       "SELECT count(*) AS total_regions, round(avg(l1), 6) AS avg_ndvi, round(min(l1), 6) AS min_ndvi, "
       "round(max(l1), 6) AS max_ndvi, round(avg(l2), 6) AS avg_ndwi, round(min(l2), 6) AS min_ndwi, "
       "round(max(l2), 6) AS max_ndwi FROM r")
def q_vegetation_rollup(spark, sf):
    s = RU.vegetation_rollup(FX.daily(spark, sf))
    return out(s, keep=(), cols=s.columns)


@query("climate_rollup", DAILY + f", r AS ({_lm_sql('T2M', 'PRECTOTCORR')})\n"
       "SELECT count(*) AS total_regions, round(avg(l1), 6) AS avg_temperature, round(min(l1), 6) AS min_temperature, "
       "round(max(l1), 6) AS max_temperature, round(avg(l2), 6) AS avg_precipitation, "
       "round(sum(l2), 6) AS total_precipitation FROM r")
def q_climate_rollup(spark, sf):
    s = RU.climate_rollup(FX.daily(spark, sf))
    return out(s, keep=(), cols=s.columns)


# per-region rows behind the national roll-ups (A16, A17) -------------------
def _per_region_sql(*cols):
    return ("SELECT series_id, count(*) AS data_points, " + ", ".join(
        f"round(arg_max({c}, date), 6) AS latest_{c}, round(avg({c}), 6) AS avg_{c}" for c in cols) + " FROM daily GROUP BY series_id")


@query("vegetation_by_region", DAILY + _per_region_sql("NDVI", "NDWI_Gao"))
def q_vegetation_by_region(spark, sf):
    return out(RU.latest_and_mean(FX.daily(spark, sf), ["NDVI", "NDWI_Gao"], "series_id"), keep=("series_id",))


@query("climate_by_region", DAILY + _per_region_sql("T2M", "PRECTOTCORR"))
def q_climate_by_region(spark, sf):
    return out(RU.latest_and_mean(FX.daily(spark, sf), ["T2M", "PRECTOTCORR"], "series_id"), keep=("series_id",))
