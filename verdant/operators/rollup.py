"""Provincial and national roll-ups of per-region results (SURVEY A12-A18,
A24, T2, X33, X34, F3, F6).

Inputs are per-region rows (one alert / one summary per region), i.e. the
size of the region dimension; the roll-ups are single aggregates over it.
Lists of region ids are sorted aggregates over that bounded dimension.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fixed values of the reference: province tokens found in region ids, main
# crops text per province token, ranking recommendation per alert level,
# nominal area of one analysis region (km2).
PROVINCE_BY_TOKEN = [("buenos_aires", "Buenos Aires"), ("cordoba", "Córdoba"), ("santa_fe", "Santa Fe"),
                     ("entre_rios", "Entre Ríos"), ("la_pampa", "La Pampa")]
DEFAULT_PROVINCE = "Regiones Norteñas"
CROPS_BY_TOKEN = [("buenos_aires", "Soja, Maíz, Trigo"), ("cordoba", "Soja, Maíz, Trigo"),
                  ("santa_fe", "Soja, Maíz, Algodón"), ("entre_rios", "Soja, Maíz, Arroz"),
                  ("la_pampa", "Trigo, Girasol, Maíz")]
DEFAULT_CROPS = "Cultivos Diversos"
RECOMMENDATION_BY_LEVEL = {"critical": "Riego inmediato requerido", "warning": "Monitoreo intensivo y preparar riego",
                           "normal": "Mantenimiento rutinario"}
DEFAULT_RECOMMENDATION = "Evaluar condiciones"
REGION_AREA_KM2 = 1624
LEVELS = ["critical", "warning", "normal"]


def _first_match(c: Column, table, default) -> Column:
    expr = None
    for token, value in table:
        cond = c.contains(token)
        expr = F.when(cond, value) if expr is None else expr.when(cond, value)
    return expr.otherwise(default)


def province_of(region_id) -> Column:
    """X33 province by substring of the region id."""
    return _first_match(F.col(region_id) if isinstance(region_id, str) else region_id,
                        PROVINCE_BY_TOKEN, DEFAULT_PROVINCE)


def province_token(region_id) -> Column:
    """X33 alternative rule: the first '_'-separated token."""
    c = F.col(region_id) if isinstance(region_id, str) else region_id
    return F.split(c, "_").getItem(0)


def crops_text(region_id) -> Column:
    """X33 main crops text by substring of the region id."""
    return _first_match(F.col(region_id) if isinstance(region_id, str) else region_id, CROPS_BY_TOKEN, DEFAULT_CROPS)


def centroid(ring) -> Column:
    """X34 mean of the ring's vertices (a closed ring counts its first vertex
    twice, as the reference does)."""
    r = F.col(ring) if isinstance(ring, str) else ring
    n = F.size(r)
    lon = F.aggregate(r, F.lit(0.0), lambda a, p: a + F.get(p, 0)) / n
    lat = F.aggregate(r, F.lit(0.0), lambda a, p: a + F.get(p, 1)) / n
    return F.struct(lon.alias("lon"), lat.alias("lat"))


def select_regions(regions: DataFrame, priority=None, ids=None, first_n: int | None = None,
                   order: str = "region_order") -> DataFrame:
    """F3 regions by priority list, by id list, or all; optionally the first
    ``first_n`` in configuration order."""
    out = regions
    if priority:
        out = out.where(F.col("priority").isin(list(priority)))
    if ids:
        out = out.where(F.col("region_id").isin(list(ids)))
    if first_n is not None:
        out = out.orderBy(order).limit(first_n)
    return out


def success_only(results: DataFrame) -> DataFrame:
    """F6 drop failed regions."""
    return results.where(F.col("error").isNull())


def national_summary(alerts: DataFrame) -> DataFrame:
    """A12 totals, successes, level distribution, overall status (any
    critical -> critical, any warning -> warning), critical and at-risk
    region lists, mean score of successful regions (one row)."""
    ok = F.col("error").isNull()
    g = alerts.agg(
        F.count("*").alias("total_regions_analyzed"),
        F.count_if(ok).alias("successful_analyses"),
        *[F.count_if(F.col("alert_level") == lv).alias(f"{lv}_count") for lv in LEVELS],
        F.sort_array(F.collect_list(F.when(F.col("alert_level") == "critical", F.col("region_id"))))
         .alias("high_priority_regions"),
        F.sort_array(F.collect_list(F.when(F.col("alert_level").isin("critical", "warning"), F.col("name"))))
         .alias("high_risk_regions"),
        F.coalesce(F.avg(F.when(ok, F.col("alert_score"))), F.lit(0.0)).alias("average_alert_score"))
    status = (F.when(F.col("critical_count") > 0, "critical").when(F.col("warning_count") > 0, "warning")
               .otherwise("normal"))
    return g.withColumn("overall_status", status)


def national_status_pct(n: Column, critical: Column, warning: Column) -> Column:
    """A13 status by shares of critical / warning regions."""
    cp = critical / n * 100
    wp = warning / n * 100
    return (F.when(n == 0, "unknown").when(cp > 15, "critical").when((cp > 5) | (wp > 25), "elevated")
             .when(wp > 10, "moderate").otherwise("normal"))


def national_statistics(alerts: DataFrame) -> DataFrame:
    """A13 + A14 over successful regions: status by shares, mean / median /
    max score, regions needing attention and their share, success rate,
    completeness (one row)."""
    ok = F.col("error").isNull()
    stress = ok & F.col("alert_level").isin("critical", "warning")
    g = alerts.agg(
        F.count("*").alias("total_regions_attempted"), F.count_if(ok).alias("successful_analyses"),
        F.count_if(~ok).alias("failed_analyses"),
        *[F.count_if(ok & (F.col("alert_level") == lv)).alias(f"{lv}_count") for lv in LEVELS],
        F.coalesce(F.avg(F.when(ok, F.col("alert_score"))), F.lit(0.0)).alias("average_alert_score"),
        F.coalesce(F.median(F.when(ok, F.col("alert_score"))), F.lit(0.0)).alias("median_alert_score"),
        F.coalesce(F.max(F.when(ok, F.col("alert_score"))), F.lit(0.0)).alias("max_alert_score"),
        F.count_if(stress).alias("regions_requiring_attention"))
    n = F.col("successful_analyses")
    return g.select(
        "*",
        national_status_pct(n, F.col("critical_count"), F.col("warning_count")).alias("overall_status"),
        F.when(n > 0, F.col("regions_requiring_attention") / n * 100).otherwise(0.0).alias("percentage_under_stress"),
        F.when(F.col("total_regions_attempted") > 0,
               n / F.col("total_regions_attempted") * 100).otherwise(0.0).alias("success_rate"),
        F.when(n > F.col("total_regions_attempted") * 0.8, "high").otherwise("medium").alias("data_completeness"))


def province_breakdown(alerts: DataFrame, rule: str = "substring") -> DataFrame:
    """A15 province x level counts plus total, with a national row
    (province NULL) from ROLLUP."""
    prov = province_of("region_id") if rule == "substring" else province_token("region_id")
    ok = alerts.where(F.col("error").isNull()).withColumn("province", prov)
    return ok.rollup("province").agg(*[F.count_if(F.col("alert_level") == lv).alias(lv) for lv in LEVELS],
                                     F.count("*").alias("total"))


def region_ranking(alerts: DataFrame, top: int = 10) -> DataFrame:
    """T2 rank by severity (critical, warning, other), then score desc, then
    region id; the first ``top`` rows with province, crops and the action
    text.  Each task keeps its own first ``top`` rows, and only those are merged
    and numbered."""
    sev = F.when(F.col("alert_level") == "critical", 0).when(F.col("alert_level") == "warning", 1).otherwise(2)
    order = [sev, F.desc("alert_score"), F.col("region_id")]
    w = Window.orderBy(*order)
    rec = F.element_at(F.create_map(*[x for k, v in RECOMMENDATION_BY_LEVEL.items() for x in (F.lit(k), F.lit(v))]),
                       F.col("alert_level"))
    ranked = alerts.orderBy(*order).limit(top).select("region_id", "name", "alert_level", "alert_score",
                           F.row_number().over(w).alias("rank"), province_of("region_id").alias("province"),
                           crops_text("region_id").alias("crops"),
                           F.coalesce(rec, F.lit(DEFAULT_RECOMMENDATION)).alias("recommendation"))
    return ranked


def national_area(alerts: DataFrame) -> DataFrame:
    """A24 analysed area (regions x nominal area) and successful count."""
    return alerts.agg(F.count("*").alias("total_regions"),
                      F.count_if(F.col("error").isNull()).alias("successful_regions"),
                      (F.count("*") * REGION_AREA_KM2).alias("total_area_km2"))


def latest_and_mean(daily: DataFrame, cols, key: str, ts: str = "date") -> DataFrame:
    """Per region: number of rows, latest value (by date) and mean of each
    column -- one hash aggregate with ``max_by``."""
    aggs = [F.count("*").alias("data_points")]
    for c in cols:
        aggs += [F.max_by(c, ts).alias(f"latest_{c}"), F.avg(c).alias(f"avg_{c}")]
    return daily.groupBy(key).agg(*aggs)


def vegetation_rollup(daily: DataFrame, key: str = "series_id", ndvi="NDVI", ndwi="NDWI_Gao") -> DataFrame:
    """A16 per region latest / mean NDVI and NDWI, then the national
    average / min / max of the latest values (one row)."""
    r = latest_and_mean(daily, [ndvi, ndwi], key)
    return r.agg(F.count("*").alias("total_regions"),
                 *[f(F.col(f"latest_{c}")).alias(f"{n}_{lbl}") for c, lbl in ((ndvi, "ndvi"), (ndwi, "ndwi"))
                   for f, n in ((F.avg, "avg"), (F.min, "min"), (F.max, "max"))])


def climate_rollup(daily: DataFrame, key: str = "series_id", temp="T2M", precip="PRECTOTCORR") -> DataFrame:
    """A17 per region latest temperature / rain, then national average / min
    / max temperature, average and total rain (one row)."""
    r = latest_and_mean(daily, [temp, precip], key)
    t, p = F.col(f"latest_{temp}"), F.col(f"latest_{precip}")
    return r.agg(F.count("*").alias("total_regions"), F.avg(t).alias("avg_temperature"),
                 F.min(t).alias("min_temperature"), F.max(t).alias("max_temperature"),
                 F.avg(p).alias("avg_precipitation"), F.sum(p).alias("total_precipitation"))


def irrigation_rollup(rates: DataFrame, rate: str = "irrigation_rate_mm_day") -> DataFrame:
    """A18 regions with a positive rate: mean / max / min, count, and the
    rate total times the nominal region area."""
    pos = F.col(rate) > 0
    return rates.agg(F.avg(F.when(pos, F.col(rate))).alias("avg_irrigation_rate"),
                     F.count_if(pos).alias("total_regions_requiring_irrigation"),
                     F.max(F.when(pos, F.col(rate))).alias("max_irrigation_rate"),
                     F.min(F.when(pos, F.col(rate))).alias("min_irrigation_rate"),
                     (F.coalesce(F.sum(F.when(pos, F.col(rate))), F.lit(0.0)) * REGION_AREA_KM2)
                     .alias("total_water_requirement_estimate"))


def alert_summary(alerts: DataFrame, as_of: str, days_back: int = 30, ts: str = "alert_date") -> DataFrame:
    """A8 alerts newer than ``as_of - days_back``: counts per level, mean and
    max score of non-error alerts (one row)."""
    recent = alerts.where(F.col(ts) > F.date_sub(F.lit(as_of).cast("date"), days_back))
    ne = F.col("alert_level") != "error"
    return recent.agg(F.count("*").alias("total_alerts"),
                      *[F.count_if(F.col("alert_level") == lv).alias(f"{lv}_alerts")
                        for lv in ("critical", "warning", "normal", "error")],
                      F.coalesce(F.avg(F.when(ne, F.col("alert_score"))), F.lit(0.0)).alias("average_alert_score"),
                      F.coalesce(F.max(F.when(ne, F.col("alert_score"))), F.lit(0.0)).alias("max_alert_score"))
