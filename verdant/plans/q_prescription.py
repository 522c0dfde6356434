"""Registered prescription-map queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from verdant.functions import semantics as S

from verdant.operators import interpolation as IP
from verdant.operators import prescription as PM
from verdant.operators import rollup as RU
from verdant.plans.q_timeseries import out
from verdant.plans.registry import query
from verdant.sources import fixtures as FX

RES_M = 2000.0
RES_DEG = RES_M / PM.M_PER_DEG
EFF = 0.8
RP = FX.with_sql(FX.REGION_SQL, FX.POINTS_SQL)

# --- SQL pieces -------------------------------------------------------------
_B = ("b AS (SELECT region_id, n_regionkey, CAST(-65.05 AS DOUBLE) AS minx, lat0 AS miny, CAST(-61.05 AS DOUBLE) AS maxx, "
      "lat0 + CAST(0.4 AS DOUBLE) AS maxy FROM region_dim)")
_WH = (f"wh AS (SELECT *, CAST(floor((maxx - minx) / {RES_DEG!r}) AS INTEGER) + 1 AS width, "
       f"CAST(floor((maxy - miny) / {RES_DEG!r}) AS INTEGER) + 1 AS height FROM b)")
_CELLS = ("cells AS (SELECT region_id, n_regionkey, r AS row, c AS col, "
          "CASE WHEN width = 1 THEN minx WHEN c = width - 1 THEN maxx ELSE c * ((maxx - minx) / (width - 1)) + minx END AS lon, "
          "CASE WHEN height = 1 THEN miny WHEN r = height - 1 THEN maxy ELSE r * ((maxy - miny) / (height - 1)) + miny END AS lat "
          "FROM wh, range(0, height) t1(r), range(0, width) t2(c))")
_NP = "np AS (SELECT region_id, count(*) AS npts FROM points WHERE stress IS NOT NULL GROUP BY region_id)"
_NEAR = ("near AS (SELECT c.region_id, c.row, c.col, min({'d': (c.lon - p.lon) * (c.lon - p.lon) + (c.lat - p.lat) * (c.lat - p.lat), "
         "'i': p.point_id, 's': p.stress}).s AS stress FROM cells c JOIN points p ON c.region_id = p.region_id "
         "WHERE p.stress IS NOT NULL GROUP BY c.region_id, c.row, c.col)")
_STRESS = ("cs AS (SELECT c.*, CASE WHEN coalesce(np.npts, 0) < 3 THEN 0.5 ELSE least(1.0, greatest(0.0, n.stress)) END "
           "AS stress FROM cells c LEFT JOIN np ON c.region_id = np.region_id LEFT JOIN near n "
           "ON c.region_id = n.region_id AND c.row = n.row AND c.col = n.col)")


def _rate_sql(stress="stress"):
    crop = ("CASE n_regionkey WHEN 0 THEN 'soybean' WHEN 1 THEN 'soybean' WHEN 2 THEN 'soybean' WHEN 3 THEN 'corn' "
            "ELSE 'wheat' END")
    def r(i):
        # written out here, so that a wrong rate in the operator would show
        rates = {"soybean": (0.0, 3.0, 5.0, 8.0, 12.0), "corn": (0.0, 4.0, 7.0, 10.0, 15.0), "wheat": (0.0, 2.0, 4.0, 6.0, 10.0)}
        return "CASE " + " ".join(f"WHEN ({crop}) = '{c}' THEN {v[i]}" for c, v in rates.items()) + " END"
    return (f"CASE WHEN {stress} >= 0.8 THEN ({r(4)}) / {EFF} WHEN {stress} >= 0.0 AND {stress} < 0.1 THEN ({r(0)}) / {EFF} "
            f"WHEN {stress} >= 0.1 AND {stress} < 0.3 THEN ({r(1)}) / {EFF} WHEN {stress} >= 0.3 AND {stress} < 0.6 THEN "
            f"({r(2)}) / {EFF} WHEN {stress} >= 0.6 AND {stress} < 0.8 THEN ({r(3)}) / {EFF} ELSE 0.0 END")


_ZONE = ("CASE WHEN rate >= 0.0 AND rate < 1.0 THEN 1 WHEN rate >= 1.0 AND rate < 4.0 THEN 2 WHEN rate >= 4.0 AND rate < 8.0 "
         "THEN 3 WHEN rate >= 8.0 AND rate < 12.0 THEN 4 WHEN rate >= 12.0 AND rate < 20.0 THEN 5 ELSE 0 END")
_RZ = f"rz AS (SELECT *, {_ZONE} AS zone FROM (SELECT *, {_rate_sql()} AS rate FROM cs))"
_AREA = ("area AS (SELECT region_id, (maxx - minx) * 111320.0 * cos(radians((miny + maxy) / 2)) * (maxy - miny) * 110574.0 "
         "/ 10000 AS field_area_ha FROM b)")
PRESC_SQL = RP.rstrip() + ",\n" + ",\n".join([_B, _WH, _CELLS, _NP, _NEAR, _STRESS, _RZ, _AREA]) + "\n"


# --- Spark side ---------------------------------------------------------------
def _regions(spark, sf):
    return FX.region_dim(spark, sf)


def _crop():
    return F.get(F.col("crops"), 0)


def cells(spark, sf):
    return PM.prescription(_regions(spark, sf), FX.points(spark, sf), _crop(), RES_M, EFF)


def areas(spark, sf):
    return _regions(spark, sf).select("region_id", PM.field_area_ha("geometry").alias("field_area_ha"))


@query("grid", RP.rstrip() + ",\n" + ",\n".join([_B, _WH, _CELLS]) +
       "\nSELECT region_id, row, col, round(lon, 9) AS lon, round(lat, 9) AS lat FROM cells")
def q_grid(spark, sf):
    g = PM.grid(_regions(spark, sf), RES_M)
    return out(g, keep=("region_id", "row", "col"), cols=["lon", "lat"], digits=9)


@query("spread_stress", PRESC_SQL + "SELECT region_id, row, col, round(stress, 6) AS stress FROM cs")
def q_spread_stress(spark, sf):
    g = PM.nearest_stress(PM.grid(_regions(spark, sf), RES_M), FX.points(spark, sf))
    return out(g, keep=("region_id", "row", "col"), cols=["stress"])


_IDW = """d AS (SELECT c.region_id, c.row, c.col, p.stress AS s, (c.lon - p.lon) * (c.lon - p.lon) + (c.lat - p.lat) * (c.lat - p.lat) AS d2, p.point_id
  FROM cells c JOIN points p ON c.region_id = p.region_id WHERE p.stress IS NOT NULL),
k AS (SELECT *, row_number() OVER (PARTITION BY region_id, row, col ORDER BY d2, point_id) AS r FROM d),
m AS (SELECT region_id, row, col, CASE WHEN min(d2) = 0 THEN avg(s) FILTER (WHERE d2 = 0) ELSE sum(s / d2) / sum(1 / d2) END AS s FROM (SELECT * FROM k WHERE r <= 4) GROUP BY 1, 2, 3)
"""


@query("inverse_distance_stress", RP.rstrip() + ",\n" + ",\n".join([_B, _WH, _CELLS, _NP, _IDW]) +
       "SELECT c.region_id, c.row, c.col, round(CASE WHEN coalesce(npts, 0) < 3 THEN 0.5 ELSE least(1.0, greatest(0.0, m.s)) END, 6) AS stress "
       "FROM cells c LEFT JOIN np ON c.region_id = np.region_id LEFT JOIN m ON c.region_id = m.region_id AND c.row = m.row AND c.col = m.col")
def q_inverse_distance_stress(spark, sf):
    g = IP.inverse_distance(PM.grid(_regions(spark, sf), RES_M), FX.points(spark, sf), k=4)
    return out(g, keep=("region_id", "row", "col"), cols=["stress"])


@query("irrigation_rate", PRESC_SQL + "SELECT region_id, row, col, round(rate, 6) AS rate FROM rz")
def q_irrigation_rate(spark, sf):
    return out(cells(spark, sf), keep=("region_id", "row", "col"), cols=["rate"])


@query("zones", PRESC_SQL + "SELECT region_id, row, col, zone FROM rz")
def q_zones(spark, sf):
    return out(cells(spark, sf), keep=("region_id", "row", "col"), cols=["zone"])


_ZNAME = ("CASE z WHEN 1 THEN 'No Irrigation' WHEN 2 THEN 'Light Irrigation' WHEN 3 THEN 'Moderate Irrigation' "
          "WHEN 4 THEN 'Heavy Irrigation' WHEN 5 THEN 'Critical Irrigation' END")


@query("zone_stats", PRESC_SQL + (
    ", tot AS (SELECT region_id, count(*) AS n FROM rz GROUP BY region_id), "
    "zc AS (SELECT region_id, zone, count(*) AS pc, avg(rate) AS ar FROM rz GROUP BY region_id, zone)\n"
    f"SELECT t.region_id, z AS zone, {_ZNAME} AS name, coalesce(zc.pc, 0) AS pixel_count, "
    "round(coalesce(zc.pc, 0) / t.n * 100, 6) AS area_percentage, round(coalesce(zc.ar, 0.0), 6) AS avg_irrigation_rate "
    "FROM tot t, range(1, 6) zz(z) LEFT JOIN zc ON t.region_id = zc.region_id AND zz.z = zc.zone"))
def q_zone_stats(spark, sf):
    return out(PM.zone_stats(cells(spark, sf)), keep=("region_id", "zone", "name"))


_SUMMARY_SQL = PRESC_SQL + (
    ", g AS (SELECT region_id, sum(rate) AS total, avg(rate) AS mean, max(rate) AS mx, "
    "count(*) FILTER (WHERE rate > 0) / count(*) * 100 AS pct, count(DISTINCT zone) FILTER (WHERE zone > 0) AS zp, "
    "count(*) AS n FROM rz GROUP BY region_id), "
    "dv AS (SELECT rz.region_id, sum(abs(rate - g.mean)) AS dev FROM rz JOIN g ON rz.region_id = g.region_id "
    "GROUP BY rz.region_id)\n")


@query("prescription_summary", _SUMMARY_SQL + (
    "SELECT g.region_id, round(total, 6) AS total_irrigation_volume_per_day, round(mean, 6) AS average_irrigation_rate, "
    "round(mx, 6) AS maximum_irrigation_rate, round(pct, 6) AS percentage_area_requiring_irrigation, zp AS zones_present, "
    "n AS n_cells, round(greatest(0.0, coalesce((mean * n - total) / nullif(mean * n, 0) * 100, 0.0)), 6) "
    "AS variable_rate_water_savings_percent, round(CASE WHEN mean = 0 THEN 1.0 ELSE greatest(0.0, least(1.0, "
    "1 - dev / (n * mean))) END, 6) AS irrigation_uniformity_coefficient FROM g JOIN dv ON g.region_id = dv.region_id"))
def q_prescription_summary(spark, sf):
    return out(PM.prescription_summary(cells(spark, sf)), keep=("region_id",))


# --- the default resolution of 100 m: some 50 million cells, so only summaries are returned -----
_NEAREST_100M = """
pl AS (SELECT region_id, count(*) AS npts, list({'x': lon, 'y': lat, 'i': point_id, 's': stress}) AS pts FROM points WHERE stress IS NOT NULL GROUP BY region_id),
cs AS (SELECT c.region_id, c.n_regionkey, CASE WHEN coalesce(npts, 0) < 3 THEN 0.5 ELSE least(1.0, greatest(0.0,
    list_min(list_transform(pts, lambda p: {'d': (c.lon - p.x) * (c.lon - p.x) + (c.lat - p.y) * (c.lat - p.y), 'i': p.i, 's': p.s})).s)) END AS stress
  FROM cells c LEFT JOIN pl ON c.region_id = pl.region_id)"""
_COUNTS_100M = RP.rstrip() + ",\n" + ",\n".join([
    _B, _WH.replace(repr(RES_DEG), repr(100.0 / PM.M_PER_DEG)), _CELLS, _NEAREST_100M,
    f"rz AS (SELECT *, {_ZONE} AS zone FROM (SELECT *, {_rate_sql()} AS rate FROM cs))",
    "rc AS MATERIALIZED (SELECT region_id, rate, zone, count(*) AS n FROM rz GROUP BY region_id, rate, zone)"])


def cells_100m(spark, sf):
    return PM.prescription(_regions(spark, sf), FX.points(spark, sf), _crop(), efficiency=EFF)


@query("prescription_summary_100m", _COUNTS_100M + """,
g AS (SELECT region_id, sum(rate * n) AS total, sum(rate * n) / sum(n) AS mean, max(rate) AS mx, sum(CASE WHEN rate > 0 THEN n ELSE 0 END) / sum(n) * 100 AS pct,
  count(DISTINCT zone) FILTER (WHERE zone > 0) AS zp, CAST(sum(n) AS BIGINT) AS n FROM rc GROUP BY region_id),
dv AS (SELECT rc.region_id, sum(abs(rate - mean) * rc.n) AS dev FROM rc JOIN g ON rc.region_id = g.region_id GROUP BY rc.region_id)
SELECT g.region_id, round(total, 4) AS total_irrigation_volume_per_day, round(mean, 6) AS average_irrigation_rate, round(mx, 6) AS maximum_irrigation_rate,
  round(pct, 6) AS percentage_area_requiring_irrigation, zp AS zones_present, n AS n_cells,
  round(CASE WHEN mean = 0 THEN 1.0 ELSE greatest(0.0, least(1.0, 1 - dev / (n * mean))) END, 6) AS irrigation_uniformity_coefficient
FROM g JOIN dv ON g.region_id = dv.region_id""")
def q_prescription_summary_100m(spark, sf):
    s = PM.prescription_summary(cells_100m(spark, sf)).drop("variable_rate_water_savings_percent")
    s = s.withColumn("total_irrigation_volume_per_day", S.rnd("total_irrigation_volume_per_day", 4))
    return out(s, keep=("region_id", "total_irrigation_volume_per_day"))


@query("zone_stats_100m", _COUNTS_100M + f""",
tot AS (SELECT region_id, sum(n) AS n FROM rc GROUP BY region_id),
zc AS (SELECT region_id, zone, sum(n) AS pc, sum(n * rate) / sum(n) AS ar FROM rc GROUP BY region_id, zone)
SELECT t.region_id, z AS zone, {_ZNAME} AS name, CAST(coalesce(zc.pc, 0) AS BIGINT) AS pixel_count,
  round(coalesce(zc.pc, 0) / t.n * 100, 6) AS area_percentage, round(coalesce(zc.ar, 0.0), 6) AS avg_irrigation_rate
FROM tot t CROSS JOIN range(1, 6) zz(z) LEFT JOIN zc ON t.region_id = zc.region_id AND zz.z = zc.zone""")
def q_zone_stats_100m(spark, sf):
    return out(PM.zone_stats(cells_100m(spark, sf)), keep=("region_id", "zone", "name"))


_MEAN_100M = "g AS (SELECT region_id, sum(rate * n) / sum(n) AS mean FROM rc GROUP BY region_id)"


@query("application_map_100m", _COUNTS_100M + f""", {_AREA},
ap AS (SELECT *, least(greatest(rate, 0.5), 20.0) AS applied FROM rc)
SELECT ap.region_id, round(sum(applied * n) / sum(n) * any_value(field_area_ha) * 10000, 4) AS total_volume_needed_liters,
  round(any_value(field_area_ha) / (24.0 * 15.0 / 10.0), 6) AS estimated_application_time_hours,
  round(sum(CASE WHEN rate <= 20.0 THEN n ELSE 0 END) / sum(n) * 100, 6) AS rate_achievability,
  round(sum(CASE WHEN applied > 0 THEN n ELSE 0 END) / sum(n) * 100, 6) AS coverage_efficiency, count(DISTINCT applied) FILTER (WHERE applied > 0) AS equipment_zones
FROM ap JOIN area ON ap.region_id = area.region_id GROUP BY ap.region_id""")
def q_application_map_100m(spark, sf):
    m = PM.application_map(cells_100m(spark, sf), areas(spark, sf))
    m = m.withColumn("total_volume_needed_liters", S.rnd("total_volume_needed_liters", 4))
    return out(m, keep=("region_id", "total_volume_needed_liters"))


@query("equipment_setting_100m", _COUNTS_100M + """,
z AS (SELECT region_id, least(greatest(rate, 0.5), 20.0) AS applied, CAST(sum(n) AS BIGINT) AS area_pixels FROM rc GROUP BY 1, 2)
SELECT region_id, 'zone_' || CAST(dense_rank() OVER (PARTITION BY region_id ORDER BY applied) AS VARCHAR) AS zone, round(applied, 6) AS application_rate,
  area_pixels, round(least(3.0, greatest(1.0, applied / 5.0)), 6) AS pressure_bar, round(applied * 24.0 * 15.0 / 60, 6) AS flow_rate_lpm,
  CASE WHEN applied < 10 THEN 'standard' ELSE 'high_flow' END AS nozzle_selection FROM z WHERE applied > 0""")
def q_equipment_setting_100m(spark, sf):
    z = PM.equipment_zones(cells_100m(spark, sf))
    return out(z.select("region_id", "zone", "application_rate", "area_pixels", "setting.*"), keep=("region_id", "zone"))


@query("water_requirement_100m", _COUNTS_100M + f""", {_AREA},
{_MEAN_100M}
SELECT g.region_id, round(mean * field_area_ha * 10, 4) AS daily_water_requirement_m3, round(field_area_ha, 6) AS area_ha,
  round(mean, 6) AS avg_irrigation_rate_mm_day FROM g JOIN area ON g.region_id = area.region_id""")
def q_water_requirement_100m(spark, sf):
    w = PM.water_requirement(PM.prescription_summary(cells_100m(spark, sf)), areas(spark, sf))
    w = w.withColumn("daily_water_requirement_m3", S.rnd("daily_water_requirement_m3", 4))
    return out(w, keep=("region_id", "daily_water_requirement_m3"))


@query("zone_area_totals_100m", _COUNTS_100M + f""", {_AREA},
tot AS (SELECT region_id, sum(n) AS n FROM rc GROUP BY region_id),
zc AS (SELECT region_id, zone, sum(n) AS pc FROM rc GROUP BY region_id, zone)
SELECT z AS zone, {_ZNAME} AS name, round(sum(coalesce(zc.pc, 0) / t.n * 100 / 100 * a.field_area_ha), 4) AS total_area_ha
FROM tot t JOIN area a ON t.region_id = a.region_id CROSS JOIN range(1, 6) zz(z) LEFT JOIN zc ON t.region_id = zc.region_id AND zz.z = zc.zone GROUP BY z""")
def q_zone_area_totals_100m(spark, sf):
    z = PM.zone_area_totals(PM.zone_stats(cells_100m(spark, sf)), areas(spark, sf))
    return out(z.withColumn("total_area_ha", S.rnd("total_area_ha", 4)), keep=("zone", "name", "total_area_ha"))


@query("irrigation_rollup_100m", _COUNTS_100M + f""",
{_MEAN_100M}
SELECT round(avg(mean) FILTER (WHERE mean > 0), 6) AS avg_irrigation_rate, count(*) FILTER (WHERE mean > 0) AS total_regions_requiring_irrigation,
  round(max(mean) FILTER (WHERE mean > 0), 6) AS max_irrigation_rate, round(min(mean) FILTER (WHERE mean > 0), 6) AS min_irrigation_rate,
  round(coalesce(sum(mean) FILTER (WHERE mean > 0), 0.0) * 1624, 4) AS total_water_requirement_estimate FROM g""")
def q_irrigation_rollup_100m(spark, sf):
    rates = PM.prescription_summary(cells_100m(spark, sf)).select("region_id", F.col("average_irrigation_rate").alias("irrigation_rate_mm_day"))
    r = RU.irrigation_rollup(rates)
    r = r.withColumn("total_water_requirement_estimate", S.rnd("total_water_requirement_estimate", 4))
    return out(r, keep=("total_water_requirement_estimate",), cols=[c for c in r.columns if c != "total_water_requirement_estimate"])


@query("prescription_rows_100m", _COUNTS_100M.replace("SELECT c.region_id, c.n_regionkey,", "SELECT c.region_id, c.n_regionkey, c.row, c.lon, c.lat,") + """
SELECT region_id, row, count(*) AS n_cells, round(min(lon), 9) AS west, round(max(lon), 9) AS east, round(max(lat), 9) AS lat, round(avg(stress), 6) AS mean_stress,
  round(avg(rate), 6) AS mean_rate, round(max(rate), 6) AS max_rate, count(*) FILTER (WHERE zone = 1) AS zone_1, count(*) FILTER (WHERE zone = 2) AS zone_2,
  count(*) FILTER (WHERE zone = 3) AS zone_3, count(*) FILTER (WHERE zone = 4) AS zone_4, count(*) FILTER (WHERE zone = 5) AS zone_5
FROM rz GROUP BY region_id, row""")
def q_prescription_rows_100m(spark, sf):
    """All cells of G1 to G4 and J7, J8 at 100 m, told by grid row."""
    r = PM.grid_rows(cells_100m(spark, sf))
    r = r.withColumns({c: S.rnd(c, 9) for c in ("west", "east", "lat")})
    return out(r, keep=("region_id", "row", "west", "east", "lat"))


@query("uniformity", _SUMMARY_SQL + (
    "SELECT g.region_id, round(CASE WHEN mean = 0 THEN 1.0 ELSE greatest(0.0, least(1.0, 1 - dev / (n * mean))) END, 6) "
    "AS irrigation_uniformity_coefficient FROM g JOIN dv ON g.region_id = dv.region_id"))
def q_uniformity(spark, sf):
    s = PM.prescription_summary(cells(spark, sf))
    return out(s.select("region_id", "irrigation_uniformity_coefficient"), keep=("region_id",))


@query("application_map", PRESC_SQL + (
    ", ap AS (SELECT *, least(greatest(rate, 0.5), 20.0) AS applied FROM rz)\n"
    "SELECT ap.region_id, round(sum(applied) * any_value(field_area_ha) / count(*) * 10000, 6) AS total_volume_needed_liters, "
    "round(any_value(field_area_ha) / (24.0 * 15.0 / 10.0), 6) AS estimated_application_time_hours, "
    "round(avg(CASE WHEN rate <= 20.0 THEN 1.0 ELSE 0.0 END) * 100, 6) AS rate_achievability, "
    "round(avg(CASE WHEN applied > 0 THEN 1.0 ELSE 0.0 END) * 100, 6) AS coverage_efficiency, "
    "count(DISTINCT applied) FILTER (WHERE applied > 0) AS equipment_zones "
    "FROM ap JOIN area ON ap.region_id = area.region_id GROUP BY ap.region_id"))
def q_application_map(spark, sf):
    return out(PM.application_map(cells(spark, sf), areas(spark, sf)), keep=("region_id",))


@query("equipment_setting", PRESC_SQL + (
    ", ap AS (SELECT region_id, least(greatest(rate, 0.5), 20.0) AS applied FROM rz), "
    "z AS (SELECT region_id, applied, count(*) AS area_pixels FROM ap WHERE applied > 0 GROUP BY region_id, applied)\n"
    "SELECT region_id, 'zone_' || CAST(dense_rank() OVER (PARTITION BY region_id ORDER BY applied) AS VARCHAR) AS zone, "
    "round(applied, 6) AS application_rate, area_pixels, round(least(3.0, greatest(1.0, applied / 5.0)), 6) AS pressure_bar, "
    "round(applied * 24.0 * 15.0 / 60, 6) AS flow_rate_lpm, CASE WHEN applied < 10 THEN 'standard' ELSE 'high_flow' END "
    "AS nozzle_selection FROM z"))
def q_equipment_setting(spark, sf):
    z = PM.equipment_zones(cells(spark, sf))
    z = z.select("region_id", "zone", "application_rate", "area_pixels", "setting.*")
    return out(z, keep=("region_id", "zone"))


@query("water_requirement", PRESC_SQL + (
    ", g AS (SELECT region_id, avg(rate) AS mean FROM rz GROUP BY region_id)\n"
    "SELECT g.region_id, round(mean * field_area_ha * 10, 6) AS daily_water_requirement_m3, round(field_area_ha, 6) AS area_ha, "
    "round(mean, 6) AS avg_irrigation_rate_mm_day FROM g JOIN area ON g.region_id = area.region_id"))
def q_water_requirement(spark, sf):
    s = PM.prescription_summary(cells(spark, sf))
    return out(PM.water_requirement(s, areas(spark, sf)), keep=("region_id",))


@query("zone_area_totals", PRESC_SQL + (
    ", tot AS (SELECT region_id, count(*) AS n FROM rz GROUP BY region_id), "
    "zc AS (SELECT region_id, zone, count(*) AS pc FROM rz GROUP BY region_id, zone)\n"
    f"SELECT z AS zone, {_ZNAME} AS name, round(sum(coalesce(zc.pc, 0) / t.n * 100 / 100 * a.field_area_ha), 6) AS total_area_ha "
    "FROM tot t JOIN area a ON t.region_id = a.region_id, range(1, 6) zz(z) LEFT JOIN zc ON t.region_id = zc.region_id "
    "AND zz.z = zc.zone GROUP BY z"))
def q_zone_area_totals(spark, sf):
    return out(PM.zone_area_totals(PM.zone_stats(cells(spark, sf)), areas(spark, sf)), keep=("zone", "name"))


@query("irrigation_rollup", PRESC_SQL + (
    ", g AS (SELECT region_id, avg(rate) AS r FROM rz GROUP BY region_id)\n"
    "SELECT round(avg(r) FILTER (WHERE r > 0), 6) AS avg_irrigation_rate, count(*) FILTER (WHERE r > 0) AS "
    "total_regions_requiring_irrigation, round(max(r) FILTER (WHERE r > 0), 6) AS max_irrigation_rate, "
    "round(min(r) FILTER (WHERE r > 0), 6) AS min_irrigation_rate, round(coalesce(sum(r) FILTER (WHERE r > 0), 0.0) * 1624, 6) "
    "AS total_water_requirement_estimate FROM g"))
def q_irrigation_rollup(spark, sf):
    s = PM.prescription_summary(cells(spark, sf)).select(
        "region_id", F.col("average_irrigation_rate").alias("irrigation_rate_mm_day"))
    r = RU.irrigation_rollup(s)
    return out(r, keep=(), cols=r.columns)


@query("prescription", PRESC_SQL + "SELECT region_id, row, col, round(lon, 9) AS lon, round(lat, 9) AS lat, "
       "round(stress, 6) AS stress, round(rate, 6) AS rate, zone FROM rz")
def q_prescription(spark, sf):
    c = cells(spark, sf).select("region_id", "row", "col", "lon", "lat", "stress", "rate", "zone")
    c = c.withColumns({"lon": S.rnd("lon", 9), "lat": S.rnd("lat", 9)})
    return out(c, keep=("region_id", "row", "col", "lon", "lat"))
