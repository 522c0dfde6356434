"""Registered soil and source-payload queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from verdant.operators import pixels as PX
from verdant.operators import soil as SO
from verdant.plans import sqlgen as Q
from verdant.plans.q_features import PIXEL
from verdant.plans.q_timeseries import GAPS, _daily, out
from verdant.plans.registry import query
from verdant.sources import fixtures as FX
from verdant.sources import payloads as PL

SOIL = FX.with_sql(FX.SOIL_LONG_SQL)
SK = ("location_id", "depth_label", "depth_top_cm", "depth_bottom_cm")
_WIDE = ("soil_wide AS (SELECT location_id, depth_label, depth_top_cm, depth_bottom_cm, "
         + ", ".join(f"max(CASE WHEN property = '{p}' THEN value END) AS {p}" for p in SO.SOIL_PROPERTIES)
         + " FROM soil_long GROUP BY ALL)")
_PCT = ("soil_pct AS (SELECT *, CASE WHEN coalesce(sand, 0) > 100 THEN coalesce(sand, 0) / 10 ELSE coalesce(sand, 0) END AS s_p, "
        "CASE WHEN coalesce(sand, 0) > 100 THEN coalesce(silt, 0) / 10 ELSE coalesce(silt, 0) END AS si_p, "
        "CASE WHEN coalesce(sand, 0) > 100 THEN coalesce(clay, 0) / 10 ELSE coalesce(clay, 0) END AS c_p FROM soil_wide)")
_TEX = ("CASE WHEN c_p >= 40 THEN 'Clay' WHEN c_p >= 30 THEN CASE WHEN si_p >= 40 THEN 'Silty Clay' ELSE 'Sandy Clay' END "
        "WHEN c_p >= 20 THEN CASE WHEN s_p >= 45 THEN 'Sandy Clay Loam' WHEN si_p >= 50 THEN 'Silty Clay Loam' "
        "ELSE 'Clay Loam' END WHEN si_p >= 80 THEN 'Silt' WHEN si_p >= 50 THEN 'Silt Loam' WHEN s_p >= 85 THEN 'Sand' "
        "WHEN s_p >= 70 THEN 'Loamy Sand' ELSE 'Loam' END")
_FC0 = "(0.2576 - 0.0020 * s_p + 0.0036 * c_p + 0.0299 * log10(c_p + 1))"
_WP0 = "(0.0260 + 0.0050 * c_p + 0.0158 * log10(c_p + 1))"
_FC = f"({_FC0} + (1.283 * {_FC0} * {_FC0} - 0.374 * {_FC0} - 0.015))"
_WP = f"({_WP0} + (0.002 * c_p * c_p - 0.044 * {_WP0} - 0.002))"
_AWC = f"CASE WHEN bdod IS NOT NULL THEN greatest(0.0, least(0.5, ({_FC} - {_WP}) * (1.5 - bdod / 100))) END"
_KSAT = "greatest(0.1, least(100.0, 24.0 * pow(10.0, -0.6 + 0.0126 * s_p - 0.0064 * c_p)))"
_DERIVED = f"soil_derived AS (SELECT *, {_TEX} AS texture_class, {_AWC} AS awc, {_KSAT} AS ksat FROM soil_pct)"
SOILD = SOIL.rstrip() + f",\n{_WIDE},\n{_PCT},\n{_DERIVED}\n"


def _wide(spark, sf):
    return SO.pivot_soil(FX.soil_long(spark, sf))


@query("soil_pivot", SOIL.rstrip() + f",\n{_WIDE}\nSELECT * FROM soil_wide")
def q_soil_pivot(spark, sf):
    return out(_wide(spark, sf), keep=SK)


@query("soil_texture", SOILD + "SELECT location_id, depth_label, depth_top_cm, depth_bottom_cm, texture_class FROM soil_derived")
def q_soil_texture(spark, sf):
    return out(SO.derive_soil(_wide(spark, sf)), keep=SK, cols=["texture_class"])


@query("soil_awc", SOILD + "SELECT location_id, depth_label, depth_top_cm, depth_bottom_cm, round(awc, 6) AS awc FROM soil_derived")
def q_soil_awc(spark, sf):
    return out(SO.derive_soil(_wide(spark, sf)), keep=SK, cols=["awc"])


@query("soil_ksat", SOILD + "SELECT location_id, depth_label, depth_top_cm, depth_bottom_cm, round(ksat, 6) AS ksat FROM soil_derived")
def q_soil_ksat(spark, sf):
    return out(SO.derive_soil(_wide(spark, sf)), keep=SK, cols=["ksat"])


@query("root_zone", SOIL + "SELECT location_id, property, depth_label, depth_top_cm, depth_bottom_cm, value, "
       "depth_bottom_cm <= 30 AS surface FROM soil_long WHERE depth_top_cm >= 0 AND depth_bottom_cm <= 100")
def q_root_zone(spark, sf):
    d = SO.root_zone(FX.soil_long(spark, sf))
    return out(d.withColumn("surface", F.col("depth_bottom_cm") <= 30),
               keep=("location_id", "property", "depth_label", "depth_top_cm", "depth_bottom_cm"),
               cols=["value", "surface"])


def _summary_sql():
    th = "CAST(depth_bottom_cm - depth_top_cm AS DOUBLE)"
    aggs = [f"round(sum({p} * {th}) / nullif(sum(CASE WHEN {p} IS NOT NULL THEN {th} END), 0), 6) AS {p}_weighted_avg"
            for p in SO.SUMMARY_PROPERTIES]
    aggs.append("arg_min(texture_class, depth_label) FILTER (WHERE depth_bottom_cm <= 30 AND texture_class IS NOT NULL)"
                " AS surface_texture")
    return SOILD + f"SELECT location_id, {', '.join(aggs)} FROM soil_derived WHERE depth_top_cm >= 0 " \
                   f"AND depth_bottom_cm <= 100 GROUP BY location_id"


@query("soil_root_summary", _summary_sql())
def q_soil_root_summary(spark, sf):
    return out(SO.soil_summary(SO.derive_soil(_wide(spark, sf))), keep=("location_id",))


def _union_sql():
    base = ("SELECT location_id, property, depth_label, depth_top_cm, depth_bottom_cm, value, unit, "
            "NULL::VARCHAR AS texture_class FROM soil_long")
    awc = ("SELECT location_id, 'awc', depth_label, depth_top_cm, depth_bottom_cm, awc, 'cm3/cm3', NULL "
           "FROM soil_derived WHERE awc IS NOT NULL")
    ks = ("SELECT location_id, 'ksat', depth_label, depth_top_cm, depth_bottom_cm, ksat, 'cm/day', NULL "
          "FROM soil_derived")
    tx = ("SELECT location_id, 'texture_class', depth_label, depth_top_cm, depth_bottom_cm, NULL, 'class', "
          "texture_class FROM soil_derived")
    return SOILD + f", u AS ({base} UNION ALL {awc} UNION ALL {ks} UNION ALL {tx})\n" \
                   "SELECT location_id, property, depth_label, depth_top_cm, depth_bottom_cm, round(value, 6) AS value, " \
                   "unit, texture_class FROM u"


@query("union_records", _union_sql())
def q_union_records(spark, sf):
    d = SO.union_derived(FX.soil_long(spark, sf))
    return out(d, keep=("location_id", "property", "depth_label", "depth_top_cm", "depth_bottom_cm"),
               cols=["value", "unit", "texture_class"])


# S1 ------------------------------------------------------------------------
@query("src_weather", GAPS + "SELECT series_id AS location_id, date, " + ", ".join(
    [Q.r(c) for c in ("T2M", "T2M_MAX", "T2M_MIN", "PRECTOTCORR")] + ["round(PET_PT_JPL, 6) AS EVPTRNS"])
    + " FROM daily_gaps")
def q_src_weather(spark, sf):
    d = _daily(spark, sf, ["T2M", "T2M_MAX", "T2M_MIN", "PRECTOTCORR", "PET_PT_JPL"], gaps=True)
    docs = PL.weather_payload(d)
    return out(PL.parse_weather(docs), keep=("location_id", "date"))


# S2 ------------------------------------------------------------------------
@query("src_soil", SOIL + "SELECT location_id, property, depth_label, depth_top_cm, depth_bottom_cm, "
       "round(value, 6) AS value, unit FROM soil_long")
def q_src_soil(spark, sf):
    docs = PL.soil_payload(FX.soil_long(spark, sf))
    return out(PL.parse_soil(docs), keep=("location_id", "property", "depth_label", "depth_top_cm",
                                          "depth_bottom_cm"), cols=["value", "unit"])


# S3 ------------------------------------------------------------------------
def _default_sql():
    rows = ", ".join(f"('{p}', '{lbl}', {a}, {b}, {v}, '{u}')" for p, v, u in PL.DEFAULT_SOIL
                     for lbl, a, b in PL.DEFAULT_DEPTHS)
    return SOIL + (f", dflt(property, depth_label, depth_top_cm, depth_bottom_cm, value, unit) AS (VALUES {rows}),\n"
                   "locs AS (SELECT DISTINCT 'p' || CAST(p_partkey AS VARCHAR) AS location_id FROM part "
                   "UNION SELECT 's' || CAST(s_suppkey AS VARCHAR) FROM supplier),\n"
                   "miss AS (SELECT location_id FROM locs WHERE location_id NOT IN (SELECT location_id FROM soil_long))\n"
                   "SELECT location_id, property, depth_label, depth_top_cm, depth_bottom_cm, round(value, 6) AS value, unit "
                   "FROM soil_long UNION ALL SELECT m.location_id, d.property, d.depth_label, d.depth_top_cm, "
                   "d.depth_bottom_cm, d.value, d.unit FROM miss m, dflt d")


@query("src_default_soil", _default_sql())
def q_src_default_soil(spark, sf):
    locs = FX.table(spark, sf, "part").select(F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("location_id"))
    locs = locs.unionByName(FX.table(spark, sf, "supplier").select(
        F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("location_id")))
    d = PL.fill_default_soil(FX.soil_long(spark, sf), locs)
    return out(d, keep=("location_id", "property", "depth_label", "depth_top_cm", "depth_bottom_cm"),
               cols=["value", "unit"])


# S4 ------------------------------------------------------------------------
_SBANDS = ["red", "nir", "swir"]


@query("src_scene_stats", PIXEL + "SELECT region_id, date, " + ", ".join(
    f"round(avg({b} * 0.0001), 12) AS {b}" for b in _SBANDS)
    + " FROM pixel WHERE (qa & 1024) = 0 AND (qa & 2048) = 0 GROUP BY region_id, date")
def q_src_scene_stats(spark, sf):
    p = PX.qa_mask_optical(FX.pixel(spark, sf), _SBANDS)
    means = PX.region_mean(p, _SBANDS)
    docs = PL.scene_payload(means, _SBANDS)
    return out(PL.parse_scene_stats(docs, _SBANDS), keep=("region_id", "date"), cols=_SBANDS, digits=12)
