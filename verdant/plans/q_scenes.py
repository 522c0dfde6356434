"""Registered scene / pixel queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from verdant.operators import pixels as PX
from verdant.plans import sqlgen as Q
from verdant.plans.q_features import PIXEL, PKEYS, _psel
from verdant.plans.q_timeseries import out
from verdant.plans.registry import query
from verdant.sources import fixtures as FX

BBOX = (-64.8, -37.9, -64.2, -37.3)
BANDS = ["red", "green", "blue", "nir", "swir"]
S2_CLEAR = "(qa & 1024) = 0 AND (qa & 2048) = 0"
L8_CLEAR = "(qa & 8) = 0 AND (qa & 16) = 0"


@query("scene_filter", PIXEL + _psel(["round(red, 6) AS red", "round(nir, 6) AS nir"], where=(
    f"WHERE lon BETWEEN {BBOX[0]} AND {BBOX[2]} AND lat BETWEEN {BBOX[1]} AND {BBOX[3]} "
    "AND date >= DATE '1996-01-01' AND date < DATE '1998-01-01' AND cloud_pct < 20.0")))
def q_scene_filter(spark, sf):
    p = PX.scene_filter(FX.pixel(spark, sf), BBOX, "1996-01-01", "1998-01-01")
    return out(p, keep=PKEYS, cols=["red", "nir"])


@query("qa_mask_optical", PIXEL + _psel([Q.r(f"{b} * 0.0001", b) for b in BANDS], where=f"WHERE {S2_CLEAR}"))
def q_qa_mask_optical(spark, sf):
    p = PX.qa_mask_optical(FX.pixel(spark, sf), BANDS)
    return out(p, keep=PKEYS, cols=BANDS)


@query("qa_mask_thermal", PIXEL + _psel(
    [Q.r("red * 0.0000275 + -0.2", "red"), Q.r("nir * 0.0000275 + -0.2", "nir"),
     Q.r("st_dn * 0.00341802 + 149.0", "st_dn")], where=f"WHERE {L8_CLEAR}"))
def q_qa_mask_thermal(spark, sf):
    p = PX.qa_mask_thermal(FX.pixel(spark, sf), ["red", "nir"], ["st_dn"])
    return out(p, keep=PKEYS, cols=["red", "nir", "st_dn"])


def _union_sql():
    a = _psel(["red * 0.0001 AS red", "nir * 0.0001 AS nir", "swir * 0.0001 AS swir", "NULL::DOUBLE AS st_dn"],
              where=f"WHERE {S2_CLEAR}")
    b = _psel(["red * 0.0000275 + -0.2 AS red", "nir * 0.0000275 + -0.2 AS nir", "NULL::DOUBLE AS swir",
               "st_dn * 0.00341802 + 149.0 AS st_dn"], where=f"WHERE {L8_CLEAR}")
    return PIXEL + f", u AS ({a} UNION ALL {b})\n" + _psel([Q.r(c) for c in ("red", "nir", "swir", "st_dn")], "u")


@query("scene_union", _union_sql())
def q_scene_union(spark, sf):
    p = FX.pixel(spark, sf)
    opt = PX.qa_mask_optical(p, ["red", "nir", "swir"]).select(*PKEYS, "red", "nir", "swir")
    th = PX.qa_mask_thermal(p, ["red", "nir"], ["st_dn"]).select(*PKEYS, "red", "nir", "st_dn")
    return out(PX.scene_union(opt, th), keep=PKEYS, cols=["red", "nir", "swir", "st_dn"])


@query("median_composite", PIXEL + (
    "SELECT region_id, x, y, round(median(red * 0.0001), 6) AS red, round(median(nir * 0.0001), 6) AS nir, "
    f"round(median(swir * 0.0001), 6) AS swir FROM pixel WHERE {S2_CLEAR} AND lon BETWEEN {BBOX[0]} AND {BBOX[2]} "
    f"AND lat BETWEEN {BBOX[1]} AND {BBOX[3]} GROUP BY region_id, x, y"))
def q_median_composite(spark, sf):
    p = PX.qa_mask_optical(FX.pixel(spark, sf), ["red", "nir", "swir"])
    p = p.where(F.col("lon").between(BBOX[0], BBOX[2]) & F.col("lat").between(BBOX[1], BBOX[3]))
    return out(PX.median_composite(p, ["red", "nir", "swir"]), keep=("region_id", "x", "y"))


@query("region_mean", PIXEL + (
    "SELECT region_id, date, " + ", ".join(f"round(avg({b} * 0.0001), 12) AS {b}" for b in BANDS)
    + f", count(*) AS n_pixels FROM pixel WHERE {S2_CLEAR} GROUP BY region_id, date"))
def q_region_mean(spark, sf):
    p = PX.qa_mask_optical(FX.pixel(spark, sf), BANDS)
    return out(PX.region_mean(p, BANDS), keep=("region_id", "date"), digits=12)


# Region areas (km2) of the fixture regions, one per sampling-scale branch.
_AREA = {"A": 150000.0, "N": 20000.0, "R": 1600.0}


def _adaptive_sql():
    area = "CASE region_id " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in _AREA.items()) + " END"
    scale = f"CASE WHEN ({area}) > 100000 THEN 1000 WHEN ({area}) > 10000 THEN 500 ELSE 100 END"
    a = (f"SELECT region_id, date, {scale} AS scale_m, floor(x * 10.0 / ({scale})) AS cx, "
         f"floor(y * 10.0 / ({scale})) AS cy, red * 0.0001 AS red, nir * 0.0001 AS nir FROM pixel WHERE {S2_CLEAR}")
    b = "SELECT region_id, date, scale_m, cx, cy, avg(red) AS red, avg(nir) AS nir FROM a GROUP BY ALL"
    return PIXEL + f", a AS ({a}), b AS ({b})\n" + (
        "SELECT region_id, date, scale_m, round(avg(red), 12) AS red, round(avg(nir), 12) AS nir, "
        "count(*) AS n_cells FROM b GROUP BY region_id, date, scale_m")


@query("adaptive_scale", _adaptive_sql())
def q_adaptive_scale(spark, sf):
    p = PX.qa_mask_optical(FX.pixel(spark, sf), ["red", "nir"])
    area = F.element_at(F.create_map(*[x for k, v in _AREA.items() for x in (F.lit(k), F.lit(v))]),
                        F.col("region_id"))
    return out(PX.adaptive_region_mean(p, ["red", "nir"], area), keep=("region_id", "date", "scale_m"), digits=12)


def _season_sql():
    sy = "CASE WHEN month(date) >= 10 THEN year(date) ELSE year(date) - 1 END"
    a = _psel([f"{sy} AS sy"])
    return PIXEL + f", a AS ({a})\n" + _psel(["sy AS season_year", "'season_' || CAST(sy AS VARCHAR) AS season_key"],
                                             "a", "WHERE date >= make_date(sy, 10, 1) AND date < make_date(sy + 1, 4, 28) "
                                                  "AND sy > 2001 - 3 AND sy <= 2001")


@query("season_slices", _season_sql())
def q_season_slices(spark, sf):
    p = PX.season_slices(FX.pixel(spark, sf), 10, 4, "2001-06-01", 3)
    return out(p, keep=PKEYS, cols=["season_year", "season_key"])


RING = [[-64.905, -37.895], [-64.215, -37.805], [-64.405, -37.215], [-64.805, -37.405], [-64.905, -37.895]]


def _clip_sql():
    edges = ", ".join(f"(CAST({a[0]} AS DOUBLE), CAST({a[1]} AS DOUBLE), CAST({b[0]} AS DOUBLE), CAST({b[1]} AS DOUBLE))"
                      for a, b in zip(RING, RING[1:]))
    xs = [p[0] for p in RING]
    ys = [p[1] for p in RING]
    cand = _psel(["lon", "lat", "red"], where=f"WHERE lon BETWEEN CAST({min(xs)} AS DOUBLE) AND CAST({max(xs)} AS DOUBLE) "
                                              f"AND lat BETWEEN CAST({min(ys)} AS DOUBLE) AND CAST({max(ys)} AS DOUBLE)")
    hits = ("SELECT c.region_id, c.date, c.x, c.y, c.red, sum(CASE WHEN ((ay > lat) <> (by_ > lat)) AND "
            "(lon < (bx - ax) * (lat - ay) / (by_ - ay) + ax) THEN 1 ELSE 0 END) AS k "
            "FROM (SELECT *, row_number() OVER () AS rid FROM cand) c, e GROUP BY c.rid, c.region_id, c.date, c.x, c.y, c.red")
    return (PIXEL + f", e(ax, ay, bx, by_) AS (VALUES {edges}), cand AS ({cand}), h AS ({hits})\n"
            + _psel(["round(red, 6) AS red"], "h", "WHERE k % 2 = 1"))


@query("clip_to_area", _clip_sql())
def q_clip_to_area(spark, sf):
    ring = F.array(*[F.array(F.lit(a), F.lit(b)) for a, b in RING])
    p = PX.clip_to_area(FX.pixel(spark, sf), ring)
    return out(p, keep=PKEYS, cols=["red"])
