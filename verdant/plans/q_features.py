"""Registered projection / feature queries."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from verdant.functions import calendar as CAL
from verdant.functions import indices as IX
from verdant.functions import semantics as S
from verdant.operators import features as FE
from verdant.operators import timeseries as TSO
from verdant.plans import sqlgen as Q
from verdant.plans.q_timeseries import DAILY, GAPS, _daily, _sel, out
from verdant.plans.registry import query
from verdant.sources import dims as D
from verdant.sources import fixtures as FX

PIXEL = FX.with_sql(FX.PIXEL_SQL)
PKEYS = ("region_id", "date", "x", "y")


def _psel(exprs, src="pixel", where=""):
    return f"SELECT region_id, date, x, y, {', '.join(exprs)} FROM {src} {where}"


def _nd(a, b):
    return f"({a} - {b}) / nullif({a} + {b}, 0)"


# X1-X6 ---------------------------------------------------------------------
_SIMPLE = {
    "ndvi": ("NDVI", lambda: IX.ndvi("red", "nir"), _nd("nir", "red")),
    "gndvi": ("GNDVI", lambda: IX.gndvi("green", "nir"), _nd("nir", "green")),
    "ndwi": ("NDWI_McFeeters", lambda: IX.ndwi("green", "nir"), _nd("green", "nir")),
    "ndwi_gao": ("NDWI_Gao", lambda: IX.ndwi_gao("nir", "swir"), _nd("nir", "swir")),
    "evi": ("EVI", lambda: IX.evi("blue", "red", "nir"),
            "2.5 * ((nir - red) / nullif(nir + 6.0 * red - 7.5 * blue + 1.0, 0))"),
    "savi": ("SAVI", lambda: IX.savi("red", "nir"), "(1.5 * (nir - red)) / nullif(nir + red + 0.5, 0)"),
}


def _register_simple(name, colname, expr_fn, sql):
    @query(name, PIXEL + _psel([Q.r(sql, colname)]))
    def _q(spark, sf):
        p = FX.pixel(spark, sf)
        return out(p.withColumn(colname, expr_fn()), keep=PKEYS, cols=[colname])
    return _q


for _n, (_c, _f, _s) in _SIMPLE.items():
    _register_simple(_n, _c, _f, _s)


# X9 ------------------------------------------------------------------------
_STACK = ["NDVI", "GNDVI", "NDWI_McFeeters", "NDWI_Gao", "EVI", "SAVI", "LAI"]


@query("index_stack", PIXEL + ", s AS (" + _psel(
    [f"{_nd('nir', 'red')} AS NDVI", f"{_nd('nir', 'green')} AS GNDVI", f"{_nd('green', 'nir')} AS NDWI_McFeeters",
     f"{_nd('nir', 'swir')} AS NDWI_Gao", f"{_SIMPLE['evi'][2]} AS EVI", f"{_SIMPLE['savi'][2]} AS SAVI"]) + ")\n"
    + _psel([Q.r(c) for c in _STACK[:-1]] +
            ["round(CASE WHEN NDVI > 0 AND NDVI < 0.95 THEN 2.5 * NDVI / (1.0 - NDVI) END, 6) AS LAI"], "s"))
def q_index_stack(spark, sf):
    p = FX.pixel(spark, sf)
    return out(IX.index_stack(p, blue="blue", green="green", red="red", nir="nir", swir1="swir"),
               keep=PKEYS, cols=_STACK)


# X7 ------------------------------------------------------------------------
_E = "0.6108 * exp(17.27 * {t} / ({t} + 237.3))"
_VPD_SQL = f"(({_E.format(t='T2M_MAX')} + {_E.format(t='T2M_MIN')}) / 2 - {_E.format(t='T2M_MIN')})"


def _cwsi_sql():
    a = _sel("daily_gaps", [f"T2M_MAX - T2M AS dt", f"{_VPD_SQL} * 3.0 AS up", f"{_VPD_SQL} * 0.5 - 2.0 AS lo"])
    return GAPS + f", a AS ({a})\n" + _sel("a", [Q.r("CASE WHEN (dt - lo) / nullif(up - lo, 0) IS NOT NULL THEN "
                                                     "least(greatest((dt - lo) / nullif(up - lo, 0), 0.0), 1.0) END",
                                                     "CWSI_thermal")])


@query("cwsi", _cwsi_sql())
def q_cwsi(spark, sf):
    d = _daily(spark, sf, ["T2M_MAX", "T2M_MIN", "T2M"], gaps=True)
    d = d.withColumn("VPD", IX.vpd("T2M_MAX", "T2M_MIN"))
    return out(d.withColumn("CWSI_thermal", IX.cwsi("T2M_MAX", "T2M", "VPD")), cols=["CWSI_thermal"])


# X8 ------------------------------------------------------------------------
def _lai_sql():
    k = ("CASE " + " ".join(f"WHEN crop = '{c}' THEN {v}" for c, v in IX.LAI_K.items())
         + f" ELSE {IX.LAI_K_DEFAULT} END")
    a = _sel("daily_gaps", ["NDVI", f"{FX.SERIES_CROP_SQL} AS crop"])
    raw = f"CASE WHEN NDVI > 0 AND NDVI < 0.95 THEN ({k}) * NDVI / (1.0 - NDVI) END"
    return GAPS + f", a AS ({a})\n" + _sel("a", ["crop", Q.r(f"CASE WHEN {raw} IS NOT NULL THEN least(greatest({raw}, 0.0), 8.0) END", "LAI")])


@query("lai", _lai_sql())
def q_lai(spark, sf):
    d = _daily(spark, sf, ["NDVI"], gaps=True).withColumn("crop", FX.series_crop())
    return out(d.withColumn("LAI", IX.lai("NDVI", F.col("crop"))), cols=["crop", "LAI"])


# X10 / X11 -----------------------------------------------------------------
@query("vpd", GAPS + _sel("daily_gaps", [Q.r(_VPD_SQL, "VPD")]))
def q_vpd(spark, sf):
    d = _daily(spark, sf, ["T2M_MAX", "T2M_MIN"], gaps=True)
    return out(d.withColumn("VPD", IX.vpd("T2M_MAX", "T2M_MIN")), cols=["VPD"])


def _gdd_sql():
    bases = (8, 10, 12, 15)
    a = _sel("daily_gaps", [f"CASE WHEN T2M_MAX IS NOT NULL AND T2M_MIN IS NOT NULL THEN "
                            f"greatest((T2M_MAX + T2M_MIN) / 2 - {b}, 0.0) END AS g{b}" for b in bases])
    return GAPS + f", a AS ({a})\n" + _sel("a", [Q.r(f"g{b}", f"gdd_base_{b}") for b in bases] +
                                           [Q.r(Q.cumsum(f"g{b}"), f"gdd_cumsum_{b}") for b in bases])


@query("gdd", _gdd_sql())
def q_gdd(spark, sf):
    d = _daily(spark, sf, ["T2M_MAX", "T2M_MIN"], gaps=True)
    bases = (8, 10, 12, 15)
    return out(FE.gdd_multi(d, bases), cols=[f"gdd_base_{b}" for b in bases] + [f"gdd_cumsum_{b}" for b in bases])


# X12 -----------------------------------------------------------------------
def _wx_sql():
    a = _sel("daily_gaps", ["PRECTOTCORR", "T2M_MAX", "T2M_MIN", "PET_PT_JPL AS EVPTRNS"])
    outs = [Q.r(_VPD_SQL + " * CASE WHEN T2M_MAX IS NULL THEN NULL ELSE 1 END", "VPD"),
            Q.r("CASE WHEN T2M_MAX IS NOT NULL THEN greatest((T2M_MAX + T2M_MIN) / 2 - 10.0, 0.0) END", "GDD"),
            Q.r(Q.roll("sum", "PRECTOTCORR", 7), "PRECIP_CUMULATIVE_7D"),
            Q.r(Q.roll("sum", "PRECTOTCORR", 30), "PRECIP_CUMULATIVE_30D"),
            Q.flag("T2M_MAX > 32") + " AS HEAT_STRESS_DAYS",
            Q.r("PRECTOTCORR - EVPTRNS", "WATER_BALANCE"),
            Q.r(Q.cumsum("PRECTOTCORR - EVPTRNS"), "WATER_BALANCE_CUMULATIVE")]
    return GAPS + f", a AS ({a})\n" + _sel("a", outs)


@query("weather_derived", _wx_sql())
def q_weather_derived(spark, sf):
    d = _daily(spark, sf, ["PRECTOTCORR", "T2M_MAX", "T2M_MIN", "T2M", "PET_PT_JPL"], gaps=True)
    d = d.withColumnRenamed("PET_PT_JPL", "EVPTRNS")
    cols = ["VPD", "GDD", "PRECIP_CUMULATIVE_7D", "PRECIP_CUMULATIVE_30D", "HEAT_STRESS_DAYS",
            "WATER_BALANCE", "WATER_BALANCE_CUMULATIVE"]
    return out(IX.weather_derived(d), cols=cols)


# X16-X19 -------------------------------------------------------------------
_MONTH_SEASON_SQL = ("CASE WHEN month(date) IN (12, 1, 2) THEN '{0}' WHEN month(date) IN (3, 4, 5) THEN '{1}' "
                     "WHEN month(date) IN (6, 7, 8) THEN '{2}' ELSE '{3}' END")


@query("calendar", DAILY + _sel("daily", [
    "year(date) AS year", "month(date) AS month", "day(date) AS day", "dayofyear(date) AS day_of_year",
    "weekofyear(date) AS week_of_year", "quarter(date) AS quarter",
    Q.flag("isodow(date) IN (6, 7)") + " AS is_weekend",
    _MONTH_SEASON_SQL.format("summer", "autumn", "winter", "spring") + " AS season",
    "CAST(date - DATE '2000-01-01' AS INTEGER) AS days_since_epoch"]))
def q_calendar(spark, sf):
    d = CAL.temporal_features(_daily(spark, sf, []))
    return out(d, cols=["year", "month", "day", "day_of_year", "week_of_year", "quarter", "is_weekend",
                        "season", "days_since_epoch"])


_CAL_FLAGS = {**CAL.CROP_SEASON_MONTHS, **CAL.CROP_CALENDAR_MONTHS}


@query("crop_calendar", DAILY + _sel("daily", [
    Q.flag(f"month(date) IN ({', '.join(map(str, v))})") + f" AS {k}" for k, v in _CAL_FLAGS.items()]))
def q_crop_calendar(spark, sf):
    d = _daily(spark, sf, []).withColumn("month", F.month("date"))
    return out(CAL.crop_calendar(d), cols=list(_CAL_FLAGS))


_TP = 2 * math.pi


@query("cyclical", DAILY + _sel("daily", [
    Q.r(f"sin({_TP} * month(date) / 12)", "month_sin"), Q.r(f"cos({_TP} * month(date) / 12)", "month_cos"),
    Q.r(f"sin({_TP} * dayofyear(date) / 365)", "day_of_year_sin"),
    Q.r(f"cos({_TP} * dayofyear(date) / 365)", "day_of_year_cos"),
    Q.r(f"sin({_TP} * weekofyear(date) / 52)", "week_sin"), Q.r(f"cos({_TP} * weekofyear(date) / 52)", "week_cos")]))
def q_cyclical(spark, sf):
    d = _daily(spark, sf, []).withColumns({"month": F.month("date"), "day_of_year": F.dayofyear("date"),
                                           "week_of_year": F.weekofyear("date")})
    return out(CAL.cyclical(d), cols=["month_sin", "month_cos", "day_of_year_sin", "day_of_year_cos",
                                      "week_sin", "week_cos"])


@query("season_code", DAILY + _sel("daily", [
    "CAST(" + _MONTH_SEASON_SQL.format(1, 2, 3, 4).replace("'", "") + " AS INTEGER) AS season"]))
def q_season_code(spark, sf):
    d = _daily(spark, sf, [])
    return out(d.withColumn("season", CAL.season_code(F.month("date"))), cols=["season"])


# X20 / X21 -----------------------------------------------------------------
def _span_sql(a, b, m="month(date)"):
    return f"({m} BETWEEN {a} AND {b})" if a <= b else f"({m} >= {a} OR {m} <= {b})"


def _gs_sql():
    cases = " ".join(f"WHEN crop = '{c}' THEN {_span_sql(v[0], v[1])}" for c, v in D.CROPS.items())
    a = _sel("daily", [f"{FX.SERIES_CROP_SQL} AS crop"])
    return DAILY + f", a AS ({a})\n" + _sel("a", ["crop", f"CASE {cases} ELSE false END AS growing_season"])


@query("growing_season", _gs_sql())
def q_growing_season(spark, sf):
    d = _daily(spark, sf, []).withColumn("crop", FX.series_crop())
    return out(d.withColumn("growing_season", D.is_growing_season(F.col("crop"), F.col("date"))),
               cols=["crop", "growing_season"])


def _stage_sql():
    cases = " ".join(f"WHEN crop = '{c}' AND {_span_sql(a, b)} THEN '{s}'"
                     for c, st in D.GROWTH_STAGES.items() for s, a, b in st)
    known = ", ".join(f"'{c}'" for c in D.GROWTH_STAGES)
    a = _sel("daily", [f"{FX.SERIES_CROP_SQL} AS crop"])
    return DAILY + f", a AS ({a})\n" + _sel("a", [
        "crop", f"CASE WHEN crop NOT IN ({known}) THEN 'unknown' {cases} ELSE 'vegetative' END AS growth_stage"])


@query("growth_stage", _stage_sql())
def q_growth_stage(spark, sf):
    d = _daily(spark, sf, []).withColumn("crop", FX.series_crop())
    return out(d.withColumn("growth_stage", D.growth_stage(F.col("crop"), F.col("date"))),
               cols=["crop", "growth_stage"])


# X22 -----------------------------------------------------------------------
def _ratios_sql():
    vi = ["NDVI", "EVI", "SAVI", "GNDVI"]
    nn = " + ".join(f"CASE WHEN {c} IS NULL THEN 0 ELSE 1 END" for c in vi)
    sm = " + ".join(f"coalesce({c}, 0)" for c in vi)
    a = _sel("daily_gaps", vi + ["NDWI_Gao", f"({nn}) AS n", f"({sm}) AS s"])
    mean = "CASE WHEN n > 0 THEN s / n END"
    ss = " + ".join(f"coalesce(({c} - ({mean})) * ({c} - ({mean})), 0)" for c in vi)
    outs = [Q.r(Q.div("NDVI", "EVI + 0.001"), "NDVI_EVI_ratio"), Q.r(Q.div("NDVI", "SAVI + 0.001"), "NDVI_SAVI_ratio"),
            Q.r(Q.div("NDVI", "NDWI_Gao + 0.5"), "vegetation_water_balance"),
            Q.r("NDVI * NDWI_Gao", "ndvi_ndwi_product"), Q.r("NDVI - NDWI_Gao", "ndvi_ndwi_diff"),
            Q.r(Q.div("GNDVI", "NDVI + 0.001"), "green_red_balance"), Q.r(mean, "vegetation_vigor_index"),
            Q.r(f"CASE WHEN n > 1 THEN sqrt(({ss}) / (n - 1)) END", "vegetation_vigor_std")]
    return GAPS + f", a AS ({a})\n" + _sel("a", outs)


@query("veg_ratios", _ratios_sql())
def q_veg_ratios(spark, sf):
    d = _daily(spark, sf, ["NDVI", "EVI", "SAVI", "GNDVI", "NDWI_Gao"], gaps=True)
    return out(FE.vegetation_ratios(d), cols=["NDVI_EVI_ratio", "NDVI_SAVI_ratio", "vegetation_water_balance",
                                              "ndvi_ndwi_product", "ndvi_ndwi_diff", "green_red_balance",
                                              "vegetation_vigor_index", "vegetation_vigor_std"])


# X23 -----------------------------------------------------------------------
def _inter_sql():
    a = _sel("daily_gaps", ["NDVI", "T2M", "NDWI_Gao", "PRECTOTCORR", "PET_PT_JPL", f"{_VPD_SQL} AS VPD"])
    return GAPS + f", a AS ({a})\n" + _sel("a", [
        Q.r("NDVI * T2M", "NDVI_x_temp"), Q.r("NDVI * VPD", "NDVI_x_VPD"), Q.r("NDWI_Gao * PRECTOTCORR", "NDWI_x_precip"),
        Q.r(Q.div("PRECTOTCORR", "PET_PT_JPL + 0.1"), "precip_pet_ratio"), Q.r("NDVI * NDWI_Gao", "vegetation_water_index")])


@query("interactions", _inter_sql())
def q_interactions(spark, sf):
    d = _daily(spark, sf, ["NDVI", "T2M", "T2M_MAX", "T2M_MIN", "NDWI_Gao", "PRECTOTCORR", "PET_PT_JPL"], gaps=True)
    d = d.withColumn("VPD", IX.vpd("T2M_MAX", "T2M_MIN"))
    return out(FE.interactions(d), cols=["NDVI_x_temp", "NDVI_x_VPD", "NDWI_x_precip", "precip_pet_ratio",
                                         "vegetation_water_index"])


# X24 -----------------------------------------------------------------------
def _levels_sql():
    a = _sel("daily_gaps", [Q.flag("NDVI < 0.7") + " AS m1", Q.flag("NDVI < 0.6") + " AS m2",
                            Q.flag("NDVI < 0.4") + " AS m3", Q.flag("NDWI_Gao < 0.4") + " AS w1",
                            Q.flag("NDWI_Gao < 0.3") + " AS w2", Q.flag("NDWI_Gao < 0.2") + " AS w3",
                            f"NDVI - {Q.lag('NDVI', 7)} AS c7", Q.rn()])
    return GAPS + f", a AS ({a})\n" + _sel("a", [
        "m1 AS ndvi_stress_mild", "m2 AS ndvi_stress_moderate", "m3 AS ndvi_stress_severe",
        Q.streak_cols("m2", "ndvi_stress_consecutive"), "w1 AS ndwi_stress_mild", "w2 AS ndwi_stress_moderate",
        "w3 AS ndwi_stress_severe", Q.flag("c7 < -0.05") + " AS vegetation_declining",
        Q.flag("c7 < -0.1") + " AS vegetation_rapidly_declining"])


@query("stress_levels", _levels_sql())
def q_stress_levels(spark, sf):
    d = _daily(spark, sf, ["NDVI", "NDWI_Gao"], gaps=True)
    d = d.withColumn("NDVI_change_rate_7d", S.diff("NDVI", 7))
    cols = ["ndvi_stress_mild", "ndvi_stress_moderate", "ndvi_stress_severe", "ndvi_stress_consecutive",
            "ndwi_stress_mild", "ndwi_stress_moderate", "ndwi_stress_severe", "vegetation_declining",
            "vegetation_rapidly_declining"]
    return out(FE.vegetation_stress_levels(d), cols=cols)


# X25 -----------------------------------------------------------------------
def _vpdc_sql():
    a = _sel("daily_gaps", [f"{_VPD_SQL} AS v"])
    return GAPS + f", a AS ({a})\n" + _sel("a", [Q.flag("v < 1.0") + " AS vpd_low",
                                                 Q.flag("v >= 1.0 AND v < 2.0") + " AS vpd_moderate",
                                                 Q.flag("v >= 2.0 AND v < 3.0") + " AS vpd_high",
                                                 Q.flag("v >= 3.0") + " AS vpd_extreme"])


@query("vpd_class", _vpdc_sql())
def q_vpd_class(spark, sf):
    d = _daily(spark, sf, ["T2M_MAX", "T2M_MIN"], gaps=True).withColumn("VPD", IX.vpd("T2M_MAX", "T2M_MIN"))
    return out(FE.vpd_classes(d), cols=["vpd_low", "vpd_moderate", "vpd_high", "vpd_extreme"])


# X26 -----------------------------------------------------------------------
def _heat_sql():
    ths = FE.HOT_DAY_THRESHOLDS
    crops = FE.CROP_HEAT_THRESHOLD
    a = _sel("daily_gaps", [Q.flag(f"T2M_MAX > {t}") + f" AS d{t}" for t in ths] +
             [Q.flag(f"T2M_MAX > {t}") + f" AS {c}_hs" for c, t in crops.items()] +
             [f"CASE WHEN T2M_MAX IS NOT NULL THEN greatest(T2M_MAX - {b}, 0.0) END AS hu{b}"
              for b in FE.HEAT_UNIT_BASES] + [Q.rn()])
    outs = ([f"d{t} AS days_above_{t}C" for t in ths] + [Q.streak_cols(f"d{t}", f"consecutive_days_above_{t}C")
                                                         for t in ths] +
            [f"{c}_hs AS {c}_heat_stress" for c in crops] + [Q.streak_cols(f"{c}_hs", f"{c}_heat_stress_consecutive")
                                                             for c in crops] +
            [Q.r(f"hu{b}", f"heat_units_above_{b}") for b in FE.HEAT_UNIT_BASES] +
            [Q.r(Q.cumsum(f"hu{b}"), f"heat_units_cumsum_above_{b}") for b in FE.HEAT_UNIT_BASES])
    return GAPS + f", a AS ({a})\n" + _sel("a", outs)


@query("heat_units", _heat_sql())
def q_heat_units(spark, sf):
    d = FE.heat_features(_daily(spark, sf, ["T2M_MAX"], gaps=True))
    return out(d.drop("T2M_MAX"))


# X27 -----------------------------------------------------------------------
def _sidx_sql():
    def param(i, default):
        return ("CASE " + " ".join(f"WHEN crop = '{c}' THEN {v[i]}" for c, v in D.CROPS.items())
                + f" ELSE {default} END")
    a = _sel("daily_gaps", ["NDVI", "NDWI_Gao", "CWSI", "EVI", "SAVI", f"{FX.SERIES_CROP_SQL} AS crop",
                            f"{Q.roll('avg', 'NDVI', 7)} AS ma"])
    b = _sel("a", ["crop", Q.flag(f"NDVI < {param(3, 0.6)}") + " AS NDVI_stress",
                   Q.flag(f"NDWI_Gao < {param(5, 0.3)}") + " AS NDWI_stress",
                   Q.flag(f"CWSI > {param(6, 0.4)}") + " AS CWSI_stress",
                   f"coalesce(ma - {Q.lag('ma')} < -0.05, false) AS NDVI_decline",
                   "(NDVI + EVI + SAVI) / 3 AS vv"])
    return GAPS + f", a AS ({a}), b AS ({b})\n" + _sel("b", [
        "crop", "NDVI_stress", "NDWI_stress", "CWSI_stress", "NDVI_decline",
        Q.r("(NDVI_stress + NDWI_stress + CWSI_stress) / 3.0", "combined_stress_index"), Q.r("vv", "vegetation_vigor")])


@query("stress_index", _sidx_sql())
def q_stress_index(spark, sf):
    d = _daily(spark, sf, ["NDVI", "NDWI_Gao", "CWSI", "EVI", "SAVI"], gaps=True).withColumn("crop", FX.series_crop())
    d = FE.stress_indicators(d, F.col("crop"))
    return out(d, cols=["crop", "NDVI_stress", "NDWI_stress", "CWSI_stress", "NDVI_decline",
                        "combined_stress_index", "vegetation_vigor"])


# X28 -----------------------------------------------------------------------
def _label_sql():
    a = _sel("daily_gaps", ["NDVI", "NDWI_Gao", "T2M_MAX", "CWSI",
                            f"{Q.roll('sum', 'PRECTOTCORR - PET_PT_JPL', 7)} AS water_balance_7d"])
    n = " + ".join(Q.flag(c) for c in ("NDVI < 0.6", "NDWI_Gao < 0.3", "T2M_MAX > 35",
                                       "water_balance_7d < -20", "CWSI > 0.4"))
    return GAPS + f", a AS ({a})\n" + _sel("a", [
        f"CAST(CASE WHEN ({n}) >= 3 THEN 2 WHEN ({n}) >= 1 THEN 1 ELSE 0 END AS INTEGER) AS water_stress_level"])


@query("stress_label", _label_sql())
def q_stress_label(spark, sf):
    d = _daily(spark, sf, ["NDVI", "NDWI_Gao", "T2M_MAX", "CWSI", "PRECTOTCORR", "PET_PT_JPL"], gaps=True)
    d = d.withColumn("wb", F.col("PRECTOTCORR") - F.col("PET_PT_JPL"))
    d = d.withColumn("water_balance_7d", S.roll_sum("wb", 7))
    return out(FE.stress_label(d), cols=["water_stress_level"])


# X29 -----------------------------------------------------------------------
_POLY = ["NDVI", "NDWI_Gao", "CWSI"]


@query("polynomial", GAPS + _sel("daily_gaps", [Q.r(c) for c in _POLY] + [
    f'round({a} * {b}, 6) AS "{a} {b}"' for i, a in enumerate(_POLY) for b in _POLY[i + 1:]]))
def q_polynomial(spark, sf):
    d = FE.polynomial(_daily(spark, sf, _POLY, gaps=True), _POLY)
    return out(d)


# A6 / A7 -------------------------------------------------------------------
def _clim_sql(cols, lo, hi, hist_filter, names):
    mean_n, std_n = names
    hist = "SELECT d.*, dayofyear(d.date) AS h FROM daily d"
    if hist_filter:
        hist += (" JOIN (SELECT series_id AS s2, max(date) AS mx FROM daily GROUP BY series_id) m "
                 "ON d.series_id = m.s2 WHERE d.date < m.mx - INTERVAL 365 DAY")
    win = (f"SELECT t, (((t + o) % 366) + 366) % 366 + 1 AS h FROM range(1, 367) r(t), "
           f"range({lo}, {hi + 1}) q(o)")
    aggs = []
    for c in cols:
        aggs += [f"CASE WHEN count({c}) > 5 THEN avg({c}) END AS {c}_{mean_n}",
                 f"CASE WHEN count({c}) > 5 THEN stddev_samp({c}) END AS {c}_{std_n}"]
    clim = (f"SELECT hist.series_id, win.t AS day_of_year, {', '.join(aggs)} FROM hist JOIN win ON hist.h = win.h "
            f"GROUP BY hist.series_id, win.t")
    return hist, win, clim


def _a6_sql():
    cols = ["NDVI", "GNDVI", "NDWI_Gao", "EVI"]
    hist, win, clim = _clim_sql(cols, -15, 15, True, ("clim_mean", "clim_std"))
    outs = ["dayofyear(d.date) AS day_of_year"]
    for c in cols:
        outs += [Q.r(f"{c}_clim_mean"), Q.r(f"{c}_clim_std"), Q.r(f"d.{c} - {c}_clim_mean", f"{c}_anomaly"),
                 Q.r(Q.div(f"d.{c} - {c}_clim_mean", f"{c}_clim_std"), f"{c}_anomaly_std"),
                 Q.flag(f"abs({Q.div(f'd.{c} - {c}_clim_mean', f'{c}_clim_std')}) > 2") + f" AS {c}_severe_anomaly"]
    return (DAILY + f", hist AS ({hist}), win AS ({win}), clim AS ({clim})\n"
            f"SELECT d.series_id, d.date, {', '.join(outs)} FROM daily d LEFT JOIN clim c "
            f"ON d.series_id = c.series_id AND dayofyear(d.date) = c.day_of_year")


@query("climatology_30", _a6_sql())
def q_climatology_30(spark, sf):
    cols = ["NDVI", "GNDVI", "NDWI_Gao", "EVI"]
    d = FE.vegetation_anomalies(_daily(spark, sf, cols), cols)
    outc = ["day_of_year"]
    for c in cols:
        outc += [f"{c}_clim_mean", f"{c}_clim_std", f"{c}_anomaly", f"{c}_anomaly_std", f"{c}_severe_anomaly"]
    return out(d, cols=outc)


def _a7_sql():
    cols = ["NDVI", "NDWI_Gao"]
    hist, win, clim = _clim_sql(cols, -7, 7, False, ("seasonal_mean", "seasonal_std"))
    outs = ["dayofyear(d.date) AS day_of_year"]
    for c in cols:
        outs += [Q.r(f"{c}_seasonal_mean"), Q.r(f"{c}_seasonal_std"),
                 Q.r(f"d.{c} - {c}_seasonal_mean", f"{c}_seasonal_anomaly"),
                 Q.r(Q.div(f"d.{c} - {c}_seasonal_mean", f"{c}_seasonal_std"), f"{c}_seasonal_zscore")]
    return (DAILY + f", hist AS ({hist}), win AS ({win}), clim AS ({clim})\n"
            f"SELECT d.series_id, d.date, {', '.join(outs)} FROM daily d LEFT JOIN clim c "
            f"ON d.series_id = c.series_id AND dayofyear(d.date) = c.day_of_year")


@query("climatology_14", _a7_sql())
def q_climatology_14(spark, sf):
    cols = ["NDVI", "NDWI_Gao"]
    d = FE.seasonal_comparisons(_daily(spark, sf, cols), cols)
    outc = ["day_of_year"]
    for c in cols:
        outc += [f"{c}_seasonal_mean", f"{c}_seasonal_std", f"{c}_seasonal_anomaly", f"{c}_seasonal_zscore"]
    return out(d, cols=outc)
