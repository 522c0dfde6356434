"""Registered time-series queries over the ``daily`` fixture."""

from __future__ import annotations

from pyspark.sql import functions as F

from verdant.functions import semantics as S

from verdant.functions.semantics import r6
from verdant.operators import timeseries as TSO
from verdant.plans.registry import query
from verdant.sources import fixtures as FX


def _round(df, cols):
    return df.select(*[r6(c).alias(c) if c in cols else F.col(c) for c in df.columns])


@query("water_balance", FX.with_sql(FX.DAILY_SQL) + """,
wb AS (
  SELECT series_id, date, PRECTOTCORR - PET_PT_JPL AS water_balance_daily FROM daily
),
w1 AS (
  SELECT *,
    CASE WHEN water_balance_daily IS NOT NULL THEN
      sum(water_balance_daily) OVER (PARTITION BY series_id ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) END
      AS water_balance_cumulative,
    CASE WHEN count(water_balance_daily) OVER w7 = 7 THEN sum(water_balance_daily) OVER w7 END AS water_balance_7d,
    CASE WHEN count(water_balance_daily) OVER w30 = 30 THEN sum(water_balance_daily) OVER w30 END AS water_balance_30d,
    CASE WHEN water_balance_daily < 0 THEN 1 ELSE 0 END AS neg,
    row_number() OVER (PARTITION BY series_id ORDER BY date) AS rn
  FROM wb
  WINDOW w7 AS (PARTITION BY series_id ORDER BY date ROWS BETWEEN 6 PRECEDING AND CURRENT ROW),
         w30 AS (PARTITION BY series_id ORDER BY date ROWS BETWEEN 29 PRECEDING AND CURRENT ROW)
),
w2 AS (
  SELECT *,
    CASE WHEN neg = 1 THEN rn - coalesce(max(CASE WHEN neg = 0 THEN rn END) OVER
      (PARTITION BY series_id ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) ELSE 0 END
      AS water_stress_duration,
    (water_balance_30d - avg(water_balance_30d) OVER (PARTITION BY series_id))
      / nullif(stddev_samp(water_balance_30d) OVER (PARTITION BY series_id), 0) AS spei
  FROM w1
)
SELECT series_id, date,
  round(water_balance_daily, 6) AS water_balance_daily,
  round(water_balance_cumulative, 6) AS water_balance_cumulative,
  round(water_balance_7d, 6) AS water_balance_7d,
  round(water_balance_30d, 6) AS water_balance_30d,
  water_stress_duration,
  round(spei, 6) AS spei,
  CASE WHEN water_balance_7d IS NULL THEN NULL
       WHEN water_balance_7d <= -20 THEN 'severe_deficit'
       WHEN water_balance_7d <= -10 THEN 'moderate_deficit'
       WHEN water_balance_7d <= 10 THEN 'normal'
       WHEN water_balance_7d <= 20 THEN 'moderate_surplus'
       ELSE 'severe_surplus' END AS water_status
FROM w2
""")
def q_water_balance(spark, sf_dir):
    d = FX.daily(spark, sf_dir).select("series_id", "date", "PRECTOTCORR", "PET_PT_JPL")
    out = TSO.water_balance(d).drop("PRECTOTCORR", "PET_PT_JPL")
    return _round(out, {"water_balance_daily", "water_balance_cumulative", "water_balance_7d",
                        "water_balance_30d", "spei"})


# ---------------------------------------------------------------------------
# helpers shared by the window queries

from pyspark.sql.types import DoubleType, FloatType  # noqa: E402

from verdant.plans import sqlgen as Q  # noqa: E402


def out(df, keep=("series_id", "date"), cols=None, digits=6):
    """Select key columns + outputs, rounding doubles to ``digits`` decimals."""
    types = dict((f.name, f.dataType) for f in df.schema.fields)
    cols = cols if cols is not None else [c for c in df.columns if c not in keep]
    sel = [F.col(k) for k in keep]
    for c in cols:
        if isinstance(types[c], (DoubleType, FloatType)):
            sel.append(S.rnd(c, digits).alias(c))
        else:
            sel.append(F.col(c))
    return df.select(*sel)


def _daily(spark, sf, cols, gaps=False):
    d = (FX.daily_gaps if gaps else FX.daily)(spark, sf)
    return d.select("series_id", "date", *cols)


DAILY = FX.with_sql(FX.DAILY_SQL)
GAPS = FX.with_sql(FX.DAILY_GAPS_SQL)


def _sel(src, exprs, where=""):
    return f"SELECT series_id, date, {', '.join(exprs)} FROM {src} {where}"


# W1 -------------------------------------------------------------------------
_LAG_COLS = ["NDVI", "T2M_MAX", "PRECTOTCORR"]


@query("lags", DAILY + _sel("daily", [Q.r(Q.lag(c, n), f"{c}_lag_{n}") for c in _LAG_COLS
                                       for n in (1, 3, 7, 14)]))
def q_lags(spark, sf):
    d = _daily(spark, sf, _LAG_COLS)
    return out(TSO.lags(d, _LAG_COLS), cols=[f"{c}_lag_{n}" for c in _LAG_COLS for n in (1, 3, 7, 14)])


# W2 -------------------------------------------------------------------------
_RS_COLS = ["NDVI", "T2M"]
_RS_OUT = [(c, w, a, sa) for c in _RS_COLS for w in (3, 7, 14, 30)
           for a, sa in (("mean", "avg"), ("std", "stddev_samp"), ("min", "min"), ("max", "max"))]


@query("rolling_stats", GAPS + _sel("daily_gaps", [Q.r(Q.roll(sa, c, w), f"{c}_rolling_{a}_{w}")
                                                   for c, w, a, sa in _RS_OUT]))
def q_rolling_stats(spark, sf):
    d = _daily(spark, sf, _RS_COLS, gaps=True)
    return out(TSO.rolling_stats(d, _RS_COLS), cols=[f"{c}_rolling_{a}_{w}" for c, w, a, _ in _RS_OUT])


# W3 -------------------------------------------------------------------------
def _rdev_sql():
    inner = []
    for w in (3, 7, 14, 30):
        inner += [f"{Q.roll('avg', 'NDVI', w)} AS ma_{w}", f"{Q.roll('stddev_samp', 'NDVI', w)} AS sd_{w}"]
    outer = []
    for w in (3, 7, 14, 30):
        outer += [Q.r(f"ma_{w}", f"NDVI_ma_{w}"), Q.r(f"sd_{w}", f"NDVI_std_{w}"),
                  Q.r(f"NDVI - ma_{w}", f"NDVI_deviation_{w}"), Q.r(Q.div(f"sd_{w}", f"ma_{w}"), f"NDVI_cv_{w}")]
    return GAPS + f", x AS ({_sel('daily_gaps', ['NDVI'] + inner)})\n" + _sel("x", outer)


@query("rolling_dev", _rdev_sql())
def q_rolling_dev(spark, sf):
    d = _daily(spark, sf, ["NDVI"], gaps=True)
    cols = [f"NDVI_{k}_{w}" for w in (3, 7, 14, 30) for k in ("ma", "std", "deviation", "cv")]
    return out(TSO.rolling_dev(d, ["NDVI"]), cols=cols)


# W4 -------------------------------------------------------------------------
def _diffs_sql():
    a = _sel("daily_gaps", ["NDVI", f"NDVI - {Q.lag('NDVI', 1)} AS cr", f"NDVI - {Q.lag('NDVI', 3)} AS cr3",
                            f"NDVI - {Q.lag('NDVI', 7)} AS cr7", f"{Q.ffill('NDVI')} AS ff"])
    b = _sel("a", [Q.r("cr", "NDVI_change_rate"), Q.r("cr3", "NDVI_change_rate_3d"),
                   Q.r("cr7", "NDVI_change_rate_7d"), Q.r(f"cr - {Q.lag('cr')}", "NDVI_acceleration"),
                   Q.r(f"{Q.div('ff', Q.lag('ff', 1))} - 1", "NDVI_pct_change"),
                   Q.r(f"{Q.div('ff', Q.lag('ff', 7))} - 1", "NDVI_pct_change_7d")])
    return GAPS + f", a AS ({a})\n" + b


@query("diffs", _diffs_sql())
def q_diffs(spark, sf):
    d = _daily(spark, sf, ["NDVI"], gaps=True)
    cols = ["NDVI_change_rate", "NDVI_change_rate_3d", "NDVI_change_rate_7d", "NDVI_acceleration",
            "NDVI_pct_change", "NDVI_pct_change_7d"]
    return out(TSO.diffs(d, ["NDVI"]), cols=cols)


# W5 -------------------------------------------------------------------------
def _rank_sql():
    exprs = []
    for w in (30, 90):
        f = Q.frame(w - 1)
        exprs.append(
            f"CASE WHEN count(NDVI) {f} = {w} THEN round((len(list_filter(list(NDVI) {f}, lambda v: v < NDVI))"
            f" + (len(list_filter(list(NDVI) {f}, lambda v: v = NDVI)) + 1) / 2.0) / {w}.0, 6) END"
            f" AS NDVI_percentile_{w}d")
    return DAILY + _sel("daily", exprs)


@query("rolling_rank", _rank_sql())
def q_rolling_rank(spark, sf):
    d = _daily(spark, sf, ["NDVI"])
    return out(TSO.rolling_rank(d, ["NDVI"]), cols=["NDVI_percentile_30d", "NDVI_percentile_90d"])


# W6 -------------------------------------------------------------------------
_SUM_COLS = ["PRECTOTCORR", "PET_PT_JPL"]


@query("rolling_sums", DAILY + _sel("daily", [Q.r(Q.roll("sum", c, p), f"{c}_cumsum_{p}d")
                                               for c in _SUM_COLS for p in (7, 14, 30, 60, 90)]))
def q_rolling_sums(spark, sf):
    d = _daily(spark, sf, _SUM_COLS)
    return out(TSO.rolling_sums(d, _SUM_COLS),
               cols=[f"{c}_cumsum_{p}d" for c in _SUM_COLS for p in (7, 14, 30, 60, 90)])


# W7 -------------------------------------------------------------------------
@query("cumulative", GAPS + _sel("daily_gaps", [Q.r(Q.cumsum(c), f"{c}_cumsum") for c in _SUM_COLS]))
def q_cumulative(spark, sf):
    d = _daily(spark, sf, _SUM_COLS, gaps=True)
    return out(TSO.cumulative(d, _SUM_COLS), cols=[f"{c}_cumsum" for c in _SUM_COLS])


# W8 -------------------------------------------------------------------------
_CM_COLS = ["NDVI", "GNDVI", "NDWI_Gao", "EVI", "SAVI"]


def _cm_sql():
    a = _sel("daily", [f"{Q.center('avg', c, 7)} AS {c}_m" for c in _CM_COLS])
    b = _sel("a", [Q.r(f"{c}_m", f"{c}_7d_mean") for c in _CM_COLS] +
             [Q.r(f"{c}_m - {Q.lag(c + '_m')}", f"{c}_rate_change") for c in _CM_COLS])
    return DAILY + f", a AS ({a})\n" + b


@query("centered_mean", _cm_sql())
def q_centered_mean(spark, sf):
    d = _daily(spark, sf, _CM_COLS)
    return out(TSO.centered_mean(d, _CM_COLS),
               cols=[f"{c}_7d_mean" for c in _CM_COLS] + [f"{c}_rate_change" for c in _CM_COLS])


# W9 -------------------------------------------------------------------------
def _streak_sql():
    a = _sel("daily_gaps", [Q.flag("NDVI < 0.6") + " AS ndvi_stress_moderate",
                            Q.flag("T2M_MAX > 32") + " AS hot", Q.rn()])
    b = _sel("a", ["ndvi_stress_moderate", Q.streak_cols("ndvi_stress_moderate", "ndvi_stress_consecutive"),
                   Q.streak_cols("hot", "consecutive_days_above_32C")])
    return GAPS + f", a AS ({a})\n" + b


@query("streak", _streak_sql())
def q_streak(spark, sf):
    d = _daily(spark, sf, ["NDVI", "T2M_MAX"], gaps=True)
    d = d.withColumns({"ndvi_stress_moderate": S.flag(F.col("NDVI") < 0.6), "hot": S.flag(F.col("T2M_MAX") > 32)})
    d = TSO.consecutive(d, {"ndvi_stress_consecutive": "ndvi_stress_moderate",
                            "consecutive_days_above_32C": "hot"})
    return out(d, cols=["ndvi_stress_moderate", "ndvi_stress_consecutive", "consecutive_days_above_32C"])


# W10 ------------------------------------------------------------------------
def _slope_sql(src=DAILY, tbl="daily", c="NDVI"):
    f = Q.frame(29)
    a = _sel(tbl, [c, "CAST(row_number() OVER (PARTITION BY series_id ORDER BY date) AS DOUBLE) AS x"])
    b = _sel("a", [f"CASE WHEN count({c}) {f} = 30 THEN regr_slope({c}, x) {f} END AS s"])
    cc = _sel("b", [Q.r("s", f"{c}_trend_slope"),
                    f"CASE WHEN s > 0.001 THEN 1 WHEN s < -0.001 THEN -1 ELSE 0 END AS {c}_trend_direction"])
    return src + f", a AS ({a}), b AS ({b})\n" + cc


@query("trend_slope", _slope_sql(GAPS, "daily_gaps"))
def q_trend_slope(spark, sf):
    d = _daily(spark, sf, ["NDVI"], gaps=True)
    return out(TSO.trend_slope(d, ["NDVI"]), cols=["NDVI_trend_slope", "NDVI_trend_direction"])


# W11 ------------------------------------------------------------------------
def _mk_sql():
    f = Q.frame(29)
    var = 30 * 29 * 65 / 18.0
    a = _sel("daily", [f"CASE WHEN count(NDVI) {f} = 30 THEN list(NDVI) {f} END AS l"])
    b = _sel("a", ["l", "list_sum(list_transform(range(0, 29), lambda k: list_sum(list_transform(l[k+2:], "
                        "lambda y: sign(y - l[k+1]))))) AS s"])
    z = (f"CASE WHEN l IS NULL THEN NULL WHEN s > 0 THEN (s - 1) / sqrt({var}) "
         f"WHEN s < 0 THEN (s + 1) / sqrt({var}) ELSE 0.0 END")
    cc = _sel("b", [f"round({z}, 6) AS NDVI_mk_trend", Q.flag(f"abs({z}) > 1.96") + " AS NDVI_trend_significant"])
    return DAILY + f", a AS ({a}), b AS ({b})\n" + cc


@query("mann_kendall", _mk_sql())
def q_mann_kendall(spark, sf):
    d = _daily(spark, sf, ["NDVI"])
    return out(TSO.mann_kendall(d, ["NDVI"]), cols=["NDVI_mk_trend", "NDVI_trend_significant"])


# W12 ------------------------------------------------------------------------
def _rel_sql():
    a = _sel("daily_gaps", [f"{Q.ffill('NDVI')} AS ff"])
    return GAPS + f", a AS ({a})\n" + _sel("a", [Q.r(f"{Q.div('ff', Q.lag('ff', 30))} - 1", "NDVI_rel_change")])


@query("rel_change", _rel_sql())
def q_rel_change(spark, sf):
    d = _daily(spark, sf, ["NDVI"], gaps=True)
    return out(TSO.rel_change(d, ["NDVI"]), cols=["NDVI_rel_change"])


# W14-W17 --------------------------------------------------------------------
_AN_COLS = ["NDVI", "T2M_MAX"]
WHOLE = "OVER (PARTITION BY series_id)"


def _iqr_sql():
    a = _sel("daily_gaps", _AN_COLS + [f"quantile_cont({c}, 0.25) {WHOLE} AS q1_{c}" for c in _AN_COLS] +
             [f"quantile_cont({c}, 0.75) {WHOLE} AS q3_{c}" for c in _AN_COLS])
    b = _sel("a", [Q.flag(f"{c} < q1_{c} - 2.0 * (q3_{c} - q1_{c}) OR {c} > q3_{c} + 2.0 * (q3_{c} - q1_{c})")
                   + f" AS {c}_anomaly" for c in _AN_COLS])
    return GAPS + f", a AS ({a})\n" + b


@query("anomaly_iqr", _iqr_sql())
def q_anomaly_iqr(spark, sf):
    d = _daily(spark, sf, _AN_COLS, gaps=True)
    return out(TSO.anomaly_iqr(d, _AN_COLS), cols=[f"{c}_anomaly" for c in _AN_COLS])


@query("anomaly_zscore", GAPS + _sel("daily_gaps", [
    Q.flag(f"abs({Q.div(f'{c} - avg({c}) {WHOLE}', f'stddev_pop({c}) {WHOLE}')}) > 2.0") + f" AS {c}_anomaly"
    for c in _AN_COLS]))
def q_anomaly_zscore(spark, sf):
    d = _daily(spark, sf, _AN_COLS, gaps=True)
    return out(TSO.anomaly_zscore(d, _AN_COLS), cols=[f"{c}_anomaly" for c in _AN_COLS])


@query("anomaly_rolling", GAPS + _sel("daily_gaps", [
    Q.flag(f"abs({Q.div(f'{c} - ' + Q.center('avg', c, 14), Q.center('stddev_samp', c, 14))}) > 2.5")
    + f" AS {c}_rolling_anomaly" for c in _AN_COLS]))
def q_anomaly_rolling(spark, sf):
    d = _daily(spark, sf, _AN_COLS, gaps=True)
    return out(TSO.anomaly_rolling(d, _AN_COLS), cols=[f"{c}_rolling_anomaly" for c in _AN_COLS])


_DOYW = "OVER (PARTITION BY series_id, dayofyear(date))"


@query("anomaly_seasonal", GAPS + _sel("daily_gaps", [
    Q.flag(f"abs({Q.div(f'{c} - avg({c}) {_DOYW}', f'stddev_samp({c}) {_DOYW}')}) > 2.0")
    + f" AS {c}_seasonal_anomaly" for c in _AN_COLS]))
def q_anomaly_seasonal(spark, sf):
    d = _daily(spark, sf, _AN_COLS, gaps=True)
    return out(TSO.anomaly_seasonal(d, _AN_COLS), cols=[f"{c}_seasonal_anomaly" for c in _AN_COLS])


# W19 ------------------------------------------------------------------------
def _extremes_sql():
    c = "T2M_MAX"
    a = _sel("daily_gaps", [c, f"quantile_cont({c}, 0.05) {WHOLE} AS lo", f"quantile_cont({c}, 0.95) {WHOLE} AS hi"])
    b = _sel("a", [Q.flag(f"{c} < lo") + " AS lo_f", Q.flag(f"{c} > hi") + " AS hi_f"])
    cc = _sel("b", ["lo_f", "hi_f", "greatest(lo_f, hi_f) AS ex", Q.rn()])
    d = _sel("cc", ["lo_f", "hi_f", "ex", Q.streak_cols("ex", "cons"),
                    "sum(CASE WHEN ex IS NOT DISTINCT FROM lag(ex) OVER (PARTITION BY series_id ORDER BY date) "
                    "THEN 0 ELSE 1 END) OVER (PARTITION BY series_id ORDER BY date ROWS BETWEEN UNBOUNDED "
                    "PRECEDING AND CURRENT ROW) AS isl"])
    # DuckDB forbids nested window calls: compute the change flag one level up
    d = _sel("cc", ["lo_f", "hi_f", "ex", "__rn",
                    f"CASE WHEN ex IS NOT DISTINCT FROM {Q.lag('ex')} THEN 0 ELSE 1 END AS chg"])
    e = _sel("d", ["lo_f", "hi_f", "ex", Q.streak_cols("ex", "cons"),
                   "sum(chg) OVER (PARTITION BY series_id ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING "
                   "AND CURRENT ROW) AS isl"])
    f = _sel("e", [f"lo_f AS {c}_extreme_low", f"hi_f AS {c}_extreme_high", f"ex AS {c}_extreme",
                   f"cons AS {c}_consecutive_extremes",
                   f"CAST(CASE WHEN ex = 1 THEN sum(ex) OVER (PARTITION BY series_id, isl) ELSE 0 END AS INTEGER)"
                   f" AS {c}_extreme_duration"])
    return GAPS + f", a AS ({a}), b AS ({b}), cc AS ({cc}), d AS ({d}), e AS ({e})\n" + f


@query("extremes", _extremes_sql())
def q_extremes(spark, sf):
    d = _daily(spark, sf, ["T2M_MAX"], gaps=True)
    c = "T2M_MAX"
    return out(TSO.extremes(d, [c]), cols=[f"{c}_extreme_low", f"{c}_extreme_high", f"{c}_extreme",
                                            f"{c}_consecutive_extremes", f"{c}_extreme_duration"])


# W21 ------------------------------------------------------------------------
def _spei_sql():
    a = _sel("daily", [f"{Q.roll('sum', 'PRECTOTCORR - PET_PT_JPL', 30)} AS wb30"]).replace(
        "count(PRECTOTCORR - PET_PT_JPL)", "count(PRECTOTCORR - PET_PT_JPL)")
    return DAILY + f", a AS ({a})\n" + _sel("a", [Q.r(Q.div(f"wb30 - avg(wb30) {WHOLE}", f"stddev_samp(wb30) {WHOLE}"),
                                                       "spei")])


@query("spei", _spei_sql())
def q_spei(spark, sf):
    d = _daily(spark, sf, ["PRECTOTCORR", "PET_PT_JPL"])
    d = d.withColumn("wb", F.col("PRECTOTCORR") - F.col("PET_PT_JPL"))
    d = d.withColumn("wb30", S.roll_sum("wb", 30))
    return out(TSO.spei(d, "wb30", "spei"), cols=["spei"])


# W22 ------------------------------------------------------------------------
def _wbf_sql():
    b = "(PRECTOTCORR - PET_PT_JPL)"
    a = _sel("daily_gaps", ["PRECTOTCORR", "PET_PT_JPL", f"{b} AS b"])
    outs = [Q.r("b", "daily_water_balance"), Q.flag("b < -2") + " AS water_deficit",
            Q.flag("b > 5") + " AS water_surplus", Q.r(Q.cumsum("b"), "cumulative_water_balance"),
            Q.r(Q.div("PRECTOTCORR", "PET_PT_JPL + 0.1"), "precip_pet_ratio")]
    for p in (30, 60, 90):
        outs.append(Q.r(Q.div(f"b - {Q.center('avg', 'b', p)}", Q.center("stddev_samp", "b", p)),
                        f"water_balance_zscore_{p}d"))
    return GAPS + f", a AS ({a})\n" + _sel("a", outs)


@query("water_balance_features", _wbf_sql())
def q_wbf(spark, sf):
    d = _daily(spark, sf, ["PRECTOTCORR", "PET_PT_JPL"], gaps=True)
    cols = ["daily_water_balance", "water_deficit", "water_surplus", "cumulative_water_balance",
            "precip_pet_ratio", "water_balance_zscore_30d", "water_balance_zscore_60d", "water_balance_zscore_90d"]
    return out(TSO.water_balance_features(d), cols=cols)


# W23 ------------------------------------------------------------------------
def _decl_sql():
    a = _sel("daily_gaps", [f"{Q.roll('avg', 'NDVI', 7)} AS ma"])
    return GAPS + f", a AS ({a})\n" + _sel("a", [f"coalesce(ma - {Q.lag('ma')} < -0.05, false) AS NDVI_decline"])


@query("ndvi_decline", _decl_sql())
def q_ndvi_decline(spark, sf):
    d = _daily(spark, sf, ["NDVI"], gaps=True)
    return out(TSO.ndvi_decline(d), cols=["NDVI_decline"])


# W24 ------------------------------------------------------------------------
def _phen_sql():
    a = _sel("daily_gaps", ["NDVI", Q.flag("NDVI > 0.3") + " AS above", f"{Q.center('avg', 'NDVI', 7)} AS m7"])
    b = _sel("a", ["NDVI", "above", f"m7 - {Q.lag('m7')} AS rc"])
    cc = _sel("b", [f"coalesce({Q.roll('sum', 'above', 3)} >= 3, false) AS growing_season",
                    f"coalesce(NDVI > {Q.lag('NDVI')} AND NDVI > {Q.lead('NDVI')}, false) AS NDVI_peak",
                    f"coalesce({Q.roll('avg', 'rc', 5)} < -0.01, false) AS senescence"])
    return GAPS + f", a AS ({a}), b AS ({b})\n" + cc


@query("phenology", _phen_sql())
def q_phenology(spark, sf):
    d = _daily(spark, sf, ["NDVI"], gaps=True)
    return out(TSO.phenology(d), cols=["growing_season", "NDVI_peak", "senescence"])


# W27 ------------------------------------------------------------------------
def _dry_sql():
    a = _sel("daily_gaps", [Q.flag("PRECTOTCORR <= 0.1") + " AS dry_day", Q.flag("PRECTOTCORR > 20") +
                            " AS heavy_rain", Q.rn()])
    return GAPS + f", a AS ({a})\n" + _sel("a", ["dry_day", "heavy_rain",
                                                 Q.streak_cols("dry_day", "consecutive_dry_days")])


@query("dry_spell", _dry_sql())
def q_dry_spell(spark, sf):
    d = _daily(spark, sf, ["PRECTOTCORR"], gaps=True)
    return out(TSO.dry_spell(d), cols=["dry_day", "heavy_rain", "consecutive_dry_days"])


# W28 ------------------------------------------------------------------------
def _interp_sql():
    cal = ("SELECT series_id, CAST(unnest(generate_series(min(date), max(date), INTERVAL 1 DAY)) AS DATE) AS date "
           "FROM daily GROUP BY series_id")
    j = ("SELECT c.series_id, c.date, d.NDVI, d.T2M, CAST(c.date - DATE '1970-01-01' AS DOUBLE) AS dd "
         "FROM cal c LEFT JOIN daily d ON c.series_id = d.series_id AND c.date = d.date")
    nxt = "ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING"
    prv = "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"
    parts = []
    for c in ("NDVI", "T2M"):
        parts += [f"last_value(CASE WHEN {c} IS NOT NULL THEN dd END IGNORE NULLS) OVER (PARTITION BY series_id "
                  f"ORDER BY date {prv}) AS pd_{c}",
                  f"last_value({c} IGNORE NULLS) OVER (PARTITION BY series_id ORDER BY date {prv}) AS pv_{c}",
                  f"first_value(CASE WHEN {c} IS NOT NULL THEN dd END IGNORE NULLS) OVER (PARTITION BY series_id "
                  f"ORDER BY date {nxt}) AS nd_{c}",
                  f"first_value({c} IGNORE NULLS) OVER (PARTITION BY series_id ORDER BY date {nxt}) AS nv_{c}"]
    k = "SELECT series_id, date, NDVI, T2M, dd, " + ", ".join(parts) + " FROM j"
    outs = []
    for c in ("NDVI", "T2M"):
        outs.append(f"round(coalesce({c}, CASE WHEN nd_{c} = pd_{c} THEN pv_{c} ELSE pv_{c} + (nv_{c} - pv_{c}) * "
                    f"(dd - pd_{c}) / (nd_{c} - pd_{c}) END), 6) AS {c}")
    return DAILY + f", cal AS ({cal}), j AS ({j}), k AS ({k})\n" + _sel("k", outs)


@query("resample_interpolate", _interp_sql())
def q_resample(spark, sf):
    d = _daily(spark, sf, ["NDVI", "T2M"])
    return out(TSO.resample_interpolate(d, ["NDVI", "T2M"]), cols=["NDVI", "T2M"])


# W29 ------------------------------------------------------------------------
def _gaps_sql():
    a = "SELECT series_id, date, date - lag(date) OVER (PARTITION BY series_id ORDER BY date) AS g FROM daily"
    return DAILY + f", a AS ({a})\n" + (
        "SELECT series_id, max(g) AS max_gap_days, round(avg(g), 6) AS mean_gap_days, "
        "count(*) FILTER (WHERE g > 1) AS gaps_over_1d, max(date) - min(date) AS span_days, "
        "count(*) AS n_dates FROM a GROUP BY series_id")


@query("temporal_gaps", _gaps_sql())
def q_temporal_gaps(spark, sf):
    d = _daily(spark, sf, [])
    return out(TSO.temporal_gaps(d), keep=("series_id",))


# W30 ------------------------------------------------------------------------
def _diurnal_sql():
    a = _sel("daily", ["T2M_MAX - T2M_MIN AS dtr"])
    return DAILY + f", a AS ({a})\n" + _sel("a", [Q.r("dtr", "diurnal_temp_range"),
                                                  Q.r(Q.roll("avg", "dtr", 7), "temp_range_7d_mean")])


@query("diurnal_range", _diurnal_sql())
def q_diurnal(spark, sf):
    d = _daily(spark, sf, ["T2M_MAX", "T2M_MIN"])
    return out(TSO.diurnal_range(d), cols=["diurnal_temp_range", "temp_range_7d_mean"])
