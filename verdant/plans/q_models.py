"""Registered model queries."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from verdant.functions import indices as IX
from verdant.functions import semantics as S
from verdant.operators import features as FE
from verdant.operators import models as ML
from verdant.operators import timeseries as TSO
from verdant.operators.model_registry import ModelRegistry
from verdant.plans import sqlgen as Q
from verdant.plans.q_features import _clim_sql
from verdant.plans.q_timeseries import DAILY, GAPS, out
from verdant.plans.registry import query
from verdant.session import cut_lineage
from verdant.sources import fixtures as FX

# Model input for the registered queries: all candidate columns.  The balance is
# scaled to whole millionths before it is summed, so that both engines agree on
# the label's -20 mm cut whatever their order of summation.
_EXTRA = ["LAI", "VPD", "GDD", "water_balance_daily", "water_balance_7d", "water_balance_30d", "NDVI_trend_slope", "NDVI_anomaly_std"]


def model_input(spark, sf):
    """daily + LAI, VPD, GDD, balances, trend and anomaly (the processed E2 table)."""
    d = FX.daily(spark, sf)
    d = FE.vegetation_anomalies(d, ["NDVI"])
    d = TSO.trend_slope(d, ["NDVI"])
    balance = F.floor((F.col("PRECTOTCORR") - F.col("PET_PT_JPL")) * 1e6 + 0.5).cast("bigint")
    d = d.withColumns({"LAI": IX.lai("NDVI"), "VPD": IX.vpd("T2M_MAX", "T2M_MIN"), "GDD": IX.gdd("T2M_MAX", "T2M_MIN"), "__b": balance})
    d = d.withColumns({"water_balance_daily": F.col("__b") / 1e6, **{
        f"water_balance_{n}d": S.roll_sum("__b", n) / 1e6 for n in (7, 30)}})
    return d.select("series_id", "date", *FX.DAILY_VALUE_COLS, *_EXTRA)


def model_table(spark, sf):
    return ML.prepare_features(model_input(spark, sf))


def _dealt(d):
    """Narrow rows by series in a given number of tasks, for fits that write the wide rows made
    of them: AQE would merge the few bytes into as few tasks as there are cores."""
    return d.repartition(int(d.sparkSession.conf.get("spark.sql.shuffle.partitions")), "series_id")


_AVAIL = [c for c in ML.CANDIDATE_FEATURES if c in FX.DAILY_VALUE_COLS + _EXTRA]
_E = "0.6108 * exp(17.27 * {t} / ({t} + 237.3))"
_VPD = f"(({_E.format(t='T2M_MAX')} + {_E.format(t='T2M_MIN')}) / 2 - {_E.format(t='T2M_MIN')})"
_TP = 2 * math.pi


def _m1_sql(rounded=True):
    """The feature table; without rounding it is a CTE ``feats`` to build on."""
    hist, win, clim = _clim_sql(["NDVI"], -15, 15, True, ("cm", "cs"))
    pre = ("SELECT d.*, (d.NDVI - c.NDVI_cm) / nullif(c.NDVI_cs, 0) AS NDVI_anomaly_std, CAST(floor((PRECTOTCORR - PET_PT_JPL) * 1e6 + 0.5) AS BIGINT) AS wb, "
           "CAST(row_number() OVER (PARTITION BY d.series_id ORDER BY date) AS DOUBLE) AS x "
           "FROM daily d LEFT JOIN clim c ON d.series_id = c.series_id AND dayofyear(d.date) = c.day_of_year")
    lai = "CASE WHEN NDVI > 0 AND NDVI < 0.95 THEN least(greatest(2.5 * NDVI / (1.0 - NDVI), 0.0), 8.0) END"
    slope = Q.frame(29)
    a = ("SELECT series_id, date, " + ", ".join(FX.DAILY_VALUE_COLS) + f", {lai} AS LAI, {_VPD} AS VPD, "
         "greatest((T2M_MAX + T2M_MIN) / 2 - 10.0, 0.0) AS GDD, wb / 1e6 AS water_balance_daily, "
         + ", ".join(f"CAST({Q.roll('sum', 'wb', n)} AS DOUBLE) / 1e6 AS water_balance_{n}d" for n in (7, 30))
         + f", CASE WHEN count(NDVI) {slope} = 30 THEN regr_slope(NDVI, x) {slope} END AS NDVI_trend_slope, NDVI_anomaly_std FROM pre")
    b = "SELECT * FROM a"
    season = ("CASE WHEN month(date) IN (12, 1, 2) THEN 1 WHEN month(date) IN (3, 4, 5) THEN 2 "
              "WHEN month(date) IN (6, 7, 8) THEN 3 ELSE 4 END")
    feats = []
    exprs = ["year(date) AS year", "month(date) AS month", "dayofyear(date) AS day_of_year",
             "weekofyear(date) AS week_of_year", f"{season} AS season",
             f"sin({_TP} * month(date) / 12) AS month_sin", f"cos({_TP} * month(date) / 12) AS month_cos",
             f"sin({_TP} * dayofyear(date) / 365) AS day_of_year_sin",
             f"cos({_TP} * dayofyear(date) / 365) AS day_of_year_cos"]
    feats += ["year", "month", "day_of_year", "week_of_year", "season", "month_sin", "month_cos", "day_of_year_sin",
              "day_of_year_cos"]
    for c in _AVAIL:
        exprs.append(c)
        feats.append(c)
    for c in _AVAIL:
        for n in (1, 3, 7, 14):
            exprs.append(f"{Q.lag(c, n)} AS {c}_lag_{n}")
            feats.append(f"{c}_lag_{n}")
    for c in _AVAIL:
        for w in (3, 7, 14, 30):
            for a_, sa in (("mean", "avg"), ("std", "stddev_samp"), ("min", "min"), ("max", "max")):
                exprs.append(f"{Q.roll(sa, c, w)} AS {c}_rolling_{a_}_{w}")
                feats.append(f"{c}_rolling_{a_}_{w}")
    inter = [("NDVI * T2M", "NDVI_x_temp"), ("NDVI * VPD", "NDVI_x_VPD"), ("NDWI_Gao * PRECTOTCORR", "NDWI_x_precip"),
             ("PRECTOTCORR / nullif(PET_PT_JPL + 0.1, 0)", "precip_pet_ratio"), ("NDVI * NDWI_Gao", "vegetation_water_index")]
    for e, n in inter:
        exprs.append(f"{e} AS {n}")
        feats.append(n)
    n_ = " + ".join(Q.flag(x) for x in ("NDVI < 0.6", "NDWI_Gao < 0.3", "T2M_MAX > 35", "water_balance_7d < -20", "CWSI > 0.4"))
    exprs.append(f"CAST(CASE WHEN ({n_}) >= 3 THEN 2 WHEN ({n_}) >= 1 THEN 1 ELSE 0 END AS DOUBLE) AS label")
    c = f"SELECT series_id, date, {', '.join(exprs)} FROM b"
    fol = "OVER (PARTITION BY series_id ORDER BY date ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"
    outs = []
    for f_ in feats:
        fill = f"coalesce({Q.ffill(f_)}, first_value({f_} IGNORE NULLS) {fol}, 0)"
        outs.append(f"round({fill}, 6) AS {f_}" if rounded and f_ not in ("year", "month", "day_of_year", "week_of_year", "season")
                    else f"{fill} AS {f_}")
    if not rounded:
        return (DAILY + f", hist AS ({hist}), win AS ({win}), clim AS ({clim}), pre AS ({pre}), a AS ({a}), b AS ({b}), c AS ({c}), "
                f"feats AS (SELECT series_id, date, {', '.join(outs)}, label FROM c), long AS (UNPIVOT (SELECT series_id, date, label, "
                + ", ".join(f"CAST({f_} AS DOUBLE) AS {f_}" for f_ in feats) + " FROM feats) ON COLUMNS(* EXCLUDE (series_id, date, label)) INTO NAME feature VALUE x)")
    return DAILY + f", hist AS ({hist}), win AS ({win}), clim AS ({clim}), pre AS ({pre}), a AS ({a}), b AS ({b}), c AS ({c})\nSELECT series_id, date, {', '.join(outs)}, label FROM c"


@query("prepare_features", _m1_sql())
def q_prepare_features(spark, sf):
    return out(model_table(spark, sf))


@query("fill_missing", GAPS + "SELECT series_id, date, " + ", ".join(
    f"round(coalesce({Q.ffill(c)}, first_value({c} IGNORE NULLS) OVER (PARTITION BY series_id ORDER BY date ROWS "
    f"BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 0), 6) AS {c}" for c in ("NDVI", "T2M", "PRECTOTCORR"))
    + " FROM daily_gaps")
def q_fill_missing(spark, sf):
    d = FX.daily_gaps(spark, sf).select("series_id", "date", "NDVI", "T2M", "PRECTOTCORR")
    return out(ML.fill_missing(d, ["NDVI", "T2M", "PRECTOTCORR"]))


@query("drop_missing_target", GAPS + "SELECT series_id, date, round(NDVI, 6) AS NDVI, CAST(NDVI < 0.6 AS INTEGER) "
                                     "AS target FROM daily_gaps WHERE NDVI IS NOT NULL")
def q_drop_missing_target(spark, sf):
    d = FX.daily_gaps(spark, sf).select("series_id", "date", "NDVI")
    d = d.withColumn("target", (F.col("NDVI") < 0.6).cast("int"))
    return out(d.dropna(subset=["target"]))


@query("temporal_split", DAILY + "SELECT series_id, date, row_number() OVER (PARTITION BY series_id ORDER BY date) <= "
                                 "floor(count(*) OVER (PARTITION BY series_id) * 0.8) AS is_train FROM daily")
def q_temporal_split(spark, sf):
    return ML.temporal_split(FX.daily(spark, sf).select("series_id", "date"))


_CORR = FX.DAILY_VALUE_COLS


@query("correlation_matrix", DAILY + ", p AS (SELECT " + ", ".join(
    f"abs(corr({a}, {b})) AS c{i}" for i, (a, b) in enumerate((a, b) for j, a in enumerate(_CORR) for b in _CORR[j + 1:]))
    + " FROM daily)\nSELECT a, b, round(r, 6) AS r, r > 0.95 AS high FROM (" + " UNION ALL ".join(
    f"SELECT '{a}' AS a, '{b}' AS b, c{i} AS r FROM p" for i, (a, b) in
    enumerate((a, b) for j, a in enumerate(_CORR) for b in _CORR[j + 1:])) + ")")
def q_correlation_matrix(spark, sf):
    return out(ML.correlation_pairs(FX.daily(spark, sf), _CORR), keep=("a", "b"))


@query("feature_correlations", None)
def q_feature_correlations(spark, sf):
    """A22 all pairs of the feature table's columns."""
    t = model_table(spark, sf)
    return ML.correlation_pairs(t, ML.feature_columns(t))


def _label_sql(src):
    n_ = " + ".join(Q.flag(x) for x in ("NDVI < 0.6", "NDWI_Gao < 0.3", "T2M_MAX > 35", "CWSI > 0.4"))
    return f"SELECT *, CAST(CASE WHEN ({n_}) >= 3 THEN 2 WHEN ({n_}) >= 1 THEN 1 ELSE 0 END AS DOUBLE) AS label FROM {src}"


def _labelled(spark, sf):
    d = FX.daily(spark, sf)
    return FE.stress_label(d, "label").withColumn("label", F.col("label").cast("double"))


# One-way ANOVA over deviations: per class and feature the mean and the squared deviations from it.
_F_SQL = _m1_sql(rounded=False) + """, per AS (SELECT feature, label, count(*) AS n, avg(x) AS mean, var_pop(x) * count(*) AS within FROM long GROUP BY 1, 2),
tot AS (SELECT feature, sum(n) AS nn, count(*) AS k, sum(within) AS within, sum(n * mean) / sum(n) AS grand FROM per GROUP BY 1),
f AS (SELECT feature, (sum(per.n * (mean - grand) * (mean - grand)) / any_value(k - 1)) / nullif(any_value(tot.within) / any_value(nn - k), 0) AS f_score
      FROM per JOIN tot USING (feature) GROUP BY feature)
"""


@query("select_univariate", _F_SQL + "SELECT feature, round(f_score, 4) AS f_score FROM f ORDER BY round(f_score, 4) DESC NULLS LAST, feature LIMIT 50")
def q_select_univariate(spark, sf):
    t = model_table(spark, sf)
    s = ML.select_univariate(t, ML.feature_columns(t), k=50)
    return s.select("feature", S.rnd("f_score", 4).alias("f_score"))


@query("select_correlation", None)
def q_select_correlation(spark, sf):
    t = model_table(spark, sf)
    return ML.select_correlation(t, ML.feature_columns(t), k=50)


_REG = [c for c in FX.DAILY_VALUE_COLS if c != "NDVI"]


@query("select_regression", DAILY + ", r AS (" + " UNION ALL ".join(
    f"SELECT '{c}' AS feature, regr_r2(NDVI, {c}) AS r2, regr_count(NDVI, {c}) AS n FROM daily" for c in _REG)
    + ")\nSELECT feature, round(r2 * (n - 2) / (1 - r2), 4) AS f_score FROM r ORDER BY 2 DESC, feature LIMIT 5")
def q_select_regression(spark, sf):
    s = ML.select_univariate(FX.daily(spark, sf), _REG, k=5, label="NDVI", task="regression")
    return s.select("feature", S.rnd("f_score", 4).alias("f_score"))


_SC = ["NDVI", "T2M", "PRECTOTCORR"]
WH = "OVER (PARTITION BY series_id)"


@query("scale", GAPS + "SELECT series_id, date, " + ", ".join(
    [f"round(CASE WHEN stddev_pop({c}) {WH} = 0 THEN 0.0 ELSE ({c} - avg({c}) {WH}) / stddev_pop({c}) {WH} END, 6) "
     f"AS {c}_standard" for c in _SC] +
    [f"round(CASE WHEN max({c}) {WH} = min({c}) {WH} THEN 0.0 ELSE ({c} - min({c}) {WH}) / (max({c}) {WH} - "
     f"min({c}) {WH}) END, 6) AS {c}_minmax" for c in _SC] +
    [f"round(CASE WHEN quantile_cont({c}, 0.75) {WH} = quantile_cont({c}, 0.25) {WH} THEN {c} - "
     f"quantile_cont({c}, 0.5) {WH} ELSE ({c} - quantile_cont({c}, 0.5) {WH}) / (quantile_cont({c}, 0.75) {WH} - "
     f"quantile_cont({c}, 0.25) {WH}) END, 6) AS {c}_robust" for c in _SC]) + " FROM daily_gaps")
def q_scale(spark, sf):
    d = FX.daily_gaps(spark, sf).select("series_id", "date", *_SC)
    told = d
    for m in ("standard", "minmax", "robust"):
        told = ML.scale_columns(told, _SC, m, key="series_id", stats=ML.fit_scaling(d, _SC, m, "series_id"), suffix=f"_{m}")
    return out(told.drop(*_SC))


# --------------------------------------------------- fitted models (rows) --

def _registered(spark, sf, model="random_forest", cv=0, task="classification"):
    """The registry, the address of a model of this input, fitted by whoever asks first, and the input.
    A fit makes its narrow rows once and writes them: its passes (rows counted, rows of the
    fit, test rows) and whoever scores afterwards read those."""
    rows = model_input(spark, sf)

    def fit():
        nonlocal rows
        rows = cut_lineage(rows)
        d = _dealt(rows) if rows.count() > ML.TASK_ROWS else rows
        # split here: a window over the table would shuffle its columns
        if task == "classification":
            table = ML.prepare_features(ML.temporal_split(d), keep=["is_train"])
        else:                            # tomorrow's balance (its gaps filled), without today's label
            d = ML.fill_missing(d.withColumn("next", F.col("water_balance_daily")), ["next"])
            d = d.withColumn("next", F.lead("next").over(S.ordered("series_id", "date")))
            table = ML.prepare_features(ML.temporal_split(d, counted="next"), keep=["is_train", "next"])
            table = table.where(F.col("next").isNotNull()).withColumn("label", F.col("next")).drop("next")
        return ML.train(table, model, task, cv_folds=cv)[:2]

    registry = ModelRegistry(spark)
    params = {"task": task, "cv_folds": cv, "test_size": 0.2}
    at = registry.get(f"{model}-{task}", [FX.table(spark, sf, "lineitem")], params, fit)
    return registry, at, rows


def _metrics(spark, sf, *args):
    registry, at, _ = _registered(spark, sf, *args)
    return registry.metrics(at)


@query("train_rf", None)
def q_train_rf(spark, sf):
    return _metrics(spark, sf, "random_forest", 5)


@query("train_gbt", None)
def q_train_gbt(spark, sf):
    return _metrics(spark, sf, "boosted")


@query("train_rf_regression", None)
def q_train_rf_regression(spark, sf):
    return _metrics(spark, sf, "random_forest", 0, "regression")


@query("train_gbt_regression", None)
def q_train_gbt_regression(spark, sf):
    return _metrics(spark, sf, "boosted", 0, "regression")


# A23 on a prediction that both engines can make: yesterday's class.
_PERSIST = ("pr AS (SELECT series_id, CAST(label AS INTEGER) AS label, CAST(lag(label) OVER (PARTITION BY series_id ORDER BY date) "
            "AS INTEGER) AS prediction FROM (" + _label_sql("daily") + ")), pp AS (SELECT * FROM pr WHERE prediction IS NOT NULL)")


def _persistence(spark, sf):
    w = S.ordered("series_id", "date")
    d = _labelled(spark, sf).withColumn("prediction", F.lag("label").over(w))
    return d.where(F.col("prediction").isNotNull()).select("label", "prediction")


@query("confusion_matrix", DAILY + f", {_PERSIST}\nSELECT label, prediction, count(*) AS count FROM pp GROUP BY label, prediction")
def q_confusion_matrix(spark, sf):
    return ML.confusion_matrix(_persistence(spark, sf))


@query("class_report", DAILY + f", {_PERSIST}, c AS (SELECT c, count(*) FILTER (WHERE label = c AND prediction = c) AS tp, "
       "count(*) FILTER (WHERE prediction = c) AS pn, count(*) FILTER (WHERE label = c) AS support FROM pp, (SELECT DISTINCT label AS c FROM pp "
       "UNION SELECT prediction FROM pp) GROUP BY c), r AS (SELECT c, support, coalesce(tp / nullif(pn, 0), 0.0) AS p, "
       "coalesce(tp / nullif(support, 0), 0.0) AS r FROM c)\nSELECT c AS class, round(p, 6) AS precision, round(r, 6) AS recall, "
       "round(coalesce(2 * p * r / nullif(p + r, 0), 0.0), 6) AS f1, support FROM r")
def q_class_report(spark, sf):
    return out(ML.class_report(_persistence(spark, sf)), keep=("class",))


@query("importance_rank", _F_SQL + ", shares AS (SELECT feature, f_score / sum(f_score) OVER () AS importance FROM f)\n"
       "SELECT feature, round(importance, 6) AS importance, row_number() OVER (ORDER BY round(importance, 9) DESC NULLS LAST, feature) AS rank FROM shares")
def q_importance_rank(spark, sf):
    """T4 on importances that both engines can compute: shares of the F statistics."""
    t = model_table(spark, sf)
    r = ML.rank_importance(ML.anova_f(t, ML.feature_columns(t)).withColumnRenamed("f_score", "importance"))
    return out(r, keep=("feature",))


@query("model_importance", None)
def q_model_importance(spark, sf):
    registry, at, _ = _registered(spark, sf)
    pm = registry.load(at)
    return ML.rank_importance(ML.feature_importance(pm, pm.stages[0].getInputCols(), spark))


@query("forward_folds", DAILY + ", n AS (SELECT series_id, date, row_number() OVER (PARTITION BY series_id ORDER BY date) - 1 AS rn, "
       "count(*) OVER (PARTITION BY series_id) AS n FROM daily), t AS (SELECT *, n // 4 AS test, n - 3 * (n // 4) AS head FROM n)\n"
       "SELECT series_id, date, CAST(CASE WHEN rn < head THEN 0 ELSE least((rn - head) // test + 1, 3) END AS INTEGER) AS block FROM t")
def q_forward_folds(spark, sf):
    return ML.forward_folds(FX.daily(spark, sf).select("series_id", "date"), 3)


@query("k_folds", DAILY + "SELECT series_id, date, CAST(('0x' || substr(md5(concat_ws('|', '42', series_id, CAST(date AS VARCHAR))), 1, 8))::BIGINT % 5 "
       "AS INTEGER) AS fold FROM daily")
def q_k_folds(spark, sf):
    return ML.k_folds(FX.daily(spark, sf).select("series_id", "date"), 5)


@query("stratified_split", DAILY + f", s AS (SELECT *, md5(concat_ws('|', '42', series_id, CAST(date AS VARCHAR))) AS h FROM ({_label_sql('daily')}))\n"
       "SELECT series_id, date, CAST(label AS INTEGER) AS label, row_number() OVER (PARTITION BY series_id, label ORDER BY h) > "
       "ceil(count(*) OVER (PARTITION BY series_id, label) * 0.2) AS is_train FROM s")
def q_stratified_split(spark, sf):
    d = ML.stratified_split(_labelled(spark, sf).select("series_id", "date", "label"))
    return d.select("series_id", "date", F.col("label").cast("int").alias("label"), "is_train")


@query("score", None)
def q_score(spark, sf):
    """Every row of the feature table, by the registered forest."""
    registry, at, rows = _registered(spark, sf)
    p = ML.predict(registry.load(at), ML.prepare_features(rows))
    return p.select("series_id", "date", "prediction", "confidence")


@query("model_store", None)
def q_model_store(spark, sf):
    """What the registry lists of this input's forest, and what the loaded model is made of."""
    registry, at, _ = _registered(spark, sf)
    pm = registry.load(at)
    listed = registry.index().where(F.col("address") == at)
    return listed.select("name", "params", F.lit(len(pm.stages)).alias("stages"), F.lit(len(pm.stages[0].getInputCols())).alias("features"), F.lit(pm.stages[-1].getNumTrees).alias("trees"))


@query("tune", None)
def q_tune(spark, sf):
    """The whole forest grid, three forward folds."""
    table = ML.prepare_features(ML.forward_folds(_dealt(model_input(spark, sf)), 3), keep=["block"])
    best, score, results = ML.tune(table, "random_forest")
    rows = [(str(sorted(p.items())), float(s), p == best) for p, s in results]
    return spark.createDataFrame(rows, "params string, mean_accuracy double, best boolean")


@query("select_rfe", None)
def q_select_rfe(spark, sf):
    t = ML.prepare_features(_dealt(model_input(spark, sf)))
    keep = ML.select_rfe(t, ML.feature_columns(t), k=50, step=0.3)
    return spark.createDataFrame([(c,) for c in keep], "feature string")
