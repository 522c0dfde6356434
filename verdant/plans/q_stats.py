"""Registered statistics queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from verdant.functions import semantics as S
from verdant.operators import features as FE
from verdant.operators import isolation as IS
from verdant.operators import stats as ST
from verdant.operators import timeseries as TSO
from verdant.plans import sqlgen as Q
from verdant.plans.q_features import _clim_sql
from verdant.plans.q_timeseries import DAILY, GAPS, out
from verdant.plans.registry import query
from verdant.sources import fixtures as FX

_A1 = ["NDVI", "NDWI_Gao", "T2M_MAX", "PRECTOTCORR"]
WH = "OVER (PARTITION BY series_id)"


def _a1_input(spark, sf):
    d = FX.daily_gaps(spark, sf).select("series_id", "date", *_A1)
    # days pack so well that AQE would merge them into a few tasks, which then sort four times the rows
    d = d.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "series_id")
    return TSO.anomaly_zscore(d, ["NDVI"])


def _long_sql():
    anom = Q.flag(f"abs({Q.div(f'NDVI - avg(NDVI) {WH}', f'stddev_pop(NDVI) {WH}')}) > 2.0")
    a = f"SELECT *, CAST({anom} AS DOUBLE) AS NDVI_anomaly FROM daily_gaps"
    parts = " UNION ALL ".join(
        f"SELECT series_id, date, '{c}' AS measure, {c} AS value, {'NDVI_anomaly' if c == 'NDVI' else '0.0'} AS anomaly "
        f"FROM a0" for c in _A1)
    lx = ("SELECT *, CAST(count(value) OVER (PARTITION BY series_id, measure ORDER BY date ROWS BETWEEN UNBOUNDED "
          "PRECEDING AND CURRENT ROW) AS DOUBLE) AS x, avg(value) OVER (PARTITION BY series_id, measure) AS mu FROM lg")
    return GAPS.rstrip() + f", a0 AS ({a}), lg AS ({parts}), lx AS ({lx})\n"


@query("summary_stats", _long_sql() + (
    "SELECT series_id, measure, count(value) AS count, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS std, "
    "round(min(value), 6) AS min, round(max(value), 6) AS max, round(median(value), 6) AS median, "
    "round(quantile_cont(value, 0.25), 6) AS q25, round(quantile_cont(value, 0.75), 6) AS q75, "
    "round(avg(power(value - mu, 3)) / power(avg(power(value - mu, 2)), 1.5), 6) AS skewness, "
    "round(kurtosis_pop(value), 6) AS kurtosis, round(CASE WHEN count(value) >= 3 THEN regr_slope(value, x) END, 6) "
    "AS trend_slope, round(avg(anomaly), 6) AS anomaly_rate, round(count(*) FILTER (WHERE value IS NULL) / count(*), 6) "
    "AS missing_rate, round(CASE WHEN avg(value) <> 0 THEN stddev_samp(value) / avg(value) END, 6) AS cv "
    "FROM lx GROUP BY series_id, measure HAVING count(value) > 0"))
def q_summary_stats(spark, sf):
    return out(ST.summary_statistics(_a1_input(spark, sf), _A1), keep=("series_id", "measure"))


@query("dickey_fuller", _long_sql() + (
    ", nn AS (SELECT series_id, measure, date, value, value - lag(value) OVER (PARTITION BY series_id, measure ORDER BY date)"
    " AS dy, lag(value) OVER (PARTITION BY series_id, measure ORDER BY date) AS ylag FROM lx WHERE value IS NOT NULL), "
    "g AS (SELECT series_id, measure, regr_count(dy, ylag) AS n, regr_slope(dy, ylag) AS b, regr_sxx(dy, ylag) AS sxx, "
    "regr_syy(dy, ylag) AS syy, regr_sxy(dy, ylag) AS sxy FROM nn GROUP BY series_id, measure), "
    "h AS (SELECT *, CASE WHEN n > 2 THEN b / nullif(sqrt(((syy - sxy * sxy / sxx) / (n - 2)) / nullif(sxx, 0)), 0) END "
    "AS stat FROM g)\n"
    "SELECT series_id, measure, n AS n_obs, round(stat, 6) AS adf_statistic, coalesce(stat < -2.86, false) AS is_stationary "
    "FROM h"))
def q_dickey_fuller(spark, sf):
    return out(ST.dickey_fuller(_a1_input(spark, sf), _A1), keep=("series_id", "measure"))


def _adf_sql(lags):
    """The regression by elimination, one CTE a step; ``lags`` differences."""
    names = [*[f"d{i}" for i in range(1, lags + 1)], "ylag", "dy"]
    size = len(names)
    ok = " AND ".join(f"{c} IS NOT NULL" for c in names)
    ctes = [f"r{lags} AS (SELECT *, " + (", ".join(f"lag(dy, {i}) OVER (PARTITION BY series_id, measure ORDER BY date) AS d{i}" for i in range(1, lags + 1)) or "0 AS none") + " FROM dd)",
            f"g{lags}_0 AS (SELECT series_id, measure, count(*) FILTER (WHERE {ok}) AS n, " + ", ".join(
                f"covar_pop({names[i]}, {names[j]}) FILTER (WHERE {ok}) * count(*) FILTER (WHERE {ok}) AS m{i}_{j}" for i in range(size) for j in range(i, size))
            + f" FROM r{lags} GROUP BY 1, 2)"]
    for s in range(lags):
        ctes.append(f"g{lags}_{s + 1} AS (SELECT series_id, measure, n, " + ", ".join(
            f"m{i}_{j} - m{s}_{i} / nullif(m{s}_{s}, 0) * m{s}_{j} AS m{i}_{j}" for i in range(s + 1, size) for j in range(i, size)) + f" FROM g{lags}_{s})")
    x, y = f"m{lags}_{lags}", f"m{lags}_{lags + 1}"
    yy = f"m{lags + 1}_{lags + 1}"
    stat = f"CASE WHEN n > {lags + 2} THEN {y} / nullif({x}, 0) / nullif(sqrt(({yy} - {y} * {y} / nullif({x}, 0)) / (n - {lags + 2}) / nullif({x}, 0)), 0) END"
    return ctes, f"SELECT series_id, measure, {lags} AS lags, n AS n_obs, {stat} AS stat FROM g{lags}_{lags}"


def _all_adf_sql():
    ctes, parts = [], []
    for k in range(4):
        c, s = _adf_sql(k)
        ctes += c
        parts.append(s)
    dd = ("dd AS (SELECT series_id, measure, date, value, value - lag(value) OVER (PARTITION BY series_id, measure ORDER BY date) AS dy, "
          "lag(value) OVER (PARTITION BY series_id, measure ORDER BY date) AS ylag FROM lx WHERE value IS NOT NULL)")
    return (_long_sql().rstrip() + ", " + ", ".join([dd, *ctes]) + "\nSELECT series_id, measure, lags, n_obs, round(stat, 6) AS adf_statistic, "
            "coalesce(stat < -2.86, false) AS is_stationary FROM (" + " UNION ALL ".join(parts) + ")")


@query("augmented_dickey_fuller", _all_adf_sql())
def q_augmented_dickey_fuller(spark, sf):
    d = _a1_input(spark, sf)
    told = [ST.dickey_fuller(d, _A1, k).withColumn("lags", F.lit(k)) for k in range(4)]
    every = told[0]
    for more in told[1:]:
        every = every.unionByName(more)
    return out(every, keep=("series_id", "measure", "lags"))


def _decomp_sql(period=365, multiplicative=False):
    cal = ("SELECT series_id, CAST(unnest(generate_series(min(date), max(date), INTERVAL 1 DAY)) AS DATE) AS date "
           "FROM daily WHERE NDVI IS NOT NULL GROUP BY series_id")
    j = ("SELECT c.series_id, c.date, d.NDVI, CAST(c.date - DATE '1970-01-01' AS DOUBLE) AS dd FROM cal c "
         "LEFT JOIN daily d ON c.series_id = d.series_id AND c.date = d.date")
    prv = "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"
    nxt = "ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING"
    k = ("SELECT series_id, date, NDVI, dd, "
         f"last_value(CASE WHEN NDVI IS NOT NULL THEN dd END IGNORE NULLS) OVER (PARTITION BY series_id ORDER BY date {prv}) AS pd_, "
         f"last_value(NDVI IGNORE NULLS) OVER (PARTITION BY series_id ORDER BY date {prv}) AS pv, "
         f"first_value(CASE WHEN NDVI IS NOT NULL THEN dd END IGNORE NULLS) OVER (PARTITION BY series_id ORDER BY date {nxt}) AS nd, "
         f"first_value(NDVI IGNORE NULLS) OVER (PARTITION BY series_id ORDER BY date {nxt}) AS nv FROM j")
    v = ("SELECT series_id, date, coalesce(NDVI, CASE WHEN nd = pd_ THEN pv ELSE pv + (nv - pv) * (dd - pd_) / (nd - pd_) END)"
         " AS v, CAST(row_number() OVER (PARTITION BY series_id ORDER BY date) - 1 AS DOUBLE) AS pos FROM k")
    half = period // 2
    mean = (f"CASE WHEN count(v) OVER w = {period} THEN avg(v) OVER w END" if period % 2 else
            f"CASE WHEN count(v) OVER w = {period + 1} THEN (sum(v) OVER w - 0.5 * first_value(v) OVER w - 0.5 * last_value(v) OVER w) / {period} END")
    m = (f"SELECT *, {mean} AS ma FROM v "
         f"WINDOW w AS (PARTITION BY series_id ORDER BY date ROWS BETWEEN {half} PRECEDING AND {half} FOLLOWING)")
    fb = (f"SELECT *, min(CASE WHEN ma IS NOT NULL THEN pos END) {WH} AS fr, max(CASE WHEN ma IS NOT NULL THEN pos END) "
          f"{WH} AS bk FROM m")
    sf_ = f"pos >= fr AND pos < least(fr + {period}, bk)"
    sb = f"pos >= greatest(fr, bk - {period}) AND pos < bk"
    kk = (f"SELECT *, regr_slope(CASE WHEN {sf_} THEN ma END, CASE WHEN {sf_} THEN pos END) {WH} AS kf, "
          f"regr_intercept(CASE WHEN {sf_} THEN ma END, CASE WHEN {sf_} THEN pos END) {WH} AS nf, "
          f"regr_slope(CASE WHEN {sb} THEN ma END, CASE WHEN {sb} THEN pos END) {WH} AS kb, "
          f"regr_intercept(CASE WHEN {sb} THEN ma END, CASE WHEN {sb} THEN pos END) {WH} AS nb FROM fb")
    t = ("SELECT *, CASE WHEN pos < fr THEN kf * pos + nf WHEN pos > bk THEN kb * pos + nb ELSE ma END AS trend FROM kk")
    s1 = f"SELECT *, {'v / nullif(trend, 0)' if multiplicative else 'v - trend'} AS detr, CAST(pos % {period} AS INTEGER) AS phase FROM t"
    s2 = "SELECT *, avg(detr) OVER (PARTITION BY series_id, phase) AS pm FROM s1"
    centre = f"avg(CASE WHEN pos < {period} THEN pm END) {WH}"
    s3 = f"SELECT *, {f'pm / nullif({centre}, 0)' if multiplicative else f'pm - {centre}'} AS seasonal FROM s2"
    rest = "v / nullif(trend * seasonal, 0)" if multiplicative else "v - trend - seasonal"
    s4 = f"SELECT s3.*, {rest} AS residual, CASE WHEN held >= {2 * period} THEN 'decomposed' ELSE 'short' END AS status FROM s3 JOIN (SELECT series_id, count(NDVI) AS held FROM daily GROUP BY 1) USING (series_id)"
    return (DAILY.rstrip() + f", cal AS ({cal}), j AS ({j}), k AS ({k}), v AS ({v}), m AS ({m}), fb AS ({fb}), "
            f"kk AS ({kk}), t AS ({t}), s1 AS ({s1}), s2 AS ({s2}), s3 AS ({s3}), s4 AS ({s4})\n")


_DSEL = ", ".join(f"round(CASE WHEN status = 'decomposed' THEN {e} END, 6) AS NDVI_{c}" for c, e in (
    ("trend", "trend"), ("seasonal", "seasonal"), ("residual", "residual"),
    ("seasonal_strength", "abs(seasonal) / nullif(abs(seasonal) + abs(residual), 0)"))) + ", status AS NDVI_decomposition_status"


@query("seasonal_decompose", _decomp_sql() + f"SELECT series_id, date, {_DSEL} FROM s4")
def q_seasonal_decompose(spark, sf):
    d = FX.daily(spark, sf).select("series_id", "date", "NDVI")
    return out(ST.seasonal_decomposition(d, "NDVI", 365))


@query("seasonal_decompose_multiplicative", _decomp_sql(30, True) + f"SELECT series_id, date, {_DSEL} FROM s4")
def q_seasonal_decompose_multiplicative(spark, sf):
    """An even period, and components that multiply."""
    d = FX.daily(spark, sf).select("series_id", "date", "NDVI")
    return out(ST.seasonal_decomposition(d, "NDVI", 30, "multiplicative"))


@query("join_decomposition", _decomp_sql() + (
    f", comp AS (SELECT series_id, date, {_DSEL} FROM s4)\n"
    "SELECT d.series_id, d.date, round(d.NDVI, 6) AS NDVI, NDVI_trend, NDVI_seasonal, NDVI_residual, NDVI_seasonal_strength, NDVI_decomposition_status "
    "FROM daily d LEFT JOIN comp c ON d.series_id = c.series_id AND d.date = c.date"))
def q_join_decomposition(spark, sf):
    d = FX.daily(spark, sf).select("series_id", "date", "NDVI")
    parts = ST.seasonal_decomposition(d, "NDVI", 365)
    return out(ST.join_decomposition(d, parts))


@query("change_points", DAILY.rstrip() + ", " + 'a AS (SELECT series_id, date, NDVI, 1.0 / nullif(2 * var_pop(NDVI) OVER (PARTITION BY series_id), 0) AS g, count(NDVI) OVER (PARTITION BY series_id) AS nn, list(NDVI) OVER (PARTITION BY series_id ORDER BY date ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING) AS l, list(NDVI) OVER (PARTITION BY series_id ORDER BY date ROWS BETWEEN CURRENT ROW AND 9 FOLLOWING) AS r FROM daily), b AS (SELECT series_id, date, nn, CASE WHEN len(l) = 10 AND len(r) = 10 AND nn >= 20 THEN (len(list_concat(l, r)) - list_sum(list_transform(list_concat(l, r), lambda u: list_sum(list_transform(list_concat(l, r), lambda v: exp(-g * (u - v) * (u - v)))))) / len(list_concat(l, r))) - (len(l) - list_sum(list_transform(l, lambda u: list_sum(list_transform(l, lambda v: exp(-g * (u - v) * (u - v)))))) / len(l)) - (len(r) - list_sum(list_transform(r, lambda u: list_sum(list_transform(r, lambda v: exp(-g * (u - v) * (u - v)))))) / len(r)) END AS score FROM a), c AS (SELECT *, max(score) OVER (PARTITION BY series_id ORDER BY date ROWS BETWEEN 10 PRECEDING AND 10 FOLLOWING) AS mx FROM b)\nSELECT series_id, date, round(score, 6) AS NDVI_change_score, CASE WHEN score > 3.0 AND score >= mx THEN 1 ELSE 0 END AS NDVI_change_point, CASE WHEN nn < 20 THEN \'short\' WHEN score IS NULL THEN \'edge\' ELSE \'scored\' END AS NDVI_change_status FROM c')
def q_change_points(spark, sf):
    d = FX.daily(spark, sf).select("series_id", "date", "NDVI")
    return out(ST.change_points(d, "NDVI", 10))


@query("anomaly_isolation", None)
def q_anomaly_isolation(spark, sf):
    d = FX.daily_gaps(spark, sf).select("series_id", "date", "NDVI", "T2M_MAX")
    return out(IS.isolation_anomalies(d, ["NDVI", "T2M_MAX"]).drop("NDVI", "T2M_MAX"))


# J2 / J5 -------------------------------------------------------------------
_JC = ["NDVI"]


@query("doy_window_join", DAILY.rstrip() + ", " + "hist AS ({0}), win AS ({1}), clim AS ({2})".format(
    *_clim_sql(_JC, -15, 15, False, ("m", "s"))) + "\nSELECT series_id, day_of_year, round(NDVI_m, 6) AS NDVI_mean, "
    "round(NDVI_s, 6) AS NDVI_std FROM clim")
def q_doy_window_join(spark, sf):
    c = FE.doy_climatology(FX.daily(spark, sf), _JC, -15, 15)
    return out(c.select("series_id", "day_of_year", "NDVI_mean", "NDVI_std"), keep=("series_id", "day_of_year"))


@query("join_climatology", DAILY.rstrip() + ", " + "hist AS ({0}), win AS ({1}), clim AS ({2})".format(
    *_clim_sql(_JC, -15, 15, False, ("m", "s"))) + "\nSELECT d.series_id, d.date, round(c.NDVI_m, 6) AS NDVI_clim_mean "
    "FROM daily d LEFT JOIN clim c ON d.series_id = c.series_id AND dayofyear(d.date) = c.day_of_year")
def q_join_climatology(spark, sf):
    d = FX.daily(spark, sf).select("series_id", "date", "NDVI")
    c = FE.doy_climatology(d, _JC, -15, 15).select("series_id", "day_of_year", F.col("NDVI_mean").alias("NDVI_clim_mean"))
    j = d.withColumn("day_of_year", F.dayofyear("date")).join(c, ["series_id", "day_of_year"], "left")
    return out(j.select("series_id", "date", "NDVI_clim_mean"))
