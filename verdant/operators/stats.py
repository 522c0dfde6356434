"""Series statistics and decompositions.

All per-series work runs on the series partitioning; the daily table
bounds a series by its number of days.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verdant.functions import semantics as S
from verdant.functions.semantics import KEY, TS
from verdant.operators import timeseries as TSO

# Fixed value: published 5 % critical value of the Dickey-Fuller test with a
# constant term (large samples).
DF_CRITICAL_5PCT = -2.86


def _long(df: DataFrame, cols, key=KEY, ts=TS) -> DataFrame:
    """Unpivot value columns to (key, ts, measure, value, anomaly) with x =
    position among the column's non-null values."""
    cols = [c for c in cols if c in df.columns]
    d = df.select(key, ts, *cols, *[(F.col(f"{c}_anomaly") if f"{c}_anomaly" in df.columns else F.lit(0))
                                   .cast("double").alias(f"__a_{c}") for c in cols])
    stack = F.explode(F.array(*[F.struct(F.lit(c).alias("measure"), F.col(c).cast("double").alias("value"),
                                         F.col(f"__a_{c}").alias("anomaly")) for c in cols]))
    long_ = d.select(key, ts, stack.alias("s")).select(key, ts, "s.measure", "s.value", "s.anomaly")
    w = S.Window.partitionBy(key, "measure").orderBy(ts).rowsBetween(S.Window.unboundedPreceding, 0)
    return long_.withColumn("x", F.count("value").over(w).cast("double"))


def summary_statistics(df: DataFrame, cols, *, key=KEY, ts=TS) -> DataFrame:
    """A1 per series and column: count, mean, std, min, max, median,
    quartiles, skewness, excess kurtosis (population), OLS slope over the
    non-null positions, cv, anomaly rate, missing rate.  Columns without
    any value give no row."""
    long_ = _long(df, cols, key, ts)
    g = long_.groupBy(key, "measure").agg(
        F.count("value").alias("count"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"),
        F.min("value").alias("min"), F.max("value").alias("max"), F.median("value").alias("median"),
        F.percentile("value", 0.25).alias("q25"), F.percentile("value", 0.75).alias("q75"),
        F.skewness("value").alias("skewness"), F.kurtosis("value").alias("kurtosis"),
        F.when(F.count("value") >= 3, F.regr_slope("value", "x")).alias("trend_slope"),
        F.avg("anomaly").alias("anomaly_rate"),
        (F.count_if(F.col("value").isNull()) / F.count("*")).alias("missing_rate"))
    g = g.where(F.col("count") > 0)
    return g.withColumn("cv", F.when(F.col("mean") != 0, F.col("std") / F.col("mean")))


def dickey_fuller(df: DataFrame, cols, lags: int = 0, *, key=KEY, ts=TS) -> DataFrame:
    """A2 (augmented) Dickey-Fuller regression with a constant and ``lags`` lagged
    differences on the non-null values:
    dy_t = a + b y_{t-1} + c_1 dy_{t-1} + ... + c_k dy_{t-k}.

    One aggregate per series gives the co-moments of all these columns over the
    rows that have them; eliminating the lagged differences from them leaves the
    sums of a regression on y_{t-1} alone, whose statistic is b / se(b).
    Stationary when below the 5 % critical value; null without enough rows or variation."""
    long_ = _long(df, cols, key, ts).where(F.col("value").isNotNull())
    w = S.Window.partitionBy(key, "measure").orderBy(ts)
    d = long_.withColumn("ylag", F.lag("value").over(w)).withColumn("dy", F.col("value") - F.col("ylag"))
    d = d.withColumns({f"d{i}": F.lag("dy", i).over(w) for i in range(1, lags + 1)})
    names = [*[f"d{i}" for i in range(1, lags + 1)], "ylag", "dy"]
    whole_row = F.lit(True)
    for c in names:
        whole_row = whole_row & F.col(c).isNotNull()
    some = lambda c: F.when(F.col("__whole"), F.col(c))
    size = len(names)
    g = d.withColumn("__whole", whole_row).groupBy(key, "measure").agg(
        F.count_if("__whole").alias("n"),
        *[(F.covar_pop(some(names[i]), some(names[j])) * F.count_if("__whole")).alias(f"m{i}_{j}") for i in range(size) for j in range(i, size)])
    for step in range(lags):     # eliminate one lagged difference after the other
        pivot = lambda i: F.try_divide(F.col(f"m{step}_{i}"), F.col(f"m{step}_{step}"))  # noqa: E731,B023
        left = {f"m{i}_{j}": F.col(f"m{i}_{j}") - pivot(i) * F.col(f"m{step}_{j}") for i in range(step + 1, size) for j in range(i, size)}
        g = g.select(key, "measure", "n", *[e.alias(c) for c, e in left.items()])
    sxx, sxy, syy = (F.col(f"m{i}_{j}") for i, j in ((lags, lags), (lags, lags + 1), (lags + 1, lags + 1)))
    se = F.sqrt(F.try_divide((syy - F.try_divide(sxy * sxy, sxx)) / (F.col("n") - (lags + 2)), sxx))
    stat = F.when(F.col("n") > lags + 2, F.try_divide(F.try_divide(sxy, sxx), se))
    return g.select(key, "measure", F.col("n").alias("n_obs"), stat.alias("adf_statistic"),
                    F.coalesce(stat < DF_CRITICAL_5PCT, F.lit(False)).alias("is_stationary"))


# ----------------------------------------------------------------- W25 --

def seasonal_decomposition(df: DataFrame, col: str, period: int = 365, model: str = "additive", *,
                           key=KEY, ts=TS) -> DataFrame:
    """W25 classical decomposition of the daily-resampled, linearly
    interpolated series: centred moving-average trend (2 x MA for even
    periods) extended at both ends by least-squares lines through the
    nearest ``period`` trend values; seasonal = centred phase means of the
    detrended series; residual; seasonal strength.  Returns (key, date, trend,
    seasonal, residual, seasonal_strength, status) on the daily calendar of the
    series' values; J4 joins it back with ``join_decomposition``.  A series with fewer
    than 2 x period non-null values keeps its rows, without components and with
    the status ``short`` (else ``decomposed``)."""
    base = df.select(key, ts, col).where(F.col(col).isNotNull()).withColumn("__held", F.count("*").over(S.whole(key)))
    daily = TSO.resample_interpolate(base, [col, "__held"], key=key, ts=ts)
    pos = "__pos"
    d = daily.withColumn(pos, (F.row_number().over(S.ordered(key, ts)) - 1).cast("double"))
    half = period // 2
    if period % 2:
        frame = S.ordered(key, ts).rowsBetween(-half, half)
        ma = F.when(F.count(col).over(frame) == period, F.avg(col).over(frame))
    else:
        frame = S.ordered(key, ts).rowsBetween(-half, half)
        full = F.count(col).over(frame) == period + 1
        s = F.sum(col).over(frame) - 0.5 * F.first(col).over(frame) - 0.5 * F.last(col).over(frame)
        ma = F.when(full, s / period)
    d = d.withColumn("__ma", ma)
    w = S.whole(key)
    d = d.withColumns({"__front": F.min(F.when(F.col("__ma").isNotNull(), F.col(pos))).over(w),
                       "__back": F.max(F.when(F.col("__ma").isNotNull(), F.col(pos))).over(w)})
    front_sel = (F.col(pos) >= F.col("__front")) & (F.col(pos) < F.least(F.col("__front") + period, F.col("__back")))
    back_sel = (F.col(pos) >= F.greatest(F.col("__front"), F.col("__back") - period)) & (F.col(pos) < F.col("__back"))
    d = d.withColumns({
        "__kf": F.regr_slope(F.when(front_sel, F.col("__ma")), F.when(front_sel, F.col(pos))).over(w),
        "__nf": F.regr_intercept(F.when(front_sel, F.col("__ma")), F.when(front_sel, F.col(pos))).over(w),
        "__kb": F.regr_slope(F.when(back_sel, F.col("__ma")), F.when(back_sel, F.col(pos))).over(w),
        "__nb": F.regr_intercept(F.when(back_sel, F.col("__ma")), F.when(back_sel, F.col(pos))).over(w)})
    trend = (F.when(F.col(pos) < F.col("__front"), F.col("__kf") * F.col(pos) + F.col("__nf"))
              .when(F.col(pos) > F.col("__back"), F.col("__kb") * F.col(pos) + F.col("__nb"))
              .otherwise(F.col("__ma")))
    d = d.withColumn("trend", trend)
    detr = F.col(col) - F.col("trend") if model == "additive" else F.try_divide(F.col(col), F.col("trend"))
    d = d.withColumns({"__detr": detr, "__phase": (F.col(pos) % period).cast("int")})
    d = d.withColumn("__pm", F.avg("__detr").over(S.Window.partitionBy(key, "__phase")))
    first_cycle = F.col(pos) < period
    centre = F.avg(F.when(first_cycle, F.col("__pm"))).over(w)
    seasonal = F.col("__pm") - centre if model == "additive" else F.try_divide(F.col("__pm"), centre)
    d = d.withColumn("seasonal", seasonal)
    resid = (F.col(col) - F.col("trend") - F.col("seasonal") if model == "additive"
             else F.try_divide(F.col(col), F.col("trend") * F.col("seasonal")))
    d = d.withColumn("residual", resid)
    strength = F.try_divide(F.abs("seasonal"), F.abs("seasonal") + F.abs("residual"))
    enough = F.col("__held") >= 2 * period
    parts = {"trend": F.col("trend"), "seasonal": F.col("seasonal"), "residual": F.col("residual"), "seasonal_strength": strength}
    return d.select(key, ts, *[F.when(enough, x).alias(f"{col}_{c}") for c, x in parts.items()],
                    F.when(enough, "decomposed").otherwise("short").alias(f"{col}_decomposition_status"))


def join_decomposition(df: DataFrame, parts: DataFrame, *, key=KEY, ts=TS) -> DataFrame:
    """J4 left join of the components onto the original rows by (key, date)."""
    return df.join(parts, [key, ts], "left")


# ----------------------------------------------------------------- W26 --

def change_points(df: DataFrame, col: str, min_size: int = 10, threshold: float = 3.0, *,
                  key=KEY, ts=TS) -> DataFrame:
    """W26 (re-aimed) sliding two-window change score with an RBF kernel:
    at each row, the kernel cost of the joined windows [-m, -1] and [0, m-1]
    minus the costs of the two windows; a row is a change point when the
    score exceeds ``threshold`` and is the largest within +-m rows.  Kernel
    width 1 / (2 var) of the series.  Rows whose windows are not full of values,
    and series without variation, have no score and the flag 0; the status column
    says so (``scored``, ``edge``, ``short`` for series of fewer than 2m values).
    (The reference's exact PELT search is a sequential solver.)

    The kernel of a row with each earlier one within 2m is a column for each lag;
    a block's kernel sum is the sum of those columns over the block's frames."""
    m = min_size
    w, order = S.whole(key), S.ordered(key, ts)
    d = df.select(key, ts, col).withColumns({"__g": F.try_divide(F.lit(1.0), 2 * F.var_pop(col).over(w)), "__nn": F.count(col).over(w)})
    gap = lambda h: F.col(col) - F.lag(col, h).over(order)
    d = d.withColumns({f"__k{h}": F.exp(-F.col("__g") * gap(h) * gap(h)) for h in range(1, 2 * m)})

    def block(n):
        """Kernel sum of the block of ``n`` rows that ends here."""
        inside = [F.sum(f"__k{h}").over(order.rowsBetween(-(n - 1 - h), 0)) for h in range(1, n)]
        return F.lit(float(n)) + 2 * sum(inside[1:], inside[0])

    d = d.withColumns({"__one": block(m), "__two": block(2 * m), "__held": F.count(col).over(order.rowsBetween(-m, m - 1))})
    left, right, both = F.lag("__one", 1).over(order), F.lead("__one", m - 1).over(order), F.lead("__two", m - 1).over(order)
    score = F.when(F.col("__held") == 2 * m, left / m + right / m - both / (2 * m))
    d = d.withColumn("__score", score)
    around = order.rowsBetween(-m, m)
    is_cp = (F.col("__score") > threshold) & (F.col("__score") >= F.max("__score").over(around))
    status = F.when(F.col("__nn") < 2 * m, "short").when(F.col("__score").isNull(), "edge").otherwise("scored")
    return d.select(key, ts, F.col("__score").alias(f"{col}_change_score"),
                    S.flag(is_cp).alias(f"{col}_change_point"), status.alias(f"{col}_change_status"))
