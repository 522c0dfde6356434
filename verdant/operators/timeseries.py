"""Per-series time-series operators.

Every transform partitions by the series key and orders by date: one
shuffle on the key, then every window in the chain reuses that
distribution (extra Window nodes only add a sort, never an exchange).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verdant.functions import semantics as S
from verdant.functions.semantics import KEY, TS


def pet_column(df: DataFrame) -> str | None:
    """Evapotranspiration column: PET_PT_JPL, else EVPTRNS (plan-time lookup)."""
    for c in ("PET_PT_JPL", "EVPTRNS"):
        if c in df.columns:
            return c
    return None


# ----------------------------------------------------------------- W20/W21 --

WATER_STATUS_BINS = [(-20, "severe_deficit"), (-10, "moderate_deficit"),
                     (10, "normal"), (20, "moderate_surplus")]


def right_closed_bins(c, bins, top_label):
    """pandas.cut with right-closed bins; NULL stays NULL."""
    x = S.col(c)
    expr = None
    for edge, label in bins:
        expr = F.when(x <= edge, label) if expr is None else expr.when(x <= edge, label)
    return F.when(x.isNotNull(), expr.otherwise(top_label))


def water_balance(df: DataFrame, *, key: str = KEY, ts: str = TS,
                  precip: str = "PRECTOTCORR", pet: str | None = None) -> DataFrame:
    """W20 balance P-PET, running sum, 7/30-row sums, deficit streak, SPEI, status."""
    pet = pet or pet_column(df)
    if precip not in df.columns or pet is None:
        return df
    out = df.withColumn("water_balance_daily", F.col(precip) - F.col(pet))
    out = out.withColumns({
        "water_balance_cumulative": S.cumsum("water_balance_daily", key, ts),
        "water_balance_7d": S.roll_sum("water_balance_daily", 7, key, ts),
        "water_balance_30d": S.roll_sum("water_balance_daily", 30, key, ts),
        "__neg": S.flag(F.col("water_balance_daily") < 0),
    })
    out = S.with_streak(out, "__neg", "water_stress_duration", key, ts).drop("__neg")
    out = spei(out, "water_balance_30d", "spei", key)
    return out.withColumn("water_status",
                          right_closed_bins("water_balance_7d", WATER_STATUS_BINS, "severe_surplus"))


def spei(df: DataFrame, rolled: str, out: str, key: str = KEY) -> DataFrame:
    """W21 standardise a rolled balance by its series mean and sample std."""
    w = S.whole(key)
    return df.withColumn(out, F.try_divide(F.col(rolled) - F.avg(rolled).over(w),
                                           F.stddev_samp(rolled).over(w)))


# ------------------------------------------------------------- W1-W4, W30 --

def lags(df: DataFrame, cols, periods=(1, 3, 7, 14), *, key=KEY, ts=TS) -> DataFrame:
    """W1 ``{c}_lag_{n}``."""
    return df.withColumns({f"{c}_lag_{n}": S.lag(c, n, key, ts)
                           for c in cols if c in df.columns for n in periods})


def rolling_stats(df: DataFrame, cols, windows=(3, 7, 14, 30), *, key=KEY, ts=TS) -> DataFrame:
    """W2 ``{c}_rolling_{mean,std,min,max}_{w}`` with the full-frame guard."""
    new = {}
    for c in cols:
        if c not in df.columns:
            continue
        for w in windows:
            new[f"{c}_rolling_mean_{w}"] = S.roll_mean(c, w, key, ts)
            new[f"{c}_rolling_std_{w}"] = S.roll_std(c, w, key, ts)
            new[f"{c}_rolling_min_{w}"] = S.roll_min(c, w, key, ts)
            new[f"{c}_rolling_max_{w}"] = S.roll_max(c, w, key, ts)
    return df.withColumns(new)


def rolling_dev(df: DataFrame, cols, windows=(3, 7, 14, 30), *, key=KEY, ts=TS) -> DataFrame:
    """W3 moving average, std, deviation from it, coefficient of variation."""
    for c in cols:
        if c not in df.columns:
            continue
        df = df.withColumns({**{f"{c}_ma_{w}": S.roll_mean(c, w, key, ts) for w in windows},
                             **{f"{c}_std_{w}": S.roll_std(c, w, key, ts) for w in windows}})
        df = df.withColumns({**{f"{c}_deviation_{w}": F.col(c) - F.col(f"{c}_ma_{w}") for w in windows},
                             **{f"{c}_cv_{w}": S.tdiv(f"{c}_std_{w}", f"{c}_ma_{w}") for w in windows}})
    return df


def diffs(df: DataFrame, cols, *, key=KEY, ts=TS) -> DataFrame:
    """W4 first/3/7-row differences, second difference, pct_change 1 and 7."""
    for c in cols:
        if c not in df.columns:
            continue
        df = df.withColumns({f"{c}_change_rate": S.diff(c, 1, key, ts),
                             f"{c}_change_rate_3d": S.diff(c, 3, key, ts),
                             f"{c}_change_rate_7d": S.diff(c, 7, key, ts)})
        df = df.withColumn(f"{c}_acceleration", S.diff(f"{c}_change_rate", 1, key, ts))
        df = S.with_pct_change(df, c, 1, f"{c}_pct_change", key, ts)
        df = S.with_pct_change(df, c, 7, f"{c}_pct_change_7d", key, ts)
    return df


def rolling_rank(df: DataFrame, cols, windows=(30, 90), *, key=KEY, ts=TS) -> DataFrame:
    """W5 percentile rank of the current value inside its trailing window
    (average rank for ties), NULL unless the window is full."""
    new = {}
    for c in cols:
        if c not in df.columns:
            continue
        for w in windows:
            frame = S.trailing(w, key, ts)
            vals = F.collect_list(c).over(frame)
            x = F.col(c)
            below = F.size(F.filter(vals, lambda v: v < x))
            equal = F.size(F.filter(vals, lambda v: v == x))
            rank = (below + (equal + 1) / 2.0) / F.lit(float(w))
            new[f"{c}_percentile_{w}d"] = F.when(F.count(c).over(frame) == w, rank)
    return df.withColumns(new)


def rolling_sums(df: DataFrame, cols=("PRECTOTCORR", "PET_PT_JPL"), periods=(7, 14, 30, 60, 90),
                 *, key=KEY, ts=TS) -> DataFrame:
    """W6 ``{c}_cumsum_{p}d`` trailing sums."""
    return df.withColumns({f"{c}_cumsum_{p}d": S.roll_sum(c, p, key, ts)
                           for c in cols if c in df.columns for p in periods})


def cumulative(df: DataFrame, cols, *, key=KEY, ts=TS) -> DataFrame:
    """W7 running totals ``{c}_cumsum`` (NULL rows stay NULL)."""
    return df.withColumns({f"{c}_cumsum": S.cumsum(c, key, ts) for c in cols if c in df.columns})


def centered_mean(df: DataFrame, cols=("NDVI", "GNDVI", "NDWI_Gao", "EVI", "SAVI"), *,
                  key=KEY, ts=TS) -> DataFrame:
    """W8 centred 7-row mean and its first difference."""
    for c in cols:
        if c not in df.columns:
            continue
        df = df.withColumn(f"{c}_7d_mean", S.center_mean(c, 7, key, ts))
        df = df.withColumn(f"{c}_rate_change", S.diff(f"{c}_7d_mean", 1, key, ts))
    return df


def consecutive(df: DataFrame, cond_flags: dict, *, key=KEY, ts=TS) -> DataFrame:
    """W9 for each ``out -> 0/1 flag column``: length of the current run of 1s."""
    for out, fl in cond_flags.items():
        df = S.with_streak(df, fl, out, key, ts)
    return df


def trend_slope(df: DataFrame, cols, window: int = 30, *, key=KEY, ts=TS) -> DataFrame:
    """W10 OLS slope over the trailing window (x = row position) + direction."""
    frame = S.trailing(window, key, ts)
    rn = "__rn"
    df = df.withColumn(rn, F.row_number().over(S.ordered(key, ts)).cast("double"))
    for c in cols:
        if c not in df.columns:
            continue
        slope = F.when(F.count(c).over(frame) == window, F.regr_slope(F.col(c), F.col(rn)).over(frame))
        df = df.withColumn(f"{c}_trend_slope", slope)
        s = F.col(f"{c}_trend_slope")
        df = df.withColumn(f"{c}_trend_direction",
                           F.when(s > 0.001, 1).when(s < -0.001, -1).otherwise(0))
    return df.drop(rn)


def mann_kendall(df: DataFrame, cols, window: int = 30, *, key=KEY, ts=TS) -> DataFrame:
    """W11 Mann-Kendall Z over the trailing window (no tie correction) and
    significance flag |Z| > 1.96; null unless the window is full of values.

    A window's S is, over all lags h, the sum of sign(x_t - x_{t-h}) over the rows
    that have both ends in the window: a difference of two running sums for each
    lag, exact as they are whole numbers, so a row costs one step a lag."""
    n = window
    order, so_far = S.ordered(key, ts), S.running(key, ts)
    sq = (n * (n - 1) * (2 * n + 5) / 18.0) ** 0.5
    for c in (c for c in cols if c in df.columns):
        lags = range(1, n)
        sign = {f"__d{h}": F.coalesce(F.signum(F.col(c) - F.lag(c, h).over(order)).cast("int"), F.lit(0)) for h in lags}
        df = df.withColumn("__full", F.count(c).over(S.trailing(n, key, ts)) == n).withColumns(sign)
        df = df.withColumns({f"__r{h}": F.sum(f"__d{h}").over(so_far) for h in lags})
        within = [F.col(f"__r{h}") - F.coalesce(F.lag(f"__r{h}", n - h).over(order), F.lit(0)) for h in lags]
        df = df.withColumn("__s", sum(within[1:], within[0]) if within else F.lit(0))
        s = F.col("__s")
        z = F.when(s > 0, (s - 1) / sq).when(s < 0, (s + 1) / sq).otherwise(F.lit(0.0))
        df = df.withColumn(f"{c}_mk_trend", F.when(F.col("__full"), z)).drop("__s", "__full", *[f"__{x}{h}" for x in "dr" for h in lags])
        df = df.withColumn(f"{c}_trend_significant", S.flag(F.abs(F.col(f"{c}_mk_trend")) > 1.96))
    return df


def rel_change(df: DataFrame, cols, window: int = 30, *, key=KEY, ts=TS) -> DataFrame:
    """W12 pct_change over ``window`` rows (forward-filled first)."""
    for c in cols:
        if c in df.columns:
            df = S.with_pct_change(df, c, window, f"{c}_rel_change", key, ts)
    return df


def detect_trends(df: DataFrame, cols, window: int = 30, *, key=KEY, ts=TS) -> DataFrame:
    """W10+W11+W12 together (the reference's trend pass)."""
    df = trend_slope(df, cols, window, key=key, ts=ts)
    df = mann_kendall(df, cols, window, key=key, ts=ts)
    return rel_change(df, cols, window, key=key, ts=ts)


# ---------------------------------------------------------- W14-W17, W19 --

def anomaly_iqr(df: DataFrame, cols, k: float = 2.0, *, key=KEY) -> DataFrame:
    """W14 outside [Q1 - k IQR, Q3 + k IQR] of the whole series (exact quantiles)."""
    w = S.whole(key)
    for c in cols:
        if c not in df.columns:
            continue
        q1, q3 = f"__q1_{c}", f"__q3_{c}"
        df = df.withColumns({q1: F.percentile(c, 0.25).over(w), q3: F.percentile(c, 0.75).over(w)})
        iqr = F.col(q3) - F.col(q1)
        df = df.withColumn(f"{c}_anomaly", S.flag((F.col(c) < F.col(q1) - k * iqr) |
                                                  (F.col(c) > F.col(q3) + k * iqr))).drop(q1, q3)
    return df


def anomaly_zscore(df: DataFrame, cols, k: float = 2.0, *, key=KEY) -> DataFrame:
    """W15 |x - mean| / population std > k."""
    w = S.whole(key)
    return df.withColumns({
        f"{c}_anomaly": S.flag(F.abs(F.try_divide(F.col(c) - F.avg(c).over(w),
                                                  F.stddev_pop(c).over(w))) > k)
        for c in cols if c in df.columns})


def anomaly_rolling(df: DataFrame, cols, window: int = 14, k: float = 2.5, *, key=KEY, ts=TS) -> DataFrame:
    """W16 centred rolling z-score above ``k``."""
    return df.withColumns({
        f"{c}_rolling_anomaly": S.flag(F.abs(F.try_divide(F.col(c) - S.center_mean(c, window, key, ts),
                                                          S.center_std(c, window, key, ts))) > k)
        for c in cols if c in df.columns})


def anomaly_seasonal(df: DataFrame, cols, k: float = 2.0, *, key=KEY, ts=TS) -> DataFrame:
    """W17 z-score against the same day-of-year mean / sample std of the series."""
    doy = "__doy"
    df = df.withColumn(doy, F.dayofyear(ts))
    w = S.Window.partitionBy(key, doy)
    df = df.withColumns({
        f"{c}_seasonal_anomaly": S.flag(F.abs(F.try_divide(F.col(c) - F.avg(c).over(w),
                                                           F.stddev_samp(c).over(w))) > k)
        for c in cols if c in df.columns})
    return df.drop(doy)


def detect_anomalies(df: DataFrame, cols, method: str = "iqr", threshold: float = 2.0, *,
                     key=KEY, ts=TS) -> DataFrame:
    """Dispatcher of the reference: point method + rolling + seasonal flags."""
    if method == "iqr":
        df = anomaly_iqr(df, cols, threshold, key=key)
    elif method == "zscore":
        df = anomaly_zscore(df, cols, threshold, key=key)
    elif method == "isolation":
        from verdant.operators.isolation import isolation_anomalies
        df = isolation_anomalies(df, cols, key=key, ts=ts)
        df = df.drop(*[f"{c}_isolation{x}" for c in cols for x in ("", "_status")])
    else:
        raise ValueError(method)
    df = anomaly_rolling(df, cols, key=key, ts=ts)
    return anomaly_seasonal(df, cols, key=key, ts=ts)


def extremes(df: DataFrame, cols, pct: float = 95, *, key=KEY, ts=TS) -> DataFrame:
    """W19 below p(100-pct) / above p(pct) flags, current run length and
    the length of the run the row belongs to."""
    w = S.whole(key)
    for c in cols:
        if c not in df.columns:
            continue
        lo, hi = f"__lo_{c}", f"__hi_{c}"
        df = df.withColumns({lo: F.percentile(c, (100 - pct) / 100.0).over(w),
                             hi: F.percentile(c, pct / 100.0).over(w)})
        df = df.withColumns({f"{c}_extreme_low": S.flag(F.col(c) < F.col(lo)),
                             f"{c}_extreme_high": S.flag(F.col(c) > F.col(hi))}).drop(lo, hi)
        df = df.withColumn(f"{c}_extreme",
                           F.greatest(f"{c}_extreme_low", f"{c}_extreme_high"))
        df = S.with_streak(df, f"{c}_extreme", f"{c}_consecutive_extremes", key, ts)
        df = S.with_island_size(df, f"{c}_extreme", f"{c}_extreme_duration", key, ts)
    return df


# -------------------------------------------------------- W22-W24, W27 --

def water_balance_features(df: DataFrame, *, key=KEY, ts=TS, precip="PRECTOTCORR",
                           pet: str | None = None) -> DataFrame:
    """W22 balance flags, running sum, P/(PET+.1), centred z-scores 30/60/90."""
    pet = pet or pet_column(df)
    if precip not in df.columns or pet is None:
        return df
    b = "daily_water_balance"
    df = df.withColumn(b, F.col(precip) - F.col(pet))
    df = df.withColumns({
        "water_deficit": S.flag(F.col(b) < -2),
        "water_surplus": S.flag(F.col(b) > 5),
        "cumulative_water_balance": S.cumsum(b, key, ts),
        "precip_pet_ratio": S.tdiv(F.col(precip), F.col(pet) + 0.1),
        **{f"water_balance_zscore_{p}d": F.try_divide(F.col(b) - S.center_mean(b, p, key, ts),
                                                      S.center_std(b, p, key, ts))
           for p in (30, 60, 90)},
    })
    return df


def ndvi_decline(df: DataFrame, *, key=KEY, ts=TS, c: str = "NDVI") -> DataFrame:
    """W23 first difference of the trailing 7-row mean below -0.05 (boolean)."""
    tmp = "__ma7"
    df = df.withColumn(tmp, S.roll_mean(c, 7, key, ts))
    return df.withColumn("NDVI_decline", F.coalesce(S.diff(tmp, 1, key, ts) < -0.05, F.lit(False))).drop(tmp)


def phenology(df: DataFrame, *, key=KEY, ts=TS, c: str = "NDVI") -> DataFrame:
    """W24 growing season (3 rows > .3), strict local peak, senescence
    (5-row mean of the centred-mean rate below -.01)."""
    above = "__above"
    df = df.withColumn(above, S.flag(F.col(c) > 0.3))
    if f"{c}_rate_change" not in df.columns:
        df = centered_mean(df, [c], key=key, ts=ts)
    df = df.withColumns({
        "growing_season": F.coalesce(S.roll_sum(above, 3, key, ts) >= 3, F.lit(False)),
        f"{c}_peak": F.coalesce((F.col(c) > S.lag(c, 1, key, ts)) & (F.col(c) > S.lead(c, 1, key, ts)),
                                F.lit(False)),
        "senescence": F.coalesce(S.roll_mean(f"{c}_rate_change", 5, key, ts) < -0.01, F.lit(False)),
    })
    return df.drop(above)


def dry_spell(df: DataFrame, *, key=KEY, ts=TS, precip="PRECTOTCORR") -> DataFrame:
    """W27 dry day (<= .1 mm), its run length, heavy rain (> 20 mm)."""
    df = df.withColumns({"dry_day": S.flag(F.col(precip) <= 0.1),
                         "heavy_rain": S.flag(F.col(precip) > 20)})
    return S.with_streak(df, "dry_day", "consecutive_dry_days", key, ts)


def diurnal_range(df: DataFrame, *, key=KEY, ts=TS) -> DataFrame:
    """W30 Tmax - Tmin and its trailing 7-row mean."""
    df = df.withColumn("diurnal_temp_range", F.col("T2M_MAX") - F.col("T2M_MIN"))
    return df.withColumn("temp_range_7d_mean", S.roll_mean("diurnal_temp_range", 7, key, ts))


# ---------------------------------------------------------------- W28-W29 --

def resample_interpolate(df: DataFrame, cols, *, key=KEY, ts=TS) -> DataFrame:
    """W28 one row per calendar day per series; values linearly interpolated
    between the nearest earlier and later observed days (edges stay NULL).

    Each row finds its neighbours in its series' windows, then spreads over the
    days up to the next row: one exchange, no calendar table and no join."""
    day = lambda c: F.datediff(F.col(c) if isinstance(c, str) else c, F.lit("1970-01-01")).cast("double")
    prev_w, next_w = S.running(key, ts), S.Window.partitionBy(key).orderBy(F.col(ts).desc()).rowsBetween(S.Window.unboundedPreceding, -1)
    seen = {"__next": F.lead(ts).over(S.ordered(key, ts))}
    for c in cols:
        at = F.when(F.col(c).isNotNull(), day(ts))
        seen |= {f"__pd_{c}": F.last(at, True).over(prev_w), f"__pv_{c}": F.last(c, True).over(prev_w),
                 f"__nd_{c}": F.last(at, True).over(next_w), f"__nv_{c}": F.last(c, True).over(next_w)}
    base = df.select(key, ts, *cols).withColumns(seen)
    days = base.withColumn("__day", F.explode(F.sequence(F.col(ts), F.coalesce(F.date_sub("__next", 1), F.col(ts)))))
    out = {}
    for c in cols:
        pd_, pv, nd, nv = (F.col(f"__{x}_{c}") for x in ("pd", "pv", "nd", "nv"))
        lerp = pv + (nv - pv) * (day("__day") - pd_) / (nd - pd_)
        out[c] = F.when((F.col("__day") == F.col(ts)) & F.col(c).isNotNull(), F.col(c)).otherwise(lerp)
    return days.select(key, F.col("__day").alias(ts), *[out[c].alias(c) for c in cols])


def temporal_gaps(df: DataFrame, *, key=KEY, ts=TS) -> DataFrame:
    """W29 per series: max / mean gap in days, number of gaps > 1 day, span."""
    gap = F.datediff(F.col(ts), S.lag(ts, 1, key, ts))
    g = df.select(key, ts).withColumn("__gap", gap)
    return g.groupBy(key).agg(
        F.max("__gap").alias("max_gap_days"),
        F.avg("__gap").alias("mean_gap_days"),
        F.count_if(F.col("__gap") > 1).alias("gaps_over_1d"),
        F.datediff(F.max(ts), F.min(ts)).alias("span_days"),
        F.count("*").alias("n_dates"),
    )
