"""Feature engineering.

Column-level features are plain projections; per-series features reuse the
series partitioning of the time-series operators.  Day-of-year climatology
is computed by pre-aggregating (n, sum, sum of squares) per (series, doy)
-- at most 366 rows per series -- and only then fanning each day out to
the target days whose circular window contains it, so the fan-out is
bounded by 366 x window per series regardless of how many years of rows
the series holds.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verdant.functions import semantics as S
from verdant.functions.semantics import KEY, TS
from verdant.operators import timeseries as TSO
from verdant.sources import dims as D


# ------------------------------------------------------------------ X22 --

def row_mean_std(cols):
    """Row-wise mean and sample std across ``cols``, skipping NULLs
    (pandas ``mean(axis=1)`` / ``std(axis=1)``)."""
    arr = F.filter(F.array(*[F.col(c).cast("double") for c in cols]), lambda x: x.isNotNull())
    n = F.size(arr)
    mean = F.when(n > 0, F.aggregate(arr, F.lit(0.0), lambda a, x: a + x) / n)
    ss = F.aggregate(arr, F.lit(0.0), lambda a, x: a + (x - mean) * (x - mean))
    std = F.when(n > 1, F.sqrt(ss / (n - 1)))
    return mean, std


def vegetation_ratios(df: DataFrame) -> DataFrame:
    """X22 index ratios, products, differences, row mean / std of indices."""
    cols = set(df.columns)
    new = {}
    if {"NDVI", "EVI"} <= cols:
        new["NDVI_EVI_ratio"] = S.tdiv(F.col("NDVI"), F.col("EVI") + 0.001)
    if {"NDVI", "SAVI"} <= cols:
        new["NDVI_SAVI_ratio"] = S.tdiv(F.col("NDVI"), F.col("SAVI") + 0.001)
    if {"NDVI", "NDWI_Gao"} <= cols:
        new["vegetation_water_balance"] = S.tdiv(F.col("NDVI"), F.col("NDWI_Gao") + 0.5)
        new["ndvi_ndwi_product"] = F.col("NDVI") * F.col("NDWI_Gao")
        new["ndvi_ndwi_diff"] = F.col("NDVI") - F.col("NDWI_Gao")
    if {"NDVI", "GNDVI"} <= cols:
        new["green_red_balance"] = S.tdiv(F.col("GNDVI"), F.col("NDVI") + 0.001)
    vi = [c for c in df.columns if c in ("NDVI", "EVI", "SAVI", "GNDVI")]
    if len(vi) >= 2:
        m, s = row_mean_std(vi)
        new["vegetation_vigor_index"] = m
        new["vegetation_vigor_std"] = s
    return df.withColumns(new)


# ------------------------------------------------------------------ X23 --

def interactions(df: DataFrame) -> DataFrame:
    """X23 vegetation x weather products and P/(PET+.1)."""
    cols = set(df.columns)
    new = {}
    if {"NDVI", "T2M"} <= cols:
        new["NDVI_x_temp"] = F.col("NDVI") * F.col("T2M")
    if {"NDVI", "VPD"} <= cols:
        new["NDVI_x_VPD"] = F.col("NDVI") * F.col("VPD")
    if {"NDWI_Gao", "PRECTOTCORR"} <= cols:
        new["NDWI_x_precip"] = F.col("NDWI_Gao") * F.col("PRECTOTCORR")
    if {"PRECTOTCORR", "PET_PT_JPL"} <= cols:
        new["precip_pet_ratio"] = S.tdiv(F.col("PRECTOTCORR"), F.col("PET_PT_JPL") + 0.1)
    if {"NDVI", "NDWI_Gao"} <= cols:
        new["vegetation_water_index"] = F.col("NDVI") * F.col("NDWI_Gao")
    return df.withColumns(new)


# ------------------------------------------------------------------ X24 --

def vegetation_stress_levels(df: DataFrame, *, key=KEY, ts=TS) -> DataFrame:
    """X24 NDVI / NDWI stress tiers, moderate-NDVI run length, decline flags."""
    cols = set(df.columns)
    if "NDVI" in cols:
        df = df.withColumns({"ndvi_stress_mild": S.flag(F.col("NDVI") < 0.7),
                             "ndvi_stress_moderate": S.flag(F.col("NDVI") < 0.6),
                             "ndvi_stress_severe": S.flag(F.col("NDVI") < 0.4)})
        df = S.with_streak(df, "ndvi_stress_moderate", "ndvi_stress_consecutive", key, ts)
    if "NDWI_Gao" in cols:
        df = df.withColumns({"ndwi_stress_mild": S.flag(F.col("NDWI_Gao") < 0.4),
                             "ndwi_stress_moderate": S.flag(F.col("NDWI_Gao") < 0.3),
                             "ndwi_stress_severe": S.flag(F.col("NDWI_Gao") < 0.2)})
    if "NDVI_change_rate_7d" in df.columns:
        df = df.withColumns({"vegetation_declining": S.flag(F.col("NDVI_change_rate_7d") < -0.05),
                             "vegetation_rapidly_declining": S.flag(F.col("NDVI_change_rate_7d") < -0.1)})
    return df


# ------------------------------------------------------------------ X25 --

def vpd_classes(df: DataFrame, c: str = "VPD") -> DataFrame:
    """X25 one-hot VPD classes <1, 1-2, 2-3, >=3 kPa."""
    v = F.col(c)
    return df.withColumns({"vpd_low": S.flag(v < 1.0), "vpd_moderate": S.flag((v >= 1.0) & (v < 2.0)),
                           "vpd_high": S.flag((v >= 2.0) & (v < 3.0)), "vpd_extreme": S.flag(v >= 3.0)})


# ------------------------------------------------------------------ X26 --

# Fixed values of the reference: per-crop heat-stress temperature (deg C),
# heat-unit bases and hot-day thresholds.
CROP_HEAT_THRESHOLD = {"soybean": 32, "corn": 35, "wheat": 30}
HEAT_UNIT_BASES = (30, 32, 35)
HOT_DAY_THRESHOLDS = (30, 32, 35, 38)


def heat_features(df: DataFrame, *, key=KEY, ts=TS, c: str = "T2M_MAX") -> DataFrame:
    """X26 hot-day flags and runs, per-crop heat stress and runs, heat units
    above 30/32/35 and their running sums."""
    t = F.col(c)
    df = df.withColumns({f"days_above_{th}C": S.flag(t > th) for th in HOT_DAY_THRESHOLDS})
    for th in HOT_DAY_THRESHOLDS:
        df = S.with_streak(df, f"days_above_{th}C", f"consecutive_days_above_{th}C", key, ts)
    df = df.withColumns({f"{crop}_heat_stress": S.flag(t > th) for crop, th in CROP_HEAT_THRESHOLD.items()})
    for crop in CROP_HEAT_THRESHOLD:
        df = S.with_streak(df, f"{crop}_heat_stress", f"{crop}_heat_stress_consecutive", key, ts)
    df = df.withColumns({f"heat_units_above_{b}": S.clip(t - b, 0.0, None) for b in HEAT_UNIT_BASES})
    return df.withColumns({f"heat_units_cumsum_above_{b}": S.cumsum(f"heat_units_above_{b}", key, ts)
                           for b in HEAT_UNIT_BASES})


def gdd_multi(df: DataFrame, bases=(8, 10, 12, 15), *, key=KEY, ts=TS) -> DataFrame:
    """X11 GDD for several base temperatures with running sums."""
    from verdant.functions.indices import gdd
    df = df.withColumns({f"gdd_base_{b}": gdd("T2M_MAX", "T2M_MIN", b) for b in bases})
    return df.withColumns({f"gdd_cumsum_{b}": S.cumsum(f"gdd_base_{b}", key, ts) for b in bases})


# ------------------------------------------------------------------ X27 --

def stress_indicators(df: DataFrame, crop="soybean", *, key=KEY, ts=TS) -> DataFrame:
    """X27 crop-threshold stress flags, their mean, NDVI decline, vigor.

    ``crop`` is a crop name or a column holding it per row; an unknown crop
    uses the generic thresholds .6 / .3 / .4."""
    crop_c = F.lit(crop) if isinstance(crop, str) else crop
    ndvi_min = D.crop_param(crop_c, 3, 0.6)
    ndwi_th = D.crop_param(crop_c, 5, 0.3)
    cwsi_th = D.crop_param(crop_c, 6, 0.4)
    cols = set(df.columns)
    if "NDVI" in cols:
        df = df.withColumn("NDVI_stress", S.flag(F.col("NDVI") < ndvi_min))
        df = TSO.ndvi_decline(df, key=key, ts=ts)
    if "NDWI_Gao" in cols:
        df = df.withColumn("NDWI_stress", S.flag(F.col("NDWI_Gao") < ndwi_th))
    if "CWSI" in cols:
        df = df.withColumn("CWSI_stress", S.flag(F.col("CWSI") > cwsi_th))
    stress_cols = [c for c in df.columns if c.endswith("_stress")]
    if stress_cols:
        total = sum((F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in stress_cols[1:]),
                    F.coalesce(F.col(stress_cols[0]).cast("double"), F.lit(0.0)))
        df = df.withColumn("combined_stress_index", total / len(stress_cols))
    if {"NDVI", "EVI", "SAVI"} <= cols:
        df = df.withColumn("vegetation_vigor", (F.col("NDVI") + F.col("EVI") + F.col("SAVI")) / 3)
    return df


# ------------------------------------------------------------------ X28 --

def stress_label(df: DataFrame, out: str = "water_stress_level") -> DataFrame:
    """X28 0/1/2 label from the count of five stress conditions present."""
    conds = []
    cols = set(df.columns)
    if "NDVI" in cols:
        conds.append(F.col("NDVI") < 0.6)
    if "NDWI_Gao" in cols:
        conds.append(F.col("NDWI_Gao") < 0.3)
    if "T2M_MAX" in cols:
        conds.append(F.col("T2M_MAX") > 35)
    if "water_balance_7d" in cols:
        conds.append(F.col("water_balance_7d") < -20)
    if "CWSI" in cols:
        conds.append(F.col("CWSI") > 0.4)
    if not conds:
        return df.withColumn(out, F.lit(0))
    n = sum((S.flag(c) for c in conds[1:]), S.flag(conds[0]))
    return df.withColumn(out, F.when(n >= 3, 2).when(n >= 1, 1).otherwise(0))


# ------------------------------------------------------------------ X29 --

def polynomial(df: DataFrame, cols) -> DataFrame:
    """X29 degree-2 interaction terms ``"a b"`` (no squares, no bias)."""
    return df.withColumns({f"{a} {b}": F.col(a) * F.col(b) for a, b in combinations(cols, 2)})


# --------------------------------------------------------------- A6 / A7 --

def doy_climatology(df: DataFrame, cols, lo: int, hi: int, *, key=KEY, ts=TS,
                    history_cutoff_days: int | None = None, min_n: int = 5) -> DataFrame:
    """Per (series, target doy): count / mean / sample std of the series'
    rows whose day of year ``h`` satisfies ``h = ((t + o) mod 366) + 1`` for
    some offset ``o`` in ``[lo, hi]`` (days numbered 1..366).  J5 as an equi-join: pre-aggregate per source
    doy, fan each source doy out to the targets that include it, re-aggregate.
    Returns (key, day_of_year, {c}_n, {c}_mean, {c}_std)."""
    src = df.select(key, ts, *cols).withColumn("__doy", F.dayofyear(ts))
    if history_cutoff_days is not None:
        src = (src.withColumn("__last", F.max(ts).over(S.whole(key)))
                  .where(F.col(ts) < F.date_sub(F.col("__last"), history_cutoff_days)).drop("__last"))
    # sums are taken around the series' mean, so that no digits cancel in the variance
    src = src.withColumns({f"__mid_{c}": F.avg(c).over(S.whole(key)) for c in cols})
    aggs = []
    for c in cols:
        v = F.col(c) - F.col(f"__mid_{c}")
        aggs += [F.count(v).alias(f"n_{c}"), F.sum(v).alias(f"s_{c}"), F.sum(v * v).alias(f"q_{c}"), F.max(f"__mid_{c}").alias(f"m_{c}")]
    per_doy = src.groupBy(key, "__doy").agg(*aggs)
    # inverse of h = ((t + o) mod 366) + 1, mapped into 1..366
    offs = F.sequence(F.lit(lo), F.lit(hi))
    fan = per_doy.withColumn("__o", F.explode(offs)).withColumn(
        "day_of_year", F.pmod(F.col("__doy") - 2 - F.col("__o"), F.lit(366)) + 1)
    agg2 = []
    for c in cols:
        agg2 += [F.sum(f"n_{c}").alias(f"n_{c}"), F.sum(f"s_{c}").alias(f"s_{c}"),
                 F.sum(f"q_{c}").alias(f"q_{c}"), F.max(f"m_{c}").alias(f"m_{c}")]
    g = fan.groupBy(key, "day_of_year").agg(*agg2)
    outs = [key, "day_of_year"]
    for c in cols:
        n, s, q = F.col(f"n_{c}").cast("double"), F.col(f"s_{c}"), F.col(f"q_{c}")
        ok = F.col(f"n_{c}") > min_n
        mean = F.col(f"m_{c}") + s / n
        var = F.greatest((q - s * s / n) / (n - 1), F.lit(0.0))
        outs += [F.col(f"n_{c}").alias(f"{c}_n"), F.when(ok, mean).alias(f"{c}_mean"),
                 F.when(ok, F.sqrt(var)).alias(f"{c}_std")]
    return g.select(*outs)


def vegetation_anomalies(df: DataFrame, cols=("NDVI", "GNDVI", "NDWI_Gao", "EVI"), *,
                         key=KEY, ts=TS) -> DataFrame:
    """A6 climatology over [doy-14, doy+16] from history older than a year
    before the series' last date (n > 5); anomaly, standardised anomaly and
    |z| > 2 flag.  J2: left join of the daily rows to the climatology."""
    cols = [c for c in cols if c in df.columns]
    clim = doy_climatology(df, cols, -15, 15, key=key, ts=ts, history_cutoff_days=365)
    clim = clim.select(key, "day_of_year", *[F.col(f"{c}_{s}").alias(f"{c}_clim_{s}")
                                             for c in cols for s in ("mean", "std")])
    out = df.withColumn("day_of_year", F.dayofyear(ts)).join(clim, [key, "day_of_year"], "left")
    for c in cols:
        out = out.withColumn(f"{c}_anomaly", F.col(c) - F.col(f"{c}_clim_mean"))
        out = out.withColumn(f"{c}_anomaly_std", S.tdiv(f"{c}_anomaly", f"{c}_clim_std"))
        out = out.withColumn(f"{c}_severe_anomaly", S.flag(F.abs(F.col(f"{c}_anomaly_std")) > 2))
    return out


def seasonal_comparisons(df: DataFrame, cols, *, key=KEY, ts=TS) -> DataFrame:
    """A7 climatology over [doy-6, doy+8] from all rows (n > 5): seasonal
    mean, std, anomaly and z-score."""
    cols = [c for c in cols if c in df.columns]
    clim = doy_climatology(df, cols, -7, 7, key=key, ts=ts)
    clim = clim.select(key, "day_of_year", *[F.col(f"{c}_{s}").alias(f"{c}_seasonal_{s}")
                                             for c in cols for s in ("mean", "std")])
    out = df.withColumn("day_of_year", F.dayofyear(ts)).join(clim, [key, "day_of_year"], "left")
    for c in cols:
        out = out.withColumn(f"{c}_seasonal_anomaly", F.col(c) - F.col(f"{c}_seasonal_mean"))
        out = out.withColumn(f"{c}_seasonal_zscore", S.tdiv(f"{c}_seasonal_anomaly", f"{c}_seasonal_std"))
    return out
