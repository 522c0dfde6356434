"""Vegetation, thermal and weather index expressions.

Pure column expressions: they compile into whole-stage codegen and never
leave the JVM.  Every ratio divides through ``try_divide`` so a zero
denominator yields NULL (the reference yields NaN).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verdant.functions import semantics as S
from verdant.functions.semantics import col

# Fixed values of the reference: EVI coefficients, SAVI soil factor,
# LAI slope per crop (other crops use the soybean slope), LAI cap.
EVI_G, EVI_C1, EVI_C2, EVI_L = 2.5, 6.0, 7.5, 1.0
SAVI_L = 0.5
LAI_K = {"soybean": 2.5, "corn": 3.0, "wheat": 2.0}
LAI_K_DEFAULT = 2.5
LAI_MAX = 8.0
GDD_BASE = 10.0


def normalized_difference(a, b) -> Column:
    return F.try_divide(col(a) - col(b), col(a) + col(b))


def ndvi(red, nir) -> Column:
    """X1 (nir - red) / (nir + red)."""
    return normalized_difference(nir, red)


def gndvi(green, nir) -> Column:
    """X2 (nir - green) / (nir + green)."""
    return normalized_difference(nir, green)


def ndwi(green, nir) -> Column:
    """X3 McFeeters: (green - nir) / (green + nir)."""
    return normalized_difference(green, nir)


def ndwi_gao(nir, swir) -> Column:
    """X4 Gao: (nir - swir) / (nir + swir)."""
    return normalized_difference(nir, swir)


def evi(blue, red, nir, G=EVI_G, C1=EVI_C1, C2=EVI_C2, L=EVI_L) -> Column:
    """X5 G (nir - red) / (nir + C1 red - C2 blue + L)."""
    return F.lit(G) * F.try_divide(col(nir) - col(red),
                                   col(nir) + F.lit(C1) * col(red) - F.lit(C2) * col(blue) + F.lit(L))


def savi(red, nir, L=SAVI_L) -> Column:
    """X6 (1 + L)(nir - red) / (nir + red + L)."""
    return F.try_divide(F.lit(1.0 + L) * (col(nir) - col(red)), col(nir) + col(red) + F.lit(L))


def cwsi(surface_temp, air_temp, vpd) -> Column:
    """X7 empirical crop water stress index clipped to [0, 1]."""
    dt = col(surface_temp) - col(air_temp)
    upper = col(vpd) * 3.0
    lower = col(vpd) * 0.5 - 2.0
    return S.clip(F.try_divide(dt - lower, upper - lower), 0.0, 1.0)


def lai(ndvi_c, crop: str | Column = "soybean") -> Column:
    """X8 k NDVI / (1 - NDVI) inside 0 < NDVI < .95, clipped to [0, 8]."""
    if isinstance(crop, str):
        k = F.lit(LAI_K.get(crop.lower(), LAI_K_DEFAULT))
    else:
        k = F.coalesce(F.element_at(F.create_map(*[x for c, v in LAI_K.items()
                                                   for x in (F.lit(c), F.lit(v))]), F.lower(crop)),
                       F.lit(LAI_K_DEFAULT))
    x = col(ndvi_c)
    raw = F.when((x > 0) & (x < 0.95), k * x / (F.lit(1.0) - x))
    return S.clip(raw, 0.0, LAI_MAX)


def index_stack(df: DataFrame, blue="B2", green="B3", red="B4", nir="B8", swir1="B11") -> DataFrame:
    """X9 all indices of a scene/pixel row in one projection."""
    d = df.withColumns({
        "NDVI": ndvi(red, nir),
        "GNDVI": gndvi(green, nir),
        "NDWI_McFeeters": ndwi(green, nir),
        "NDWI_Gao": ndwi_gao(nir, swir1),
        "EVI": evi(blue, red, nir),
        "SAVI": savi(red, nir),
    })
    x = F.col("NDVI")
    return d.withColumn("LAI", F.when((x > 0) & (x < 0.95), F.lit(2.5) * x / (F.lit(1.0) - x)))


def sat_vapour_pressure(t) -> Column:
    return F.lit(0.6108) * F.exp(F.lit(17.27) * col(t) / (col(t) + F.lit(237.3)))


def vpd(tmax, tmin) -> Column:
    """X10 mean saturation pressure of Tmax/Tmin minus actual (at Tmin), kPa."""
    es = (sat_vapour_pressure(tmax) + sat_vapour_pressure(tmin)) / 2
    return es - sat_vapour_pressure(tmin)


def gdd(tmax, tmin, base: float = GDD_BASE) -> Column:
    """X11 max(mean temperature - base, 0); NULL stays NULL."""
    return S.clip((col(tmax) + col(tmin)) / 2 - F.lit(float(base)), 0.0, None)


def weather_derived(df: DataFrame, *, key=S.KEY, ts=S.TS) -> DataFrame:
    """X12 VPD, GDD, 7/30-row rain sums, heat-day flag, P - ET and its running sum."""
    cols = set(df.columns)
    new = {}
    if {"T2M", "T2M_MAX", "T2M_MIN"} <= cols:
        new["VPD"] = vpd("T2M_MAX", "T2M_MIN")
    if {"T2M_MAX", "T2M_MIN"} <= cols:
        new["GDD"] = gdd("T2M_MAX", "T2M_MIN")
    if "PRECTOTCORR" in cols:
        new["PRECIP_CUMULATIVE_7D"] = S.roll_sum("PRECTOTCORR", 7, key, ts)
        new["PRECIP_CUMULATIVE_30D"] = S.roll_sum("PRECTOTCORR", 30, key, ts)
    if "T2M_MAX" in cols:
        new["HEAT_STRESS_DAYS"] = S.flag(F.col("T2M_MAX") > 32)
    df = df.withColumns(new)
    if {"EVPTRNS", "PRECTOTCORR"} <= cols:
        df = df.withColumn("WATER_BALANCE", F.col("PRECTOTCORR") - F.col("EVPTRNS"))
        df = df.withColumn("WATER_BALANCE_CUMULATIVE", S.cumsum("WATER_BALANCE", key, ts))
    return df
