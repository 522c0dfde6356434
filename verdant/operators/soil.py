"""Soil profile operators.

Long soil rows ``(location_id, property, depth_label, depth_top_cm,
depth_bottom_cm, value, unit)`` are pivoted once to one row per
(location, depth) with a fixed property list (no data-dependent pivot
pass), after which texture, AWC and Ksat are column expressions.  All
groupings are by location: a location has a bounded number of depth rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verdant.functions import semantics as S

SOIL_KEYS = ["location_id", "depth_label", "depth_top_cm", "depth_bottom_cm"]
SOIL_PROPERTIES = ["bdod", "cec", "cfvo", "clay", "nitrogen", "ocd", "phh2o", "sand", "silt", "soc"]
SUMMARY_PROPERTIES = ["sand", "silt", "clay", "bdod", "awc", "ksat"]

def pivot_soil(long_df: DataFrame, properties=SOIL_PROPERTIES) -> DataFrame:
    """A4 one row per (location, depth); property values as columns.
    The list is fixed, so one aggregate makes the row: a group holds its columns,
    not a row for each property."""
    return long_df.groupBy(*SOIL_KEYS).agg(*[F.max(F.when(F.col("property") == p, F.col("value"))).alias(p) for p in properties])


def _percent(df: DataFrame) -> tuple:
    """sand / silt / clay as %, missing -> 0, g/kg converted when sand > 100."""
    sand = F.coalesce(F.col("sand"), F.lit(0.0)) if "sand" in df.columns else F.lit(0.0)
    silt = F.coalesce(F.col("silt"), F.lit(0.0)) if "silt" in df.columns else F.lit(0.0)
    clay = F.coalesce(F.col("clay"), F.lit(0.0)) if "clay" in df.columns else F.lit(0.0)
    gkg = sand > 100
    return (F.when(gkg, sand / 10).otherwise(sand), F.when(gkg, silt / 10).otherwise(silt),
            F.when(gkg, clay / 10).otherwise(clay))


def texture_class(sand, silt, clay):
    """X13 simplified USDA triangle (12 outcomes, 10 reachable)."""
    return (F.when(clay >= 40, "Clay")
             .when(clay >= 30, F.when(silt >= 40, "Silty Clay").otherwise("Sandy Clay"))
             .when(clay >= 20, F.when(sand >= 45, "Sandy Clay Loam")
                                .when(silt >= 50, "Silty Clay Loam").otherwise("Clay Loam"))
             .when(silt >= 80, "Silt").when(silt >= 50, "Silt Loam")
             .when(sand >= 85, "Sand").when(sand >= 70, "Loamy Sand").otherwise("Loam"))


def awc_from_texture(sand, clay, bulk_density):
    """X14 simplified Saxton-Rawls: fc - wp scaled by (1.5 - bulk density),
    clipped to [0, .5].  Reproduces the reference formula literally
    (its wilting point grows with clay squared)."""
    fc = F.lit(0.2576) - 0.0020 * sand + 0.0036 * clay + 0.0299 * F.log10(clay + 1)
    fc = fc + (1.283 * fc * fc - 0.374 * fc - 0.015)
    wp = F.lit(0.0260) + 0.0050 * clay + 0.0158 * F.log10(clay + 1)
    wp = wp + (0.002 * clay * clay - 0.044 * wp - 0.002)
    awc = (fc - wp) * (F.lit(1.5) - bulk_density)
    return F.greatest(F.lit(0.0), F.least(F.lit(0.5), awc))


def ksat(sand, clay):
    """X15 24 * 10^(-.6 + .0126 sand - .0064 clay) cm/day, clipped to [.1, 100]."""
    v = F.lit(24.0) * F.pow(F.lit(10.0), F.lit(-0.6) + 0.0126 * sand - 0.0064 * clay)
    return F.greatest(F.lit(0.1), F.least(F.lit(100.0), v))


def derive_soil(wide: DataFrame) -> DataFrame:
    """X13-X15 on pivoted rows: texture_class, awc (only where bdod is
    present), ksat."""
    sand, silt, clay = _percent(wide)
    out = wide.withColumn("texture_class", texture_class(sand, silt, clay))
    if "bdod" in wide.columns:
        out = out.withColumn("awc", F.when(F.col("bdod").isNotNull(),
                                           awc_from_texture(sand, clay, F.col("bdod") / 100)))
    return out.withColumn("ksat", ksat(sand, clay))


def derived_long_rows(wide: DataFrame) -> DataFrame:
    """U1 derived properties as long rows (awc, ksat numeric; texture kept in
    its own STRING column so ``value`` stays DOUBLE)."""
    d = derive_soil(wide)
    num = d.select(*SOIL_KEYS, F.lit(None).cast("string").alias("texture_class"),
                   F.explode(F.array(
                       F.struct(F.lit("awc").alias("property"), F.col("awc").alias("value"),
                                F.lit("cm3/cm3").alias("unit")),
                       F.struct(F.lit("ksat").alias("property"), F.col("ksat").alias("value"),
                                F.lit("cm/day").alias("unit")))).alias("r"))
    num = num.select(*SOIL_KEYS, "r.property", "r.value", "r.unit", "texture_class").where(F.col("value").isNotNull())
    tex = d.select(*SOIL_KEYS, F.lit("texture_class").alias("property"), F.lit(None).cast("double").alias("value"),
                   F.lit("class").alias("unit"), "texture_class")
    return num.unionByName(tex)


def union_derived(long_df: DataFrame) -> DataFrame:
    """U1 long rows plus their derived rows, appended by name."""
    base = long_df.withColumn("texture_class", F.lit(None).cast("string"))
    return base.unionByName(derived_long_rows(pivot_soil(long_df)))


def root_zone(df: DataFrame, surface: bool = False) -> DataFrame:
    """F1 rows inside 0-100 cm (``surface``: bottom <= 30 cm)."""
    cond = (F.col("depth_top_cm") >= 0) & (F.col("depth_bottom_cm") <= (30 if surface else 100))
    return df.where(cond)


def soil_summary(wide: DataFrame) -> DataFrame:
    """A5 per location: depth-weighted mean of each property over its own
    non-null root-zone rows, and the surface (<= 30 cm) texture of the first
    depth label in label order."""
    rz = root_zone(wide)
    thick = (F.col("depth_bottom_cm") - F.col("depth_top_cm")).cast("double")
    aggs = []
    for p in SUMMARY_PROPERTIES:
        if p in wide.columns:
            aggs.append(F.try_divide(F.sum(F.col(p) * thick),
                                     F.sum(F.when(F.col(p).isNotNull(), thick))).alias(f"{p}_weighted_avg"))
    if "texture_class" in wide.columns:
        surf = (F.col("depth_bottom_cm") <= 30) & F.col("texture_class").isNotNull()
        aggs.append(F.min_by(F.when(surf, F.col("texture_class")),
                             F.when(surf, F.col("depth_label"))).alias("surface_texture"))
    return rz.groupBy("location_id").agg(*aggs)
