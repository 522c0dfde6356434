"""Static dimension tables: crops, growth stages, alert
thresholds, irrigation rates, stress bands and zones.

They are a handful of rows each, so they are both available as small
DataFrames (for broadcast joins whose size is fixed by this file) and as
literal maps that compile straight into expressions (no join at all).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# Fixed values of the reference: crop parameters.
# name: (season start month, season end month, critical stages,
#        NDVI healthy min, NDVI healthy max, NDWI stress, CWSI stress,
#        water need mm/day, rooting depth cm, sensitivity 1-10)
CROPS = {
    "soybean": (10, 4, ["emergence", "flowering", "pod_filling"], 0.7, 0.9, 0.3, 0.4, 5.5, 120, 7.5),
    "corn": (9, 3, ["emergence", "tasseling", "grain_filling"], 0.75, 0.95, 0.25, 0.35, 6.0, 150, 8.0),
    "wheat": (5, 12, ["tillering", "flowering", "grain_filling"], 0.6, 0.85, 0.35, 0.45, 4.0, 100, 6.5),
}

# Fixed values of the reference: growth-stage calendar (stage, start month,
# end month) in the order stages are tested.
GROWTH_STAGES = {
    "soybean": [("emergence", 10, 11), ("flowering", 12, 1), ("pod_filling", 1, 3)],
    "corn": [("emergence", 9, 10), ("tasseling", 12, 1), ("grain_filling", 1, 3)],
    "wheat": [("tillering", 6, 8), ("flowering", 9, 10), ("grain_filling", 10, 12)],
}

# Fixed values of the reference: alert thresholds per crop.
ALERT_THRESHOLD_NAMES = [
    "ndvi_critical", "ndvi_warning", "ndwi_critical", "ndwi_warning", "cwsi_critical", "cwsi_warning",
    "water_balance_critical", "water_balance_warning", "temp_stress_critical", "temp_stress_warning",
    "consecutive_dry_days_critical", "consecutive_dry_days_warning",
]
ALERT_THRESHOLDS = {
    "soybean": (0.6, 0.7, 0.2, 0.3, 0.6, 0.4, -30, -15, 35, 32, 14, 10),
    "corn": (0.65, 0.75, 0.15, 0.25, 0.5, 0.35, -40, -20, 38, 35, 12, 8),
    "wheat": (0.5, 0.65, 0.25, 0.35, 0.65, 0.45, -25, -10, 32, 30, 16, 12),
}
DEFAULT_CROP = "soybean"


def crop_dim(spark: SparkSession) -> DataFrame:
    """S6 crop dimension (3 rows)."""
    rows = [(k, *v) for k, v in CROPS.items()]
    return spark.createDataFrame(rows, "crop string, season_start int, season_end int, "
                                       "critical_growth_stages array<string>, ndvi_min double, "
                                       "ndvi_max double, ndwi_stress double, cwsi_stress double, "
                                       "water_mm_day double, rooting_depth_cm int, sensitivity double")


def stage_dim(spark: SparkSession) -> DataFrame:
    """S6 growth-stage calendar with its test order."""
    rows = [(c, i, s, a, b) for c, st in GROWTH_STAGES.items() for i, (s, a, b) in enumerate(st)]
    return spark.createDataFrame(rows, "crop string, stage_order int, stage string, "
                                       "start_month int, end_month int")


def threshold_dim(spark: SparkSession) -> DataFrame:
    """S7 alert thresholds, one row per crop."""
    rows = [(c, *map(float, v)) for c, v in ALERT_THRESHOLDS.items()]
    return spark.createDataFrame(rows, "crop string, " + ", ".join(f"{n} double" for n in ALERT_THRESHOLD_NAMES))


def _lit_map(d: dict) -> Column:
    return F.create_map(*[x for k, v in d.items() for x in (F.lit(k), F.lit(v))])


def in_month_span(month: Column, start: Column, end: Column) -> Column:
    """start..end inclusive, wrapping over New Year when start > end."""
    return F.when(start <= end, (month >= start) & (month <= end)).otherwise((month >= start) | (month <= end))


def is_growing_season(crop: Column, date: Column) -> Column:
    """X20 month inside the crop's season; unknown crop -> false."""
    c = F.lower(crop)
    start = F.element_at(_lit_map({k: v[0] for k, v in CROPS.items()}), c)
    end = F.element_at(_lit_map({k: v[1] for k, v in CROPS.items()}), c)
    return F.when(start.isNull(), F.lit(False)).otherwise(in_month_span(F.month(date), start, end))


def growth_stage(crop: Column, date: Column) -> Column:
    """X21 first stage (in calendar order) containing the month; none ->
    'vegetative'; unknown crop -> 'unknown'.  Compiled to one CASE."""
    c = F.lower(crop)
    m = F.month(date)
    expr = None
    for name, stages in GROWTH_STAGES.items():
        for stage, a, b in stages:
            cond = (c == name) & in_month_span(m, F.lit(a), F.lit(b))
            expr = F.when(cond, stage) if expr is None else expr.when(cond, stage)
    known = c.isin(list(GROWTH_STAGES))
    return F.when(~known | c.isNull(), F.lit("unknown")).otherwise(expr.otherwise(F.lit("vegetative")))


def crop_threshold(crop: Column, name: str) -> Column:
    """J6 threshold lookup; unknown crop falls back to soybean."""
    i = ALERT_THRESHOLD_NAMES.index(name)
    m = _lit_map({k: float(v[i]) for k, v in ALERT_THRESHOLDS.items()})
    return F.coalesce(F.element_at(m, F.lower(crop)), F.lit(float(ALERT_THRESHOLDS[DEFAULT_CROP][i])))


def crop_param(crop: Column, idx: int, default=None) -> Column:
    m = _lit_map({k: v[idx] for k, v in CROPS.items()})
    v = F.element_at(m, F.lower(crop))
    return v if default is None else F.coalesce(v, F.lit(default))
