"""Calendar features: date parts, Southern-Hemisphere
seasons, crop calendar flags, cyclical encodings."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verdant.functions import semantics as S

# Fixed values of the reference: month -> season (Southern Hemisphere) and
# the crop-calendar month sets.
SEASON_BY_MONTH = {12: "summer", 1: "summer", 2: "summer", 3: "autumn", 4: "autumn", 5: "autumn",
                   6: "winter", 7: "winter", 8: "winter", 9: "spring", 10: "spring", 11: "spring"}
SEASON_CODE = {"summer": 1, "autumn": 2, "winter": 3, "spring": 4}
CROP_SEASON_MONTHS = {
    "soybean_season": [10, 11, 12, 1, 2, 3, 4],
    "corn_season": [9, 10, 11, 12, 1, 2, 3],
    "wheat_season": [5, 6, 7, 8, 9, 10, 11, 12],
}
CROP_CALENDAR_MONTHS = {
    "soybean_planting": [10, 11, 12], "soybean_flowering": [12, 1], "soybean_harvest": [3, 4],
    "corn_planting": [9, 10, 11], "corn_flowering": [12, 1], "corn_harvest": [2, 3],
    "wheat_planting": [5, 6, 7], "wheat_flowering": [9, 10], "wheat_harvest": [11, 12],
    "critical_period_soybean": [12, 1, 2], "critical_period_corn": [12, 1],
    "critical_period_wheat": [9, 10, 11],
}
EPOCH = "2000-01-01"


def season_name(month) -> F.Column:
    m = S.col(month)
    return (F.when(m.isin(12, 1, 2), "summer").when(m.isin(3, 4, 5), "autumn")
             .when(m.isin(6, 7, 8), "winter").when(m.isin(9, 10, 11), "spring"))


def season_code(month) -> F.Column:
    """X19 numeric season 1-4."""
    m = S.col(month)
    return (F.when(m.isin(12, 1, 2), 1).when(m.isin(3, 4, 5), 2)
             .when(m.isin(6, 7, 8), 3).when(m.isin(9, 10, 11), 4))


def temporal_features(df: DataFrame, ts: str = S.TS) -> DataFrame:
    """X16 date parts, weekend, season, days since 2000-01-01 (+X17, X18)."""
    if ts not in df.columns:
        return df
    d = F.col(ts)
    df = df.withColumns({
        "year": F.year(d), "month": F.month(d), "day": F.dayofmonth(d),
        "day_of_year": F.dayofyear(d), "week_of_year": F.weekofyear(d), "quarter": F.quarter(d),
        "is_weekend": F.dayofweek(d).isin(1, 7).cast("int"),
        "days_since_epoch": F.datediff(d, F.lit(EPOCH)),
    })
    df = df.withColumn("season", season_name("month"))
    df = crop_calendar(df)
    return cyclical(df)


def crop_calendar(df: DataFrame) -> DataFrame:
    """X17 crop season, planting/flowering/harvest and critical-period flags."""
    m = F.col("month")
    flags = {**CROP_SEASON_MONTHS, **CROP_CALENDAR_MONTHS}
    return df.withColumns({k: m.isin(*v).cast("int") for k, v in flags.items()})


def cyclical(df: DataFrame, with_week: bool = True) -> DataFrame:
    """X18 sin/cos of month/12, day-of-year/365 (and ISO week/52)."""
    two_pi = 2 * math.pi
    new = {
        "month_sin": F.sin(F.lit(two_pi) * F.col("month") / 12),
        "month_cos": F.cos(F.lit(two_pi) * F.col("month") / 12),
        "day_of_year_sin": F.sin(F.lit(two_pi) * F.col("day_of_year") / 365),
        "day_of_year_cos": F.cos(F.lit(two_pi) * F.col("day_of_year") / 365),
    }
    if with_week:
        new["week_sin"] = F.sin(F.lit(two_pi) * F.col("week_of_year") / 52)
        new["week_cos"] = F.cos(F.lit(two_pi) * F.col("week_of_year") / 52)
    return df.withColumns(new)


def model_time_features(df: DataFrame, ts: str = S.TS) -> DataFrame:
    """The model-input subset: year, month, doy, ISO week, numeric season, cyclical."""
    d = F.col(ts)
    df = df.withColumns({"year": F.year(d), "month": F.month(d), "day_of_year": F.dayofyear(d),
                         "week_of_year": F.weekofyear(d)})
    df = df.withColumn("season", season_code("month"))
    return cyclical(df, with_week=False)
