"""Data-quality verdicts per series.

Each validator is one pass: per-series window statistics (quantiles, date
gaps) on the already-partitioned data, then one ``groupBy(series)``
aggregate, then messages built with ``filter(array(when ...))``.  The
verdict is a row ``(key, is_valid, quality_score, warnings, errors, ...)``
instead of a dict, so thousands of series are validated by one job.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verdant.functions import semantics as S
from verdant.functions.semantics import KEY, TS
from verdant.operators.comoments import pair_correlations

SAT_REQUIRED = ["NDVI", "NDWI_Gao", "date"]
SAT_OUTLIER_COLS = ["NDVI", "NDWI_Gao", "EVI", "SAVI"]
WEATHER_REQUIRED = ["T2M", "PRECTOTCORR"]


def missing_columns(df: DataFrame, required) -> list[str]:
    """U3 required columns absent from the frame (plan-time set difference)."""
    return [c for c in required if c not in df.columns]


def column_presence(df: DataFrame, required, *, key=KEY) -> DataFrame:
    """U3 per series and required column: whether the frame has it and how
    many of the series' rows lack a value (all of them if it does not)."""
    g = df.groupBy(key).agg(F.count("*").alias("__n"), *[F.count(c).alias(f"__c{i}") for i, c in enumerate(required)
                                                         if c in df.columns])
    rows = F.explode(F.array(*[F.struct(
        F.lit(c).alias("column"), F.lit(c in df.columns).alias("present"),
        (F.col("__n") - (F.col(f"__c{i}") if c in df.columns else 0)).alias("n_missing"))
        for i, c in enumerate(required)]))
    return g.select(key, rows.alias("r")).select(key, "r.*")


def _messages(*pairs) -> Column:
    """Array of the messages whose condition holds, in order."""
    return F.filter(F.array(*[F.when(F.coalesce(cond, F.lit(False)), msg) for cond, msg in pairs]),
                    lambda m: m.isNotNull())


def _fmt1(x: Column) -> Column:
    return F.format_string("%.1f", x)


def _days(x: Column) -> Column:
    """Gap days printed like a pandas float (``35.0``)."""
    return F.concat(x.cast("bigint").cast("string"), F.lit(".0"))


def validate_satellite(df: DataFrame, *, key=KEY, ts=TS) -> DataFrame:
    """Q1 range, missing share, temporal gap and 3-IQR outlier checks."""
    miss = missing_columns(df, SAT_REQUIRED)
    if miss:
        msg = f"Missing required columns: {miss}"
        return df.select(key).distinct().select(
            key, F.lit(False).alias("is_valid"), F.lit(1.0).alias("quality_score"),
            F.array().cast("array<string>").alias("warnings"), F.array(F.lit(msg)).alias("errors"))
    value_cols = [c for c in df.columns if c != key]
    w = S.whole(key)
    out_cols = [c for c in value_cols if c in SAT_OUTLIER_COLS]
    d = df.withColumn("__gap", F.datediff(F.col(ts), S.lag(ts, 1, key, ts)))
    d = d.withColumns({**{f"__q1_{c}": F.percentile(c, 0.25).over(w) for c in out_cols},
                       **{f"__q3_{c}": F.percentile(c, 0.75).over(w) for c in out_cols}})
    aggs = [F.count("*").alias("n"),
            F.count_if((F.col("NDVI") < -1) | (F.col("NDVI") > 1)).alias("ndvi_out_of_range"),
            F.count_if((F.col("NDWI_Gao") < -1) | (F.col("NDWI_Gao") > 1)).alias("ndwi_out_of_range"),
            reduce(lambda a, b: a + b, [F.count_if(F.col(c).isNull()) for c in value_cols]).alias("n_null"),
            F.max("__gap").alias("max_temporal_gap_days")]
    for c in out_cols:
        iqr = F.col(f"__q3_{c}") - F.col(f"__q1_{c}")
        aggs.append(F.count_if((F.col(c) < F.col(f"__q1_{c}") - 3 * iqr) |
                               (F.col(c) > F.col(f"__q3_{c}") + 3 * iqr)).alias(f"outliers_{c}"))
    g = d.groupBy(key).agg(*aggs)
    n = F.col("n").cast("double")
    pct = F.col("n_null") / (n * len(value_cols)) * 100
    g = g.withColumn("missing_data_percentage", pct)
    f_ndvi = F.col("ndvi_out_of_range") > 0
    f_ndwi = F.col("ndwi_out_of_range") > 0
    f_miss_err = F.col("missing_data_percentage") > 50
    f_miss_warn = ~f_miss_err & (F.col("missing_data_percentage") > 20)
    f_gap = (F.col("n") > 1) & (F.col("max_temporal_gap_days") > 30)
    f_out = {c: F.col(f"outliers_{c}") > n * 0.1 for c in out_cols}
    score = F.lit(1.0)
    score = score * F.when(f_ndvi, 1 - F.col("ndvi_out_of_range") / n * 0.5).otherwise(1.0)
    score = score * F.when(f_ndwi, 1 - F.col("ndwi_out_of_range") / n * 0.5).otherwise(1.0)
    score = score * F.when(f_miss_warn, 1 - F.col("missing_data_percentage") / 100 * 0.3).otherwise(1.0)
    score = score * F.when(f_gap, 0.9).otherwise(1.0)
    for c in out_cols:
        score = score * F.when(f_out[c], 0.95).otherwise(1.0)
    g = g.withColumn("quality_score", score)
    warnings = _messages(
        (f_ndvi, F.concat(F.col("ndvi_out_of_range").cast("string"), F.lit(" NDVI values out of range [-1, 1]"))),
        (f_ndwi, F.concat(F.col("ndwi_out_of_range").cast("string"), F.lit(" NDWI values out of range [-1, 1]"))),
        (f_miss_warn, F.concat(F.lit("High missing data: "), _fmt1(F.col("missing_data_percentage")), F.lit("%"))),
        (f_gap, F.concat(F.lit("Large temporal gap: "), _days(F.col("max_temporal_gap_days")), F.lit(" days"))),
        *[(f_out[c], F.concat(F.lit(f"High outlier count in {c}: "), F.col(f"outliers_{c}").cast("string")))
          for c in out_cols])
    errors = _messages(
        (f_miss_err, F.concat(F.lit("Excessive missing data: "), _fmt1(F.col("missing_data_percentage")), F.lit("%"))),
        (F.col("quality_score") < 0.5, F.lit("Overall data quality too low")))
    g = g.withColumns({"warnings": warnings, "errors": errors})
    return g.withColumn("is_valid", F.size("errors") == 0).drop("n", "n_null")


def validate_weather(df: DataFrame, *, key=KEY, ts=TS) -> DataFrame:
    """Q2 temperature / rain plausibility, negative rain, missing variables,
    gaps > 5 days."""
    cols = set(df.columns)
    d = df.withColumn("__gap", F.datediff(F.col(ts), S.lag(ts, 1, key, ts)))
    aggs = [F.count("*").alias("n"), F.max("__gap").alias("max_gap_days")]
    if "T2M" in cols:
        aggs += [F.min("T2M").alias("temp_min"), F.max("T2M").alias("temp_max")]
    if "PRECTOTCORR" in cols:
        aggs += [F.max("PRECTOTCORR").alias("max_daily_precipitation"),
                 F.count_if(F.col("PRECTOTCORR") < 0).alias("negative_precipitation")]
    g = d.groupBy(key).agg(*aggs)
    missing = missing_columns(df, WEATHER_REQUIRED)
    f_temp = ((F.col("temp_min") < -40) | (F.col("temp_max") > 60)) if "T2M" in cols else F.lit(False)
    f_rain = (F.col("max_daily_precipitation") > 200) if "PRECTOTCORR" in cols else F.lit(False)
    f_neg = (F.col("negative_precipitation") > 0) if "PRECTOTCORR" in cols else F.lit(False)
    f_gap = (F.col("n") > 1) & (F.col("max_gap_days") > 5)
    score = (F.lit(1.0) * F.when(f_temp, 0.9).otherwise(1.0) * F.when(f_rain, 0.95).otherwise(1.0)
             * F.lit(0.8 if missing else 1.0) * F.when(f_gap, 0.9).otherwise(1.0))
    warnings = _messages(
        (f_temp, F.concat(F.lit("Extreme temperatures: "), F.col("temp_min").cast("string"), F.lit("°C to "),
                          F.col("temp_max").cast("string"), F.lit("°C"))),
        (f_rain, F.concat(F.lit("Extreme precipitation: "), F.col("max_daily_precipitation").cast("string"),
                          F.lit(" mm/day"))),
        (F.lit(bool(missing)), F.lit(f"Missing weather variables: {missing}")),
        (f_gap, F.concat(F.lit("Weather data gaps up to "), _days(F.col("max_gap_days")), F.lit(" days"))))
    errors = _messages((f_neg, F.concat(F.col("negative_precipitation").cast("string"),
                                        F.lit(" negative precipitation values"))))
    g = g.withColumns({"quality_score": score, "warnings": warnings, "errors": errors})
    return g.withColumn("is_valid", F.size("errors") == 0).drop("n")


def validate_model_inputs(df: DataFrame, features, label: str, target: DataFrame | None = None, *, key=KEY) -> DataFrame:
    """Q3 per series: infinite values and missing share of the feature matrix,
    constant target, and the count of |r| > .95 feature pairs (ordered pairs, as a
    full matrix count minus its diagonal; a constant column does not correlate with
    itself either).  With ``target``, a frame of (key, label) of its own, the label
    is taken from there: other numbers of rows are an error, and so is a series
    without any feature row.  An empty frame gives no rows."""
    feats = list(features)
    x = [F.col(c).cast("double") for c in feats]
    total = lambda cond: reduce(lambda a, b: a + b, [F.count_if(cond(c)) for c in x], F.lit(0))
    g = df.groupBy(key).agg(F.count("*").alias("n"), total(lambda c: c.isNull() | F.isnan(c)).alias("n_null"),
                            total(lambda c: F.abs(c) == float("inf")).alias("infinite_values"))
    y = (df if target is None else target).groupBy(F.col(key).alias("__y")).agg(
        F.count("*").alias("n_target"), F.avg(label).alias("target_mean"), F.stddev_samp(label).alias("target_std"),
        F.min(label).alias("target_min"), F.max(label).alias("target_max"), F.count_distinct(label).alias("target_unique"),
        F.count_if(F.col(label).isNull()).alias("target_null"))
    g = g.join(y, F.col(key).eqNullSafe(F.col("__y")), "full").withColumn(key, F.coalesce(key, "__y")).drop("__y")
    pairs = pair_correlations(df, feats, key).withColumn("w", F.when(F.abs("r") > 0.95, F.when(F.col("i") == F.col("j"), 1).otherwise(2)).otherwise(0))
    pairs = pairs.groupBy(F.col("key").alias("__key")).agg((F.sum("w") - len(feats)).alias("highly_correlated_pairs"))
    g = g.join(pairs, F.col(key).cast("string").eqNullSafe(F.col("__key")), "left").drop("__key")
    g = g.withColumn("target_unique", F.col("target_unique") + F.when(F.col("target_null") > 0, 1).otherwise(0))
    g = g.withColumn("missing_data_percentage", F.col("n_null") / (F.col("n").cast("double") * len(feats)) * 100)
    f_empty = F.col("n").isNull()
    f_err = F.col("missing_data_percentage") > 30
    f_warn = ~f_err & (F.col("missing_data_percentage") > 10)
    f_corr = (F.lit(len(feats) > 1)) & (F.col("highly_correlated_pairs") > len(feats) * 0.5)
    f_length = ~f_empty & ~F.col("n").eqNullSafe(F.col("n_target"))
    score = F.lit(1.0) * F.when(f_warn, 0.9).otherwise(1.0) * F.when(f_corr, 0.8).otherwise(1.0)
    warnings = _messages(
        (f_warn, F.concat(F.lit("High missing data: "), _fmt1(F.col("missing_data_percentage")), F.lit("%"))),
        (f_corr, F.concat(F.lit("Many highly correlated features: "), F.col("highly_correlated_pairs").cast("string"))))
    errors = _messages(
        (f_empty, F.lit("Empty feature matrix")),
        (F.col("infinite_values") > 0, F.concat(F.col("infinite_values").cast("string"), F.lit(" infinite values in features"))),
        (f_err, F.concat(F.lit("Excessive missing data: "), _fmt1(F.col("missing_data_percentage")), F.lit("%"))),
        (f_length, F.lit("Feature and target length mismatch")),
        (~f_empty & (F.col("target_unique") == 1), F.lit("Target variable has no variation")))
    g = g.withColumns({"quality_score": score, "warnings": warnings, "errors": errors})
    return g.withColumn("is_valid", F.size("errors") == 0).drop("n", "n_null", "n_target", "target_null")


def top_issues(results: DataFrame, cols=("warnings", "errors"), k: int = 5) -> DataFrame:
    """T3 the ``k`` most frequent warnings and errors (ties by text)."""
    m = results.select(F.explode(F.concat(*cols)).alias("message")).groupBy("message").agg(F.count("*").alias("count"))
    return m.orderBy(F.desc("count"), F.asc("message")).limit(k)


def quality_report(results: DataFrame) -> DataFrame:
    """A21 pass / fail counts, mean score and text-matched recommendations
    over many validation verdicts (one row)."""
    g = results.agg(F.count("*").alias("total_validations"),
                    F.count_if(F.col("is_valid")).alias("passed_validations"),
                    F.count_if(~F.col("is_valid")).alias("failed_validations"),
                    F.avg("quality_score").alias("average_quality_score"),
                    F.max(F.exists(F.concat("warnings", "errors"),
                                   lambda m: F.lower(m).contains("missing data"))).alias("__miss"),
                    F.max(F.exists(F.concat("warnings", "errors"),
                                   lambda m: F.lower(m).contains("outlier"))).alias("__out"))
    recs = _messages(
        (F.col("average_quality_score") < 0.7,
         F.lit("Overall data quality is low - review data collection processes")),
        (F.coalesce(F.col("__miss"), F.lit(False)),
         F.lit("Address missing data through improved collection or interpolation")),
        (F.coalesce(F.col("__out"), F.lit(False)), F.lit("Implement outlier detection and correction procedures")))
    return g.withColumn("recommendations", recs).drop("__miss", "__out")
