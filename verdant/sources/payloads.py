"""Readers for landed source payloads.

Fetching from the remote services is out of scope: those documents land
as JSON files (one document per location and request period) and Spark
starts from there.  ``spark.read.schema(...).json(path)`` or ``from_json``
on a text column both feed the parsers below; every parser is a chain of
``explode``s and column expressions with a fixed output schema, so a
malformed document yields NULLs rather than a failed job.

The ``*_payload`` builders re-create such documents from the driver's
tables for tests (bounded: one document per location-year).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed values of the reference: requested weather parameters and the
# service's missing-value marker.
WEATHER_PARAMS = ["T2M", "T2M_MAX", "T2M_MIN", "PRECTOTCORR", "EVPTRNS"]
MISSING = -999.0

WEATHER_SCHEMA = T.StructType([T.StructField("properties", T.StructType([
    T.StructField("parameter", T.MapType(T.StringType(), T.MapType(T.StringType(), T.DoubleType())))]))])

SOIL_SCHEMA = T.StructType([T.StructField("properties", T.StructType([
    T.StructField("layers", T.ArrayType(T.StructType([
        T.StructField("name", T.StringType()),
        T.StructField("unit_measure", T.StructType([T.StructField("mapped_units", T.StringType())])),
        T.StructField("depths", T.ArrayType(T.StructType([
            T.StructField("label", T.StringType()),
            T.StructField("range", T.StructType([T.StructField("top_depth", T.IntegerType()),
                                                 T.StructField("bottom_depth", T.IntegerType())])),
            T.StructField("values", T.StructType([T.StructField("mean", T.DoubleType())])),
        ]))),
    ])))]))])

SCENE_SCHEMA = T.StructType([T.StructField("features", T.ArrayType(T.StructType([
    T.StructField("properties", T.MapType(T.StringType(), T.DoubleType()))])))])


# ------------------------------------------------------------------ S1 --

def parse_weather(docs: DataFrame, payload: str = "payload", location: str = "location_id",
                  params=WEATHER_PARAMS) -> DataFrame:
    """S1 map(param -> map(yyyymmdd -> value)) documents to one wide row per
    (location, day); -999 -> NULL; unparseable day keys skipped."""
    p = docs.select(F.col(location).alias("location_id"),
                    F.from_json(F.col(payload), WEATHER_SCHEMA)["properties"]["parameter"].alias("m"))
    long_ = (p.select("location_id", F.explode("m").alias("param", "series"))
              .select("location_id", "param", F.explode("series").alias("day", "value"))
              .withColumn("date", F.try_to_date(F.col("day"), "yyyyMMdd"))
              .where(F.col("date").isNotNull()))
    long_ = long_.withColumn("value", F.when(F.col("value") != MISSING, F.col("value")))
    return long_.groupBy("location_id", "date").pivot("param", list(params)).agg(F.max("value"))


def weather_payload(daily: DataFrame, key: str = "series_id") -> DataFrame:
    """Re-create weather documents (one per location-year) from a daily table;
    NULL -> -999 and one invalid day key per parameter and document."""
    cols = {"T2M": "T2M", "T2M_MAX": "T2M_MAX", "T2M_MIN": "T2M_MIN", "PRECTOTCORR": "PRECTOTCORR",
            "EVPTRNS": "PET_PT_JPL"}
    x = daily.select(F.col(key).alias("location_id"), F.year("date").alias("yr"),
                     F.date_format("date", "yyyyMMdd").alias("day"),
                     F.explode(F.array(*[F.struct(F.lit(p).alias("param"),
                                                  F.coalesce(F.col(c), F.lit(MISSING)).alias("v"))
                                         for p, c in cols.items()])).alias("e"))
    per_param = (x.groupBy("location_id", "yr", F.col("e.param").alias("param"))
                  .agg(F.map_from_entries(F.collect_list(F.struct("day", F.col("e.v")))).alias("m")))
    per_param = per_param.withColumn(
        "m", F.map_concat("m", F.create_map(F.concat(F.col("yr").cast("string"), F.lit("0230")), F.lit(1.0))))
    doc = per_param.groupBy("location_id", "yr").agg(
        F.map_from_entries(F.collect_list(F.struct("param", "m"))).alias("parameter"))
    return doc.select("location_id", "yr", F.to_json(F.struct(F.struct("parameter").alias("properties")))
                      .alias("payload"))


# ------------------------------------------------------------------ S2 --

def parse_soil(docs: DataFrame, payload: str = "payload", location: str = "location_id") -> DataFrame:
    """S2 layers[].depths[] to long rows; depths without a mean are dropped."""
    p = docs.select(F.col(location).alias("location_id"),
                    F.from_json(F.col(payload), SOIL_SCHEMA)["properties"]["layers"].alias("layers"))
    lay = p.select("location_id", F.explode("layers").alias("l"))
    dep = lay.select("location_id", F.col("l.name").alias("property"),
                     F.col("l.unit_measure.mapped_units").alias("unit"), F.explode("l.depths").alias("d"))
    return dep.select("location_id", "property", F.col("d.label").alias("depth_label"),
                      F.coalesce(F.col("d.range.top_depth"), F.lit(0)).alias("depth_top_cm"),
                      F.coalesce(F.col("d.range.bottom_depth"), F.lit(0)).alias("depth_bottom_cm"),
                      F.col("d.values.mean").alias("value"), "unit").where(F.col("value").isNotNull())


def soil_payload(soil_long: DataFrame) -> DataFrame:
    """Re-create soil documents (one per location) from long rows, adding an
    all-missing ``soc`` layer to every document."""
    depth = F.struct(F.col("depth_label").alias("label"),
                     F.struct(F.col("depth_top_cm").alias("top_depth"),
                              F.col("depth_bottom_cm").alias("bottom_depth")).alias("range"),
                     F.struct(F.col("value").alias("mean")).alias("values"))
    layers = (soil_long.groupBy("location_id", "property", "unit")
                       .agg(F.collect_list(depth).alias("depths"))
                       .select("location_id", F.struct(F.col("property").alias("name"),
                                                       F.struct(F.col("unit").alias("mapped_units"))
                                                        .alias("unit_measure"), "depths").alias("layer")))
    empty = F.struct(F.lit("soc").alias("name"), F.struct(F.lit("g/kg").alias("mapped_units")).alias("unit_measure"),
                     F.array(F.struct(F.lit("0-5cm").alias("label"),
                                      F.struct(F.lit(0).alias("top_depth"), F.lit(5).alias("bottom_depth")).alias("range"),
                                      F.struct(F.lit(None).cast("double").alias("mean")).alias("values"))).alias("depths"))
    doc = layers.groupBy("location_id").agg(F.collect_list("layer").alias("layers"))
    doc = doc.withColumn("layers", F.concat("layers", F.array(empty)))
    return doc.select("location_id", F.to_json(F.struct(F.struct("layers").alias("properties"))).alias("payload"))


# ------------------------------------------------------------------ S3 --

# Fixed values of the reference: default soil profile (property, value, unit)
# and its three depths (label, top cm, bottom cm).
DEFAULT_SOIL = [("bdod", 1400.0, "g/dm3"), ("clay", 25.0, "%"), ("sand", 45.0, "%"), ("silt", 30.0, "%"),
                ("phh2o", 6.5, "pH"), ("soc", 2.0, "%")]
DEFAULT_DEPTHS = [("0-5cm", 0, 5), ("5-15cm", 5, 15), ("15-30cm", 15, 30)]


def default_soil_rows():
    return F.array(*[F.struct(F.lit(p).alias("property"), F.lit(lbl).alias("depth_label"),
                              F.lit(a).alias("depth_top_cm"), F.lit(b).alias("depth_bottom_cm"),
                              F.lit(v).alias("value"), F.lit(u).alias("unit"))
                     for p, v, u in DEFAULT_SOIL for lbl, a, b in DEFAULT_DEPTHS])


def fill_default_soil(soil_long: DataFrame, locations: DataFrame) -> DataFrame:
    """S3 locations without any soil row receive the 6 x 3 default profile.
    Anti-join on the location key, then a fixed 18-row explode per missing
    location (no cross join)."""
    missing = locations.select("location_id").distinct().join(
        soil_long.select("location_id").distinct(), "location_id", "left_anti")
    dflt = missing.select("location_id", F.explode(default_soil_rows()).alias("r")).select(
        "location_id", "r.property", "r.depth_label", "r.depth_top_cm", "r.depth_bottom_cm", "r.value", "r.unit")
    return soil_long.unionByName(dflt)


# ------------------------------------------------------------------ S4 --

def parse_scene_stats(docs: DataFrame, bands, payload: str = "payload", key: str = "region_id") -> DataFrame:
    """S4 feature collection -> one row per feature with a ``date``
    (epoch ms -> UTC timestamp); features without a date are skipped."""
    f = docs.select(key, F.explode(F.from_json(F.col(payload), SCENE_SCHEMA)["features"]).alias("f"))
    props = F.col("f.properties")
    ms = F.element_at(props, F.lit("date")).cast("bigint")
    f = f.where(ms.isNotNull())
    return f.select(key, F.timestamp_millis(ms).alias("scene_ts"),
                    F.date_from_unix_date(F.floor(ms / 86400000).cast("int")).alias("date"),
                    *[F.element_at(props, F.lit(b)).alias(b) for b in bands])


def scene_payload(region_means: DataFrame, bands, key: str = "region_id") -> DataFrame:
    """Re-create feature collections (one per region-year) from region means,
    plus one feature without a date per document."""
    props = F.map_concat(F.create_map(F.lit("date"),
                                      (F.unix_date(F.col("date")).cast("bigint") * 86400000).cast("double")),
                         F.create_map(*[x for b in bands for x in (F.lit(b), F.col(b))]))
    rows = region_means.select(key, F.year("date").alias("yr"), F.struct(props.alias("properties")).alias("feat"))
    nodate = F.struct(F.create_map(F.lit(bands[0]), F.lit(0.0)).alias("properties"))
    doc = rows.groupBy(key, "yr").agg(F.collect_list("feat").alias("features"))
    doc = doc.withColumn("features", F.concat("features", F.array(nodate)))
    return doc.select(key, "yr", F.to_json(F.struct("features")).alias("payload"))
