"""Fixture views over the driver's parquet tables (see FIXTURES.md part B).

Each view is defined twice, identically: as a Spark DataFrame builder and as
a SQL common-table expression used by the DuckDB oracle.  Inputs are scaled
to integers before aggregation so sums do not depend on evaluation order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


# ---------------------------------------------------------------- daily ---
# One row per (series_id, date): a series for each flag, status and station of
# 250 suppliers, so the number of series grows with the data (6 at sf0.01, 24 at
# sf0.1, 240 at sf1).  The key is unique by construction, so every
# window over it is deterministic; a series holds at most one row per day,
# which bounds the size of any window partition by the calendar, not the data.

def daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    disc = F.round(F.col("l_discount") * 100).cast("bigint")
    tax = F.round(F.col("l_tax") * 100).cast("bigint")
    qty = F.col("l_quantity").cast("bigint")
    station = F.floor(F.col("l_suppkey") / 250).cast("string")
    g = (li.groupBy(F.concat("l_returnflag", "l_linestatus", F.when(station == "0", "").otherwise(F.concat(F.lit("-"), station))).alias("series_id"),
                    F.to_date("l_shipdate").alias("date"))
           .agg(F.avg(disc).alias("a_disc"), F.avg(tax).alias("a_tax"), F.max(tax).alias("m_tax"),
                F.avg(qty).alias("a_qty"), F.max(qty).alias("mx_qty"), F.min(qty).alias("mn_qty"),
                F.avg(F.col("l_linenumber").cast("bigint")).alias("a_line"), F.avg(F.floor("l_extendedprice")).alias("a_price"),
                F.avg((F.col("l_partkey") % 1000).cast("bigint")).alias("a_part"), F.avg((F.col("l_suppkey") % 100).cast("bigint")).alias("a_supp")))
    tmax = F.lit(8.0) + F.lit(0.56) * F.col("mx_qty")
    tmin = F.lit(0.3) * F.col("mn_qty")
    return g.select(
        "series_id", "date",
        (F.lit(0.30) + F.lit(0.06) * F.col("a_disc")).alias("NDVI"),
        tmax.alias("T2M_MAX"),
        tmin.alias("T2M_MIN"),
        ((tmax + tmin) / 2).alias("T2M"),
        F.greatest(F.lit(0.9) * F.col("m_tax") - F.lit(3.0), F.lit(0.0)).alias("PRECTOTCORR"),
        (F.col("a_price") / 9000).alias("PET_PT_JPL"),
        (F.lit(0.05) + F.lit(0.07) * F.col("a_tax")).alias("NDWI_Gao"),
        (F.lit(0.25) + F.lit(0.06) * F.col("a_line")).alias("GNDVI"),
        (F.lit(0.15) + F.lit(0.006) * F.col("a_supp")).alias("EVI"),
        (F.lit(0.20) + F.lit(0.0006) * F.col("a_part")).alias("SAVI"),
        (F.lit(1.0) - F.col("a_qty") / 50).alias("CWSI"),
    )


DAILY_SQL = """
daily AS (
  SELECT series_id, date,
         0.30 + 0.06 * a_disc AS NDVI,
         8.0 + 0.56 * CAST(mx_qty AS DOUBLE) AS T2M_MAX,
         0.3 * CAST(mn_qty AS DOUBLE) AS T2M_MIN,
         ((8.0 + 0.56 * CAST(mx_qty AS DOUBLE)) + (0.3 * CAST(mn_qty AS DOUBLE))) / 2 AS T2M,
         greatest(0.9 * CAST(m_tax AS DOUBLE) - 3.0, 0.0) AS PRECTOTCORR,
         a_price / 9000 AS PET_PT_JPL,
         0.05 + 0.07 * a_tax AS NDWI_Gao,
         0.25 + 0.06 * a_line AS GNDVI,
         0.15 + 0.006 * a_supp AS EVI,
         0.20 + 0.0006 * a_part AS SAVI,
         1.0 - a_qty / 50 AS CWSI
  FROM (
    SELECT l_returnflag || l_linestatus || CASE WHEN l_suppkey < 250 THEN '' ELSE '-' || CAST(l_suppkey // 250 AS VARCHAR) END AS series_id,
           CAST(l_shipdate AS DATE) AS date,
           avg(CAST(round(l_discount * 100) AS BIGINT)) AS a_disc,
           avg(CAST(round(l_tax * 100) AS BIGINT)) AS a_tax,
           max(CAST(round(l_tax * 100) AS BIGINT)) AS m_tax,
           avg(CAST(l_quantity AS BIGINT)) AS a_qty,
           max(CAST(l_quantity AS BIGINT)) AS mx_qty,
           min(CAST(l_quantity AS BIGINT)) AS mn_qty,
           avg(CAST(l_linenumber AS BIGINT)) AS a_line,
           avg(CAST(floor(l_extendedprice) AS BIGINT)) AS a_price,
           avg(CAST(l_partkey % 1000 AS BIGINT)) AS a_part,
           avg(CAST(l_suppkey % 100 AS BIGINT)) AS a_supp
    FROM lineitem
    GROUP BY 1, 2
  ) g
)"""
# (integer aggregates are cast to DOUBLE before they meet decimal literals,
#  so DuckDB does the same double arithmetic as Spark instead of exact
#  DECIMAL products)

DAILY_VALUE_COLS = ["NDVI", "T2M_MAX", "T2M_MIN", "T2M", "PRECTOTCORR", "PET_PT_JPL",
                    "NDWI_Gao", "GNDVI", "EVI", "SAVI", "CWSI"]


def daily_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``daily`` with every measure NULL on days where dayofyear % 11 == 0."""
    d = daily(spark, sf_dir)
    hole = (F.dayofyear("date") % 11) == 0
    return d.select("series_id", "date",
                    *[F.when(~hole, F.col(c)).alias(c) for c in DAILY_VALUE_COLS])


DAILY_GAPS_SQL = DAILY_SQL + """,
daily_gaps AS (
  SELECT series_id, date, """ + ", ".join(
    f"CASE WHEN dayofyear(date) % 11 <> 0 THEN {c} END AS {c}" for c in DAILY_VALUE_COLS) + """
  FROM daily
)"""


def with_sql(*ctes: str) -> str:
    """Join CTE bodies into one WITH prefix (deduplicating shared parts)."""
    parts: list[str] = []
    for block in ctes:
        for piece in _split_ctes(block):
            if piece not in parts:
                parts.append(piece)
    return "WITH " + ",\n".join(parts) + "\n"


def _split_ctes(block: str) -> list[str]:
    # CTE blocks in this module are joined by ",\n<name> AS (" at top level
    out, depth, cur = [], 0, []
    for ch in block:
        if ch == "(":
            depth += 1
        elif ch == ")":
            depth -= 1
        if ch == "," and depth == 0:
            out.append("".join(cur).strip())
            cur = []
            continue
        cur.append(ch)
    if "".join(cur).strip():
        out.append("".join(cur).strip())
    return out


# ---------------------------------------------------------------- pixel ---
# One row per lineitem = one pixel observation of one scene.

def pixel(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    return li.select(
        F.col("l_returnflag").alias("region_id"),
        F.col("l_shipdate").alias("scene_ts"),
        F.to_date("l_shipdate").alias("date"),
        (F.col("l_partkey") % 100).alias("x"),
        (F.col("l_suppkey") % 100).alias("y"),
        (F.lit(-65.0) + (F.col("l_partkey") % 100) * 0.01).alias("lon"),
        (F.lit(-38.0) + (F.col("l_suppkey") % 100) * 0.01).alias("lat"),
        F.col("l_tax").alias("green"),
        F.col("l_discount").alias("red"),
        (F.col("l_quantity") / 50).alias("nir"),
        (F.col("l_tax") / 2).alias("blue"),
        (F.col("l_extendedprice") / 105000).alias("swir"),
        ((F.col("l_partkey") * 37) % 4096).alias("qa"),
        (F.col("l_suppkey") % 100).cast("double").alias("cloud_pct"),
        (F.lit(40000.0) + F.col("l_quantity") * 100).alias("st_dn"),
    )


PIXEL_SQL = """
pixel AS (
  SELECT l_returnflag AS region_id, l_shipdate AS scene_ts, CAST(l_shipdate AS DATE) AS date,
         l_partkey % 100 AS x, l_suppkey % 100 AS y,
         -65.0 + CAST(l_partkey % 100 AS DOUBLE) * 0.01 AS lon, -38.0 + CAST(l_suppkey % 100 AS DOUBLE) * 0.01 AS lat,
         l_tax AS green, l_discount AS red, l_quantity / 50 AS nir, l_tax / 2 AS blue,
         l_extendedprice / 105000 AS swir, (l_partkey * 37) % 4096 AS qa,
         CAST(l_suppkey % 100 AS DOUBLE) AS cloud_pct,
         40000.0 + l_quantity * 100 AS st_dn
  FROM lineitem
)"""


# Crop grown on each fixture series (one unknown crop exercises the fallbacks).
def series_crop(series_col: str = "series_id"):
    s = F.col(series_col)
    return (F.when(s.startswith("A"), "soybean").when(s.startswith("N"), "corn")
             .when(s.startswith("RF"), "wheat").otherwise("barley"))


SERIES_CROP_SQL = ("CASE WHEN series_id LIKE 'A%' THEN 'soybean' WHEN series_id LIKE 'N%' THEN 'corn' "
                   "WHEN series_id LIKE 'RF%' THEN 'wheat' ELSE 'barley' END")


# ------------------------------------------------------------ soil_long ---
# part x 6 depths; parts with key % 7 == 0 report texture in g/kg, parts
# with key % 13 == 0 have no bulk density.  Suppliers have no soil rows (S3).

DEPTHS = [("0-5cm", 0, 5), ("5-15cm", 5, 15), ("15-30cm", 15, 30), ("30-60cm", 30, 60),
          ("60-100cm", 60, 100), ("100-200cm", 100, 200)]


#: Parts whose soil rows (24 each) one task makes, about.
SOIL_PARTS = 25_000


def soil_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select("p_partkey", "p_size")
    # a small file is read by one task, however many soil rows come of it: parts are dealt to tasks by their number
    p = p.repartition(max(spark.sparkContext.defaultParallelism, -(-p.count() // SOIL_PARTS)), "p_partkey")
    depth = F.explode(F.array(*[F.struct(F.lit(i).alias("d"), F.lit(lbl).alias("depth_label"),
                                         F.lit(a).alias("depth_top_cm"), F.lit(b).alias("depth_bottom_cm"))
                                for i, (lbl, a, b) in enumerate(DEPTHS)]))
    x = p.select("p_partkey", "p_size", depth.alias("dd")).select("p_partkey", "p_size", "dd.*")
    k = F.when(F.col("p_partkey") % 7 == 0, 10.0).otherwise(1.0)
    sand = (F.col("p_size") + 5 * F.col("d")).cast("double")
    clay = ((F.col("p_partkey") + F.col("d")) % 50).cast("double")
    props = F.array(
        F.struct(F.lit("sand").alias("property"), (sand * k).alias("value"), F.lit("%").alias("unit")),
        F.struct(F.lit("clay").alias("property"), (clay * k).alias("value"), F.lit("%").alias("unit")),
        F.struct(F.lit("silt").alias("property"), ((F.lit(100.0) - sand - clay) * k).alias("value"),
                 F.lit("%").alias("unit")),
        F.struct(F.lit("bdod").alias("property"),
                 F.when(F.col("p_partkey") % 13 != 0, (F.lit(100.0) + F.col("p_size") + 10 * F.col("d")))
                  .alias("value"), F.lit("cg/cm3").alias("unit")))
    y = x.select(F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("location_id"),
                 "depth_label", "depth_top_cm", "depth_bottom_cm", F.explode(props).alias("pr"))
    return y.select("location_id", "pr.property", "depth_label", "depth_top_cm", "depth_bottom_cm",
                    "pr.value", "pr.unit").where(F.col("value").isNotNull())


SOIL_LONG_SQL = """
soil_depths(d, depth_label, depth_top_cm, depth_bottom_cm) AS (
  VALUES (0, '0-5cm', 0, 5), (1, '5-15cm', 5, 15), (2, '15-30cm', 15, 30), (3, '30-60cm', 30, 60),
         (4, '60-100cm', 60, 100), (5, '100-200cm', 100, 200)
),
soil_base AS (
  SELECT 'p' || CAST(p_partkey AS VARCHAR) AS location_id, p_partkey, depth_label, depth_top_cm, depth_bottom_cm,
         CAST(p_size + 5 * d AS DOUBLE) AS sand, CAST((p_partkey + d) % 50 AS DOUBLE) AS clay,
         CASE WHEN p_partkey % 7 = 0 THEN 10.0 ELSE 1.0 END AS k,
         CASE WHEN p_partkey % 13 <> 0 THEN 100.0 + p_size + 10 * d END AS bdod
  FROM part, soil_depths
),
soil_long AS (
  SELECT location_id, 'sand' AS property, depth_label, depth_top_cm, depth_bottom_cm, sand * k AS value, '%' AS unit FROM soil_base
  UNION ALL SELECT location_id, 'clay', depth_label, depth_top_cm, depth_bottom_cm, clay * k, '%' FROM soil_base
  UNION ALL SELECT location_id, 'silt', depth_label, depth_top_cm, depth_bottom_cm, (100.0 - sand - clay) * k, '%' FROM soil_base
  UNION ALL SELECT location_id, 'bdod', depth_label, depth_top_cm, depth_bottom_cm, bdod, 'cg/cm3' FROM soil_base WHERE bdod IS NOT NULL
)"""


# -------------------------------------------------------- storage_index ---
# Fixed mapping of order priority to a stored data type (priority 1 is the
# only essential one).
PRIORITY_TYPE = {"1-URGENT": "model_parameters", "2-HIGH": "raw_satellite_data",
                 "3-MEDIUM": "intermediate_calculations", "4-NOT SPECIFIED": "temp_weather_data",
                 "5-LOW": "debug_outputs"}


def storage_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    dt = F.element_at(F.create_map(*[x for k, v in PRIORITY_TYPE.items() for x in (F.lit(k), F.lit(v))]),
                      F.col("o_orderpriority"))
    return o.select(F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("identifier"),
                    dt.alias("data_type"), F.col("o_orderdate").alias("timestamp"),
                    (F.col("o_totalprice") / 1000).alias("size_mb"),
                    F.create_map(F.lit("status"), F.col("o_orderstatus"),
                                 F.lit("customer"), F.col("o_custkey").cast("string")).alias("metadata"))


STORAGE_SQL = """
storage_records AS (
  SELECT 'o' || CAST(o_orderkey AS VARCHAR) AS identifier,
         CASE o_orderpriority WHEN '1-URGENT' THEN 'model_parameters' WHEN '2-HIGH' THEN 'raw_satellite_data'
              WHEN '3-MEDIUM' THEN 'intermediate_calculations' WHEN '4-NOT SPECIFIED' THEN 'temp_weather_data'
              WHEN '5-LOW' THEN 'debug_outputs' END AS data_type,
         o_orderdate AS timestamp, o_totalprice / 1000 AS size_mb
  FROM orders
),
storage_index AS (
  SELECT *, data_type IN ('model_parameters', 'prescription_maps', 'alert_history', 'crop_parameters',
                          'validation_results') AS is_essential,
         CASE WHEN data_type IN ('model_parameters', 'prescription_maps', 'alert_history', 'crop_parameters',
                                 'validation_results') THEN NULL ELSE 30 END AS retention_days
  FROM storage_records
)"""


# --------------------------------------------------------------- region ---
# nation x region: one analysis region per nation.  The id starts with a
# province token chosen by n_nationkey % 6 so every province rule fires;
# the ring is a 4 x .4 degree rectangle holding the nation's suppliers.
PROVINCE_TOKENS = ["buenos_aires", "cordoba", "santa_fe", "entre_rios", "la_pampa", "chaco"]
REGION_CROPS = {0: ["soybean", "corn", "wheat"], 1: ["soybean", "corn"], 2: ["soybean"], 3: ["corn", "wheat"],
                4: ["wheat"]}


def region_dim(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation")
    tok = F.element_at(F.array(*[F.lit(t) for t in PROVINCE_TOKENS]), (F.col("n_nationkey") % 6 + 1).cast("int"))
    lat0 = F.lit(-36.2) + F.col("n_nationkey") * 0.4
    x0, x1 = F.lit(-65.05), F.lit(-61.05)
    ring = F.array(F.array(x0, lat0), F.array(x1, lat0), F.array(x1, lat0 + 0.4), F.array(x0, lat0 + 0.4),
                   F.array(x0, lat0))
    crops = F.element_at(F.create_map(*[x for k, v in REGION_CROPS.items()
                                        for x in (F.lit(k), F.array(*[F.lit(c) for c in v]))]), F.col("n_regionkey"))
    return n.select(
        F.concat(tok, F.lit("_"), F.lower(F.regexp_replace("n_name", " ", "_"))).alias("region_id"),
        F.col("n_name").alias("name"), F.col("n_nationkey").alias("region_order"), ring.alias("geometry"),
        crops.alias("crops"),
        F.when(F.col("n_regionkey") <= 2, "high").when(F.col("n_regionkey") == 3, "medium").otherwise("low")
         .alias("priority"))


REGION_SQL = """
region_dim AS (
  SELECT (['buenos_aires', 'cordoba', 'santa_fe', 'entre_rios', 'la_pampa', 'chaco'])[n_nationkey % 6 + 1]
           || '_' || lower(replace(n_name, ' ', '_')) AS region_id,
         n_name AS name, n_nationkey AS region_order, n_regionkey,
         CAST(-36.2 AS DOUBLE) + n_nationkey * CAST(0.4 AS DOUBLE) AS lat0,
         CASE WHEN n_regionkey <= 2 THEN 'high' WHEN n_regionkey = 3 THEN 'medium' ELSE 'low' END AS priority
  FROM nation
)"""


def region_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One alert per region: score = min(1, 5 x share of customers with a
    negative balance); level by the alert cut-offs; nations with key % 8 == 7
    failed (error row)."""
    c = table(spark, sf_dir, "customer")
    share = c.groupBy("c_nationkey").agg(
        (F.count_if(F.col("c_acctbal") < 0) / F.count("*")).alias("share"))
    r = region_dim(spark, sf_dir)
    j = r.join(share, r.region_order == share.c_nationkey, "left")
    err = (F.col("region_order") % 8) == 7
    score = F.when(err, 0.0).otherwise(F.least(F.lit(1.0), 5 * F.coalesce(F.col("share"), F.lit(0.0))))
    level = (F.when(err, "error").when(score >= 0.7, "critical").when(score >= 0.4, "warning").otherwise("normal"))
    return j.select("region_id", "name", "region_order", "crops", "priority", level.alias("alert_level"),
                    score.alias("alert_score"),
                    F.when(err, F.lit("soil service read time-out")).alias("error"),
                    F.date_sub(F.lit("1998-01-01").cast("date"), (F.col("region_order") * 2).cast("int"))
                     .alias("alert_date"))


REGION_ALERTS_SQL = REGION_SQL + """,
region_alerts AS (
  SELECT r.region_id, r.name, r.region_order, r.priority,
         CASE WHEN r.region_order % 8 = 7 THEN 'error'
              WHEN least(1.0, 5 * coalesce(s.share, 0.0)) >= 0.7 THEN 'critical'
              WHEN least(1.0, 5 * coalesce(s.share, 0.0)) >= 0.4 THEN 'warning' ELSE 'normal' END AS alert_level,
         CASE WHEN r.region_order % 8 = 7 THEN 0.0 ELSE least(1.0, 5 * coalesce(s.share, 0.0)) END AS alert_score,
         CASE WHEN r.region_order % 8 = 7 THEN 'soil service read time-out' END AS error,
         DATE '1998-01-01' - CAST(r.region_order * 2 AS INTEGER) AS alert_date
  FROM region_dim r LEFT JOIN (
    SELECT c_nationkey, count(*) FILTER (WHERE c_acctbal < 0) / count(*) AS share FROM customer GROUP BY c_nationkey
  ) s ON r.region_order = s.c_nationkey
)"""


# --------------------------------------------------------------- points ---
def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stress sample points: one per supplier, inside its nation's region."""
    s = table(spark, sf_dir, "supplier")
    tok = F.element_at(F.array(*[F.lit(t) for t in PROVINCE_TOKENS]), (F.col("s_nationkey") % 6 + 1).cast("int"))
    n = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    j = s.join(F.broadcast(n), s.s_nationkey == n.n_nationkey)
    stress = F.when(F.col("s_acctbal").isNotNull(),
                    F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("s_acctbal") / 10000)))
    return j.select(F.concat(tok, F.lit("_"), F.lower(F.regexp_replace("n_name", " ", "_"))).alias("region_id"),
                    F.col("s_suppkey").alias("point_id"),
                    (F.lit(-65.0) + (F.col("s_suppkey") % 40) * 0.1).alias("lon"),
                    (F.lit(-36.0) + F.col("s_nationkey") * 0.4).alias("lat"),
                    stress.alias("stress"))


POINTS_SQL = """
points AS (
  SELECT (['buenos_aires', 'cordoba', 'santa_fe', 'entre_rios', 'la_pampa', 'chaco'])[s_nationkey % 6 + 1]
           || '_' || lower(replace(n_name, ' ', '_')) AS region_id,
         s_suppkey AS point_id, CAST(-65.0 AS DOUBLE) + (s_suppkey % 40) * CAST(0.1 AS DOUBLE) AS lon,
         CAST(-36.0 AS DOUBLE) + s_nationkey * CAST(0.4 AS DOUBLE) AS lat,
         least(1.0, greatest(0.0, s_acctbal / 10000)) AS stress
  FROM supplier JOIN nation ON s_nationkey = n_nationkey
)"""
