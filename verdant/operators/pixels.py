"""Scene / pixel operators over a pixel table.

The pixel table is ``(region_id, scene_ts, date, x, y, lon, lat, <bands>,
qa, cloud_pct)``; on a cluster it is parquet partitioned by date so I1's
date predicate prunes partitions and the band/cloud predicates push into
the scan.  Region reductions are two-phase hash aggregates (partial
aggregation before the shuffle), so a region holding a third of all
pixels still only ships one partial row per task and group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fixed values of the reference: reflectance / thermal scale factors, QA bits,
# cloud thresholds, area breakpoints for the sampling scale.
S2_SCALE = 0.0001
SR_SCALE, SR_OFFSET = 0.0000275, -0.2
ST_SCALE, ST_OFFSET = 0.00341802, 149.0
S2_CLOUD_BITS = (10, 11)
LANDSAT_CLOUD_BITS = (3, 4)
S2_MAX_CLOUD = 20.0
LANDSAT_MAX_CLOUD = 30.0
SCALE_BY_AREA = ((100000, 1000), (10000, 500))   # km2 above -> metres; else 100
DEFAULT_SCALE_M = 100


def scene_filter(df: DataFrame, bbox, start: str, end: str, max_cloud: float = S2_MAX_CLOUD,
                 *, lon="lon", lat="lat", ts="date", cloud="cloud_pct") -> DataFrame:
    """I1 inside the bounding box, date in [start, end), cloud below threshold."""
    x0, y0, x1, y1 = bbox
    return df.where(F.col(lon).between(x0, x1) & F.col(lat).between(y0, y1)
                    & (F.col(ts) >= F.lit(start).cast("date")) & (F.col(ts) < F.lit(end).cast("date"))
                    & (F.col(cloud) < max_cloud))


def bits_clear(qa: Column, bits) -> Column:
    cond = None
    for b in bits:
        c = F.col(qa) if isinstance(qa, str) else qa
        one = c.bitwiseAND(1 << b) == 0
        cond = one if cond is None else cond & one
    return cond


def qa_mask_optical(df: DataFrame, bands, qa="qa", scale: float = S2_SCALE) -> DataFrame:
    """I2 drop pixels whose QA has the cloud (10) or cirrus (11) bit; scale bands."""
    return df.where(bits_clear(qa, S2_CLOUD_BITS)).withColumns(
        {b: F.col(b) * scale for b in bands})


def qa_mask_thermal(df: DataFrame, sr_bands, st_bands, qa="qa") -> DataFrame:
    """I3 drop cloud (3) / shadow (4) pixels; surface reflectance and surface
    temperature (Kelvin) scaling."""
    return df.where(bits_clear(qa, LANDSAT_CLOUD_BITS)).withColumns(
        {**{b: F.col(b) * SR_SCALE + SR_OFFSET for b in sr_bands},
         **{b: F.col(b) * ST_SCALE + ST_OFFSET for b in st_bands}})


def scene_union(a: DataFrame, b: DataFrame) -> DataFrame:
    """I4 merge two collections by column name, missing bands NULL."""
    return a.unionByName(b, allowMissingColumns=True)


def median_composite(df: DataFrame, bands, keys=("region_id", "x", "y")) -> DataFrame:
    """I5 per-pixel, per-band exact median over the time span (null for a band
    without values).

    Values are counted first, combined before the shuffle; a running sum of the
    counts in order of value then meets the one or two middle places.  So no group
    ever holds its values in a buffer, however many scenes a pixel has."""
    bands, keys = list(bands), list(keys)
    each = F.posexplode(F.array(*[F.col(b).cast("double") for b in bands])).alias("__band", "__v")
    counts = df.select(*keys, each).groupBy(*keys, "__band", "__v").agg(F.count("*").alias("__n"))
    counts = counts.withColumn("__n", F.when(F.col("__v").isNull(), 0).otherwise(F.col("__n")))
    w = Window.partitionBy(*keys, "__band")
    up_to = F.sum("__n").over(w.orderBy("__v").rowsBetween(Window.unboundedPreceding, 0))
    counts = counts.withColumns({"__up": up_to, "__all": F.sum("__n").over(w)})
    low, high = F.floor((F.col("__all") + 1) / 2), F.floor(F.col("__all") / 2) + 1
    holds = lambda place: (F.col("__up") >= place) & (F.col("__up") - F.col("__n") < place)
    middle = lambda i: (F.max(F.when((F.col("__band") == i) & holds(low), F.col("__v"))) + F.max(F.when((F.col("__band") == i) & holds(high), F.col("__v")))) / 2
    return counts.groupBy(*keys).agg(*[middle(i).alias(b) for i, b in enumerate(bands)])


def region_mean(df: DataFrame, bands, keys=("region_id", "date")) -> DataFrame:
    """I6 mean of every band per region and scene day -> one daily row."""
    return df.groupBy(*keys).agg(*[F.avg(b).alias(b) for b in bands], F.count("*").alias("n_pixels"))


def scale_for_area(area_km2: Column) -> Column:
    """I7 sampling scale (metres) by region area."""
    expr = None
    for limit, metres in SCALE_BY_AREA:
        expr = F.when(area_km2 > limit, metres) if expr is None else expr.when(area_km2 > limit, metres)
    return expr.otherwise(DEFAULT_SCALE_M)


def adaptive_region_mean(df: DataFrame, bands, area_km2: Column, pixel_m: float = 10.0,
                         keys=("region_id", "date")) -> DataFrame:
    """I7 coarsen pixels to the area-dependent scale, then I6 per coarse cell
    (equal weight per coarse cell, as a coarser reduction grid does)."""
    scale = scale_for_area(area_km2)
    d = df.withColumn("scale_m", scale).withColumns({
        "cell_x": F.floor(F.col("x") * pixel_m / F.col("scale_m")),
        "cell_y": F.floor(F.col("y") * pixel_m / F.col("scale_m"))})
    cells = d.groupBy(*keys, "scale_m", "cell_x", "cell_y").agg(*[F.avg(b).alias(b) for b in bands])
    return cells.groupBy(*keys, "scale_m").agg(*[F.avg(b).alias(b) for b in bands],
                                               F.count("*").alias("n_cells"))


def season_slices(df: DataFrame, start_month: int, end_month: int, as_of: str, years_back: int = 3,
                  *, ts="date") -> DataFrame:
    """I8 rows inside the crop season of each of the last ``years_back``
    seasons before ``as_of``: [Y-start-01, Y(+1)-end-28), the end year
    advancing only when the season wraps over New Year.  A row belongs to at
    most one season, found by expression (no join)."""
    d = F.col(ts)
    wraps = start_month > end_month
    sy = F.when(F.month(d) >= start_month, F.year(d)).otherwise(F.year(d) - 1) if wraps else F.year(d)
    s = F.make_date(sy, F.lit(start_month), F.lit(1))
    e = F.make_date(sy + (1 if wraps else 0), F.lit(end_month), F.lit(28))
    last = F.year(F.lit(as_of).cast("date"))
    return (df.withColumn("season_year", sy)
              .where((d >= s) & (d < e) & (F.col("season_year") > last - years_back)
                     & (F.col("season_year") <= last))
              .withColumn("season_key", F.concat(F.lit("season_"), F.col("season_year").cast("string"))))


def point_in_ring(lon: Column, lat: Column, ring: Column) -> Column:
    """Even-odd rule over the ring's edges, evaluated with ``aggregate`` on
    the vertex array (no UDF)."""
    n = F.size(ring)
    idx = F.sequence(F.lit(0), n - 2)

    def step(acc, i):
        a, b = F.get(ring, i), F.get(ring, i + 1)
        ax, ay, bx, by = F.get(a, 0), F.get(a, 1), F.get(b, 0), F.get(b, 1)
        crosses = ((ay > lat) != (by > lat)) & (lon < (bx - ax) * (lat - ay) / (by - ay) + ax)
        return F.when(crosses, ~acc).otherwise(acc)
    return F.aggregate(idx, F.lit(False), step)


def clip_to_area(df: DataFrame, ring: Column, *, lon="lon", lat="lat") -> DataFrame:
    """I9 bounding-box prefilter (pushes into the scan) then exact ring test."""
    xs = F.transform(ring, lambda p: F.get(p, 0))
    ys = F.transform(ring, lambda p: F.get(p, 1))
    box = (F.col(lon).between(F.array_min(xs), F.array_max(xs))
           & F.col(lat).between(F.array_min(ys), F.array_max(ys)))
    return df.where(box & point_in_ring(F.col(lon), F.col(lat), ring))
