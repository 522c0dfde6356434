"""Irrigation prescription maps.

A prescription is a cell table ``(region_id, row, col, lon, lat, stress,
rate, zone)``.  Cells are generated per region with ``sequence`` +
``explode`` (rows first, then a repartition on (region, row) before the
columns are exploded, so a large region's grid is spread over tasks).
Stress reaches the cells from sample points by an exact nearest-neighbour
search over square tiles (see ``nearest_stress``); rates and zones are
band lookups compiled to CASE expressions; summaries follow from the counts
of a region's few rates.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verdant.functions import semantics as S
from verdant.session import cut_lineage

# Fixed values of the reference: irrigation rate (mm/day) per crop and
# stress band, the stress bands, prescription zones (rate bands), default
# equipment, default stress when fewer than three samples exist.
IRRIGATION_RATES = {
    "soybean": (0.0, 3.0, 5.0, 8.0, 12.0),
    "corn": (0.0, 4.0, 7.0, 10.0, 15.0),
    "wheat": (0.0, 2.0, 4.0, 6.0, 10.0),
}
STRESS_BANDS = [("no_stress", 0.0, 0.1), ("mild_stress", 0.1, 0.3), ("moderate_stress", 0.3, 0.6),
                ("severe_stress", 0.6, 0.8), ("critical_stress", 0.8, 1.0)]
ZONES = [(1, "No Irrigation", 0.0, 1.0), (2, "Light Irrigation", 1.0, 4.0), (3, "Moderate Irrigation", 4.0, 8.0),
         (4, "Heavy Irrigation", 8.0, 12.0), (5, "Critical Irrigation", 12.0, 20.0)]
EQUIPMENT = {"boom_width_m": 24.0, "application_speed_kmh": 15.0, "nozzle_spacing_m": 0.5,
             "min_application_rate": 0.5, "max_application_rate": 20.0}
DEFAULT_STRESS = 0.5
MIN_POINTS = 3
M_PER_DEG = 111320.0

#: Nearest samples: cells of a tile, candidates of a tile that travel in one row, candidates that are
#: read as columns, and candidates (some 40 bytes each) that are broadcast.
CELLS_PER_TILE = 4_096
CHUNK = 256
FEW = 4
BROADCAST_ENTRIES = 500_000


# ------------------------------------------------------------------- G1 --

def bounds(ring) -> list[Column]:
    r = F.col(ring) if isinstance(ring, str) else ring
    xs = F.transform(r, lambda p: F.get(p, 0))
    ys = F.transform(r, lambda p: F.get(p, 1))
    return [F.array_min(xs), F.array_min(ys), F.array_max(xs), F.array_max(ys)]


def grid(regions: DataFrame, resolution_m: float = 100.0, units: str = "metric", key: str = "region_id",
         ring: str = "geometry") -> DataFrame:
    """G1 evenly spaced cell centres spanning each region's bounding box,
    ``floor(span / res) + 1`` per axis (numpy ``linspace`` placement).
    ``units="raw"`` divides degrees by metres as the reference does."""
    res = resolution_m if units == "raw" else resolution_m / M_PER_DEG
    minx, miny, maxx, maxy = bounds(ring)
    r = regions.select(key, minx.alias("minx"), miny.alias("miny"), maxx.alias("maxx"), maxy.alias("maxy"))
    r = r.withColumns({"width": F.floor((F.col("maxx") - F.col("minx")) / res).cast("int") + 1,
                       "height": F.floor((F.col("maxy") - F.col("miny")) / res).cast("int") + 1})
    rows = r.withColumn("row", F.explode(F.sequence(F.lit(0), F.col("height") - 1)))
    # a given number of partitions is not coalesced: grid rows are few bytes, but thousands of cells each
    rows = rows.repartition(int(regions.sparkSession.conf.get("spark.sql.shuffle.partitions")), key, "row")
    cells = rows.withColumn("col", F.explode(F.sequence(F.lit(0), F.col("width") - 1)))
    return cells.select(key, "row", "col", _linspace("minx", "maxx", "width", "col").alias("lon"),
                        _linspace("miny", "maxy", "height", "row").alias("lat"), "width", "height")


def _linspace(lo, hi, n, i) -> Column:
    step = (F.col(hi) - F.col(lo)) / (F.col(n) - 1)
    return (F.when(F.col(n) == 1, F.col(lo)).when(F.col(i) == F.col(n) - 1, F.col(hi))
             .otherwise(F.col(i) * step + F.col(lo)))


# ------------------------------------------------------------ G2 / J8 --

def _small(df: DataFrame, size: int) -> DataFrame:
    """Marked for broadcast if its measured size is at most ``BROADCAST_ENTRIES``, else joined by a shuffle."""
    return F.broadcast(df) if size <= BROADCAST_ENTRIES else df


def nearest_stress(cells: DataFrame, points: DataFrame, key: str = "region_id", stress: str = "stress",
                   per_tile: int = 4) -> DataFrame:
    """G2 stress of each cell = stress of the nearest sample point of its
    region (ties: lower point id); regions with fewer than ``MIN_POINTS`` valid
    samples get ``DEFAULT_STRESS``; results clipped to [0, 1].  Cells keep all
    their columns.  Points without a place or a stress are not samples.

    Exact search without all pairs.  Points at one place count once.  A region
    is cut into square tiles of about ``per_tile`` points or ``CELLS_PER_TILE``
    cells, whichever are the smaller tiles; tiles of level l are 2**l times as wide.  For each
    tile the least level is taken at which a point lies in the 3 x 3 block around it; the
    largest distance from the tile to the best of these points bounds the distance of all its
    cells.  At the level whose side exceeds the bound the block holds every point within it;
    those that some place of the tile is near enough to are the tile's candidates.  Only
    tiles and points take part in this; then each cell reads its tile's candidates, once.

    The candidates are written to the checkpoint folder and measured: up to
    ``BROADCAST_ENTRIES`` of them are broadcast, so that cells are not shuffled at all.  A
    tile with more than ``CHUNK`` candidates holds them in several rows, which its cells read
    one by one.  Without cells there is nothing to return; repeated points count as samples."""
    pts = points.where(F.col(stress).isNotNull() & F.col("lon").isNotNull() & F.col("lat").isNotNull())
    pts = pts.select(key, "point_id", F.col("lon").alias("plon"), F.col("lat").alias("plat"), F.col(stress).alias("pstress"))
    places = pts.groupBy(key, "plon", "plat").agg(F.min(F.struct("point_id", "pstress")).alias("p"), F.count("*").alias("held"))
    cb = cells.groupBy(key).agg(F.count("*").alias("cells"), F.min("lon").alias("cx0"), F.max("lon").alias("cx1"),
                                F.min("lat").alias("cy0"), F.max("lat").alias("cy1"))
    pb = places.groupBy(key).agg(F.sum("held").alias("samples"), F.count("*").alias("places"), F.min("plon").alias("px0"),
                                 F.max("plon").alias("px1"), F.min("plat").alias("py0"), F.max("plat").alias("py1"))
    width, height = F.col("cx1") - F.col("cx0"), F.col("cy1") - F.col("cy0")
    geo = cb.join(pb, key, "left").withColumns({
        "tiles": F.greatest(F.lit(1.0), F.col("places") / float(per_tile), F.col("cells") / float(CELLS_PER_TILE)),
        "ox": F.least("cx0", "px0"), "oy": F.least("cy0", "py0"),
        "extent": F.greatest(F.greatest("cx1", "px1") - F.least("cx0", "px0"), F.greatest("cy1", "py1") - F.least("cy0", "py0"), F.lit(1e-9))})
    geo = geo.withColumn("t0", F.greatest(F.sqrt(width * height / F.col("tiles")), width / F.col("tiles"), height / F.col("tiles"),
                                          F.col("extent") / F.lit(2.0 ** 40)))
    geo = cut_lineage(geo.select(key, (F.coalesce("samples", F.lit(0)) >= MIN_POINTS).alias("enough"), "ox", "oy", "t0", "cx0", "cx1", "cy0", "cy1",
                                 F.greatest(F.lit(0), F.ceil(F.log2(F.col("extent") / F.col("t0"))) + 1).cast("int").alias("top")))

    def tile(x, origin):
        return F.floor((F.col(x) - F.col(origin)) / F.col("t0")).cast("long")

    def up(index, level):
        return F.floor(F.col(index) / F.pow(F.lit(2.0), level)).cast("long")

    levels = F.explode(F.sequence(F.lit(0), F.col("top"))).alias("level")
    near = F.explode(F.array(*[F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx in (-1, 0, 1) for dy in (-1, 0, 1)])).alias("o")
    p = places.join(geo.where("enough"), key).withColumns({"ix": tile("plon", "ox"), "iy": tile("plat", "oy")})
    p = p.select(key, "p", "plon", "plat", "ix", "iy", levels).select("*", near)
    block = p.select(key, "level", (up("ix", F.col("level")) + F.col("o.dx")).alias("kx"), (up("iy", F.col("level")) + F.col("o.dy")).alias("ky"),
                     F.col("p.point_id").alias("id"), F.col("p.pstress").alias("s"), "plon", "plat")

    at = geo.where("enough").withColumn("ix", F.explode(F.sequence(tile("cx0", "ox"), tile("cx1", "ox")))).repartition(key, "ix")
    at = at.withColumn("iy", F.explode(F.sequence(tile("cy0", "oy"), tile("cy1", "oy")))).select(key, "ix", "iy", "ox", "oy", "t0", "top")
    spread = at.select(key, "ix", "iy", levels).withColumns({"kx": up("ix", F.col("level")), "ky": up("iy", F.col("level"))})
    least = spread.join(block.select(key, "level", "kx", "ky").distinct(), [key, "level", "kx", "ky"], "left_semi")
    least = least.groupBy(key, "ix", "iy").agg(F.min("level").alias("level"))
    at = at.join(least, [key, "ix", "iy"])

    def sides(axis, origin, place):
        """Least and largest distance along one axis from a tile (a little widened, for rounding) to a point."""
        low, high = F.col(origin) + (F.col(axis) - 1e-6) * F.col("t0"), F.col(origin) + (F.col(axis) + 1 + 1e-6) * F.col("t0")
        return (F.greatest(F.lit(0.0), low - F.col(place), F.col(place) - high), F.greatest(F.abs(low - F.col(place)), F.abs(high - F.col(place))))

    def around(tiles):
        tiles = tiles.withColumns({"kx": up("ix", F.col("level")), "ky": up("iy", F.col("level"))})
        return tiles.join(block, [key, "level", "kx", "ky"])

    (x_min, x_max), (y_min, y_max) = sides("ix", "ox", "plon"), sides("iy", "oy", "plat")
    tile_columns = [key, "ix", "iy", "ox", "oy", "t0", "top"]
    bound = around(at).groupBy(*tile_columns, "level").agg(F.min(x_max * x_max + y_max * y_max).alias("d2"))
    level = F.least(F.col("top"), F.greatest(F.col("level"), F.ceil(F.log2(F.sqrt("d2") / F.col("t0"))).cast("int")))
    found = around(bound.withColumn("level", level)).where(x_min * x_min + y_min * y_min <= F.col("d2") * (1 + 1e-9))
    found = found.withColumn("n", F.count("*").over(S.Window.partitionBy(key, "ix", "iy")))
    found = found.withColumn("chunk", F.pmod(F.xxhash64("id"), F.ceil(F.col("n") / float(CHUNK)).cast("long")))
    candidates = cut_lineage(found.groupBy(key, "ix", "iy", "chunk").agg(
        F.collect_list(F.struct("plon", "plat", "id", "s")).alias("__near"), (F.max("n") > CHUNK).alias("__parts")))
    size = F.size("__near")
    held = candidates.agg(*(F.coalesce(F.sum(F.when(w, size)), F.lit(0)).alias(n) for n, w in (("few", size <= FEW), ("many", size > FEW))),
                          F.coalesce(F.max("__parts"), F.lit(False)).alias("parts")).first()
    regions = geo.agg(F.count("*").alias("all"), F.count_if(~F.col("enough")).alias("without")).first()

    own = cells.columns
    c = cells.join(_small(geo.select(key, *(F.col(x).alias(f"__{x}") for x in ("enough", "ox", "oy", "t0"))), regions["all"]), key)
    index = {f"__i{a}": F.floor((F.col(x) - F.col(f"__o{a}")) / F.col("__t0")).cast("long") for a, x in (("x", "lon"), ("y", "lat"))}
    tiled = c.where("__enough").withColumns(index).select(*own, *index)
    candidates = candidates.select(key, F.col("ix").alias("__ix"), F.col("iy").alias("__iy"), "__near", "__parts")

    def at_distance(q):
        dx, dy = F.col("lon") - q["plon"], F.col("lat") - q["plat"]
        return F.struct((dx * dx + dy * dy).alias("d2"), q["id"].alias("id"), q["s"].alias("s"))

    def read(best):
        return S.clip(best["s"], 0.0, 1.0).alias("stress")

    parts = []
    if regions["without"]:
        parts.append(c.where(~F.col("__enough")).select(*own, F.lit(DEFAULT_STRESS).alias("stress")))
    if held["few"]:  # flat columns, which stay in generated code
        flat = candidates.where((size <= FEW) & ~F.col("__parts")).select(
            key, "__ix", "__iy", size.alias("__n"), *(F.get("__near", i).alias(f"__q{i}") for i in range(FEW)))
        each = [F.when(F.col("__n") > i, at_distance(F.col(f"__q{i}"))) for i in range(FEW)]
        parts.append(tiled.join(_small(flat, held["few"]), [key, "__ix", "__iy"]).select(*own, read(F.least(*each))))
    if held["many"]:
        j = tiled.join(_small(candidates.where((size > FEW) & ~F.col("__parts")), held["many"]), [key, "__ix", "__iy"])
        parts.append(j.select(*own, read(F.array_min(F.transform("__near", at_distance)))))
    if held["parts"]:
        j = tiled.join(_small(candidates.where("__parts"), held["few"] + held["many"]), [key, "__ix", "__iy"])
        j = j.select(*own, F.array_min(F.transform("__near", at_distance)).alias("__best"))
        parts.append(j.groupBy(*own).agg(F.min("__best").alias("__best")).select(*own, read(F.col("__best"))))
    if not parts:
        return cells.withColumn("stress", F.lit(DEFAULT_STRESS))
    return reduce(DataFrame.unionByName, parts)


# ------------------------------------------------------------ G3 / G4 --

def _rate_of(crop: Column, band: int) -> Column:
    m = F.create_map(*[x for c, v in IRRIGATION_RATES.items() for x in (F.lit(c), F.lit(v[band]))])
    return F.coalesce(F.element_at(m, F.lower(crop)), F.lit(IRRIGATION_RATES["soybean"][band]))


def irrigation_rate(stress, crop, efficiency: float = 0.8) -> Column:
    """G3 stress band -> crop rate / efficiency; >= .8 critical; outside the
    bands (negative, NULL) 0."""
    s = S.col(stress)
    crop_c = F.lit(crop) if isinstance(crop, str) else crop
    expr = F.when(s >= 0.8, _rate_of(crop_c, 4) / efficiency)
    for i, (_, lo, hi) in enumerate(STRESS_BANDS[:-1]):
        expr = expr.when((s >= lo) & (s < hi), _rate_of(crop_c, i) / efficiency)
    return expr.otherwise(F.lit(0.0))


def zone_of(rate) -> Column:
    """G4 rate band -> zone 1..5, 0 outside (>= 20 or negative)."""
    r = S.col(rate)
    expr = None
    for zid, _, lo, hi in ZONES:
        cond = (r >= lo) & (r < hi)
        expr = F.when(cond, zid) if expr is None else expr.when(cond, zid)
    return expr.otherwise(0)


def zone_name(zone) -> Column:
    m = F.create_map(*[x for zid, name, _, _ in ZONES for x in (F.lit(zid), F.lit(name))])
    return F.element_at(m, S.col(zone))


def rate_counts(cells: DataFrame, key: str = "region_id") -> DataFrame:
    """Cells by region, rate and zone: rates come from bands, so this is a few
    rows per region, from which all summaries follow."""
    return cells.groupBy(key, "rate", "zone").agg(F.count("*").alias("n"))


def zone_stats(cells: DataFrame, key: str = "region_id") -> DataFrame:
    """A9 per region and zone 1..5: pixel count, area %, mean rate (0 for
    empty zones).  Every region gets all five rows."""
    per = [F.coalesce(F.sum(F.when(F.col("zone") == z, F.col("n"))), F.lit(0)) for z, _, _, _ in ZONES]
    mean = [F.coalesce(F.try_divide(F.sum(F.when(F.col("zone") == z, F.col("n") * F.col("rate"))), p), F.lit(0.0))
            for (z, _, _, _), p in zip(ZONES, per)]
    g = rate_counts(cells, key).groupBy(key).agg(F.sum("n").alias("__n"), F.array(*[
        F.struct(F.lit(z).alias("zone"), p.alias("c"), m.alias("m")) for (z, _, _, _), p, m in zip(ZONES, per, mean)]).alias("__z"))
    return g.select(key, "__n", F.explode("__z").alias("z")).select(
        key, F.col("z.zone").alias("zone"), zone_name(F.col("z.zone")).alias("name"), F.col("z.c").alias("pixel_count"),
        (F.col("z.c") / F.col("__n") * 100).alias("area_percentage"), F.col("z.m").alias("avg_irrigation_rate"))


# ------------------------------------------------------------ A10 / A11 --

def prescription_summary(cells: DataFrame, key: str = "region_id") -> DataFrame:
    """A10 + A11 per region: total / mean / max rate, % of cells irrigated,
    non-empty zone count, water savings versus a uniform rate, Christiansen
    uniformity, all from the few rates of a region."""
    r = rate_counts(cells, key)
    g = r.groupBy(key).agg(F.sum(F.col("rate") * F.col("n")).alias("total_irrigation_volume_per_day"),
                           F.max("rate").alias("maximum_irrigation_rate"),
                           (F.sum(F.when(F.col("rate") > 0, F.col("n")).otherwise(0)) / F.sum("n") * 100)
                           .alias("percentage_area_requiring_irrigation"),
                           F.count_distinct(F.when(F.col("zone") > 0, F.col("zone"))).alias("zones_present"),
                           F.sum("n").alias("n_cells"),
                           F.collect_list(F.struct("rate", "n")).alias("__r"))
    mean, n, total = F.col("average_irrigation_rate"), F.col("n_cells"), F.col("total_irrigation_volume_per_day")
    g = g.withColumn("average_irrigation_rate", total / n)
    g = g.withColumn("__dev", F.aggregate("__r", F.lit(0.0), lambda acc, x: acc + x["n"] * F.abs(x["rate"] - mean)))
    savings = F.greatest(F.lit(0.0), F.coalesce(F.try_divide(mean * n - total, mean * n) * 100, F.lit(0.0)))
    uc = F.when(mean == 0, 1.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - F.col("__dev") / (n * mean))))
    return g.withColumns({"variable_rate_water_savings_percent": savings,
                          "irrigation_uniformity_coefficient": uc}).drop("__dev", "__r")


# ------------------------------------------------------------ G5 / X35 --

def field_area_ha(ring, units: str = "metric") -> Column:
    """Bounding-box area in hectares; ``raw`` keeps the reference's
    degrees-squared / 10000."""
    minx, miny, maxx, maxy = bounds(ring)
    if units == "raw":
        return (maxx - minx) * (maxy - miny) / 10000
    midlat = F.radians((miny + maxy) / 2)
    return (maxx - minx) * M_PER_DEG * F.cos(midlat) * (maxy - miny) * 110574.0 / 10000


def _applied(cells: DataFrame, key: str, params: dict) -> DataFrame:
    """Cell counts by region, rate and the rate the equipment can apply."""
    return rate_counts(cells, key).withColumn("applied", F.least(F.greatest(F.col("rate"), F.lit(params["min_application_rate"])),
                                                                 F.lit(params["max_application_rate"])))


def application_map(cells: DataFrame, areas: DataFrame, key: str = "region_id", params: dict | None = None) -> DataFrame:
    """G5 per region: rates clipped to the equipment range, volume (litres),
    application time (hours at boom x speed / 10 ha per hour), share of
    cells whose rate is achievable, coverage; all from the few rates of a region."""
    p = {**EQUIPMENT, **(params or {})}

    def share(of):
        return F.sum(F.when(of, F.col("n")).otherwise(0)) / F.sum("n") * 100

    g = _applied(cells, key, p).groupBy(key).agg(
        (F.sum(F.col("applied") * F.col("n")) / F.sum("n")).alias("__mean"),
        share(F.col("rate") <= p["max_application_rate"]).alias("rate_achievability"),
        share(F.col("applied") > 0).alias("coverage_efficiency"),
        F.count_distinct(F.when(F.col("applied") > 0, F.col("applied"))).alias("equipment_zones"))
    capacity = p["boom_width_m"] * p["application_speed_kmh"] / 10.0
    return g.join(areas, key).select(
        key, (F.col("__mean") * F.col("field_area_ha") * 10000).alias("total_volume_needed_liters"),
        (F.col("field_area_ha") / capacity).alias("estimated_application_time_hours"),
        "rate_achievability", "coverage_efficiency", "equipment_zones")


def equipment_setting(rate, params: dict | None = None) -> Column:
    """X35 pressure (bar), flow (l/min) and nozzle for a rate."""
    p = {**EQUIPMENT, **(params or {})}
    r = S.col(rate)
    return F.struct(F.least(F.lit(3.0), F.greatest(F.lit(1.0), r / 5.0)).alias("pressure_bar"),
                    (r * p["boom_width_m"] * p["application_speed_kmh"] / 60).alias("flow_rate_lpm"),
                    F.when(r < 10, "standard").otherwise("high_flow").alias("nozzle_selection"))


def equipment_zones(cells: DataFrame, key: str = "region_id", params: dict | None = None) -> DataFrame:
    """G5 one zone per distinct applied rate (> 0), numbered by rate order,
    with its cell count and X35 settings."""
    p = {**EQUIPMENT, **(params or {})}
    z = _applied(cells, key, p).where(F.col("applied") > 0).groupBy(key, "applied").agg(F.sum("n").alias("area_pixels"))
    w = S.Window.partitionBy(key).orderBy("applied")
    return z.select(key, F.concat(F.lit("zone_"), F.dense_rank().over(w).cast("string")).alias("zone"),
                    F.col("applied").alias("application_rate"), "area_pixels",
                    equipment_setting("applied", p).alias("setting"))


def grid_rows(cells: DataFrame, key: str = "region_id") -> DataFrame:
    """Cell table by region and grid row, for passes along a row: cells, west
    and east end, latitude, mean stress, mean and greatest rate, cells in each
    zone.  Rows of a region lie in different tasks."""
    return cells.groupBy(key, "row").agg(
        F.count("*").alias("n_cells"), F.min("lon").alias("west"), F.max("lon").alias("east"), F.max("lat").alias("lat"),
        F.avg("stress").alias("mean_stress"), F.avg("rate").alias("mean_rate"), F.max("rate").alias("max_rate"),
        *(F.count_if(F.col("zone") == z).alias(f"zone_{z}") for z, *_ in ZONES))


# ------------------------------------------------------------ A18 / A19 --

def water_requirement(summary: DataFrame, areas: DataFrame, key: str = "region_id") -> DataFrame:
    """A19 per region daily requirement (m3) = mean rate x area (ha) x 10."""
    j = summary.select(key, "average_irrigation_rate").join(areas, key)
    return j.select(key, (F.col("average_irrigation_rate") * F.col("field_area_ha") * 10).alias("daily_water_requirement_m3"),
                    F.col("field_area_ha").alias("area_ha"),
                    F.col("average_irrigation_rate").alias("avg_irrigation_rate_mm_day"))


def zone_area_totals(zstats: DataFrame, areas: DataFrame, key: str = "region_id") -> DataFrame:
    """A19 area (ha) per zone name summed over regions."""
    j = zstats.join(areas, key)
    return j.groupBy("zone", "name").agg(F.sum(F.col("area_percentage") / 100 * F.col("field_area_ha"))
                                         .alias("total_area_ha"))


def prescription(regions: DataFrame, samples: DataFrame, crop: Column | str = "soybean",
                 resolution_m: float = 100.0, efficiency: float = 0.8, units: str = "metric",
                 key: str = "region_id") -> DataFrame:
    """G6 end to end: grid -> stress -> rate -> zone (cell table)."""
    cells = grid(regions, resolution_m, units, key)
    cells = nearest_stress(cells, samples, key)
    crop_c = crop if isinstance(crop, Column) else F.lit(crop)
    if isinstance(crop, Column):
        cells = cells.join(regions.select(key, crop.alias("__crop")), key)
        crop_c = F.col("__crop")
    cells = cells.withColumn("rate", irrigation_rate("stress", crop_c, efficiency))
    return cells.withColumn("zone", zone_of("rate")).drop("__crop")
