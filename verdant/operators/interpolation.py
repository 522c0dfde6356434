"""Inverse-distance stress surface over exactly the k nearest samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verdant.functions import semantics as S
from verdant.operators.prescription import DEFAULT_STRESS, MIN_POINTS

# Fixed value of the reference: which column holds the stress, first found first.
STRESS_COLUMNS = ["water_stress_level", "stress_level", "combined_stress_index", "alert_score", "CWSI", "stress_index"]
_NUMBERS = ("tinyint", "smallint", "int", "bigint", "float", "double", "decimal")


def stress_column(df: DataFrame) -> str:
    """The column that holds the stress: by the list above, else the first with
    "stress" in its name, else the last numeric one (chosen at plan time)."""
    named = [c for c in STRESS_COLUMNS if c in df.columns] or [c for c in df.columns if "stress" in c.lower()]
    if named:
        return named[0]
    numeric = [c for c, t in df.dtypes if t.startswith(_NUMBERS)]
    if not numeric:
        raise ValueError("no column can hold the stress")
    return numeric[-1]


def _nearest_of(key: str, own: list[str], k: int, rows: DataFrame) -> DataFrame:
    """Of candidate rows, the ``k`` nearest of each cell; combined before the shuffle."""
    w = S.Window.partitionBy(key, "row", "col").orderBy(F.col("d2").asc_nulls_last(), "__id")
    best = rows.withColumn("__rank", F.row_number().over(w)).where(F.col("__rank") <= k)
    return best.groupBy(*own).agg(F.collect_list(F.when(F.col("d2").isNotNull(), F.struct("d2", "__id", "__s"))).alias("best"))


def inverse_distance(cells: DataFrame, points: DataFrame, k: int = 4, power: float = 2.0, key: str = "region_id",
                     stress: str | None = None, per_tile: int = 4) -> DataFrame:
    """G2 stress of each cell: the mean of its region's ``k`` nearest samples
    weighted by ``distance ** -power`` (equal distances: lower point id first),
    clipped to [0, 1].  A cell on samples takes their plain mean.  Samples without
    a value don't count; regions with fewer than ``MIN_POINTS`` get
    ``DEFAULT_STRESS``, and k is at most what a region has.  The stress column is
    ``stress`` or the one ``stress_column`` finds.  Cells keep region, row, col.

    Exact, without all pairs: square tiles hold about ``per_tile`` points, tiles of
    level l are 2**l times as wide.  A tile of cells looks at the least level at
    which the 3 x 3 block around it holds k points.  If the k-th of them is nearer
    than that level's side, no point outside the block can replace it; the other
    cells look once more, at the level whose side exceeds that distance.  Of the
    points at one place only the k lowest ids are ever among the nearest."""
    value = F.col(stress or stress_column(points)).cast("double")
    pts = points.select(key, "point_id", F.col("lon").alias("plon"), F.col("lat").alias("plat"), F.nanvl(value, F.lit(None).cast("double")).alias("__s")).where("__s is not null")
    place = S.Window.partitionBy(key, "plon", "plat").orderBy("point_id")
    pts = pts.withColumn("__n", F.row_number().over(place)).where(F.col("__n") <= max(k, MIN_POINTS)).drop("__n")
    cb = cells.groupBy(key).agg(F.min("lon").alias("cx0"), F.max("lon").alias("cx1"), F.min("lat").alias("cy0"), F.max("lat").alias("cy1"))
    pb = pts.groupBy(key).agg(F.count("*").alias("n"), F.min("plon").alias("px0"), F.max("plon").alias("px1"), F.min("plat").alias("py0"), F.max("plat").alias("py1"))
    wide = F.greatest(F.greatest("cx1", "px1") - F.least("cx0", "px0"), F.greatest("cy1", "py1") - F.least("cy0", "py0"), F.lit(1e-9))
    tiles = F.greatest(F.lit(1.0), F.ceil(F.sqrt(F.col("n") / float(per_tile))))
    geo = cb.join(pb, key).where(F.col("n") >= MIN_POINTS).select(
        key, F.least("cx0", "px0").alias("ox"), F.least("cy0", "py0").alias("oy"), (wide / tiles).alias("t0"),
        (F.ceil(F.log2(tiles)) + 1).cast("int").alias("top"), F.least(F.col("n"), F.lit(k)).alias("k"))

    def tile(x: str, origin: str) -> Column:
        return F.floor((F.col(x) - F.col(origin)) / F.col("t0")).cast("long")

    def up(index: str, level) -> Column:
        return F.floor(F.col(index) / F.pow(F.lit(2.0), level)).cast("long")

    levels = F.explode(F.sequence(F.lit(0), F.col("top"))).alias("level")
    around = F.explode(F.array(*[F.struct(F.lit(x).alias("dx"), F.lit(y).alias("dy")) for x in (-1, 0, 1) for y in (-1, 0, 1)])).alias("o")
    p = pts.join(geo, key).withColumns({"ix": tile("plon", "ox"), "iy": tile("plat", "oy")}).select(key, "point_id", "__s", "plon", "plat", "ix", "iy", levels).select("*", around)
    block = p.select(key, "level", (up("ix", F.col("level")) + F.col("o.dx")).alias("kx"), (up("iy", F.col("level")) + F.col("o.dy")).alias("ky"), F.col("point_id").alias("__id"), "__s", "plon", "plat")
    own = [key, "row", "col", "lon", "lat", "ix", "iy", "t0", "top", "k", "level"]
    c = cells.select(key, "row", "col", "lon", "lat").join(geo, key).withColumns({"ix": tile("lon", "ox"), "iy": tile("lat", "oy")})
    at = c.select(key, "ix", "iy", "top", "k").distinct().select(key, "ix", "iy", "top", "k", levels)
    at = at.withColumns({"kx": up("ix", F.col("level")), "ky": up("iy", F.col("level"))})
    held = block.groupBy(key, "level", "kx", "ky").agg(F.count("*").alias("held"))
    at = at.join(held, [key, "level", "kx", "ky"]).where((F.col("held") >= F.col("k")) | (F.col("level") == F.col("top")))
    c = c.join(at.groupBy(key, "ix", "iy").agg(F.min("level").alias("level")), [key, "ix", "iy"])

    def look(rows: DataFrame) -> DataFrame:
        rows = rows.select(*own).withColumns({"kx": up("ix", F.col("level")), "ky": up("iy", F.col("level"))})
        dx, dy = F.col("lon") - F.col("plon"), F.col("lat") - F.col("plat")
        return _nearest_of(key, own, k, rows.join(block, [key, "level", "kx", "ky"], "left").withColumn("d2", dx * dx + dy * dy))

    first = look(c)
    far = F.sqrt(F.array_max("best.d2")) / (F.col("t0") * F.pow(F.lit(2.0), F.col("level")))
    again = (F.col("level") < F.col("top")) & (far >= 1)
    second = look(first.where(again).withColumn("level", F.least(F.col("top"), F.col("level") + F.floor(F.log2(far)).cast("int") + 1)))
    told = first.where(~F.coalesce(again, F.lit(False))).unionByName(second).select(key, "row", "col", "best")
    return cells.select(key, "row", "col").join(told, [key, "row", "col"], "left").select(key, "row", "col", weighted_mean("best", power).alias("stress"))


def weighted_mean(best: str, power: float) -> Column:
    """The samples' mean by distance, clipped; ``DEFAULT_STRESS`` without samples."""
    b = F.array_sort(F.col(best))
    total = lambda x: F.aggregate(x, F.lit(0.0), lambda a, v: a + v)
    on = F.filter(b, lambda v: v["d2"] == 0)
    plain = total(F.transform(on, lambda v: v["__s"])) / F.size(on)
    weight = lambda v: F.pow(v["d2"], F.lit(-power / 2))
    mean = total(F.transform(b, lambda v: weight(v) * v["__s"])) / total(F.transform(b, weight))
    return F.when(F.size(F.col(best)) > 0, S.clip(F.when(F.size(on) > 0, plain).otherwise(mean), 0.0, 1.0)).otherwise(F.lit(DEFAULT_STRESS))
