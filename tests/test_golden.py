"""Recorded prescription output of the reference (one 0.4 x 0.4 degree
soybean region, resolution 100, efficiency 0.8, one sample point): with the
reference's degree/metre grid arithmetic it is a single cell at stress 0.5
-> 6.25 mm/day, zone 3 on 100 %, uniformity 1, savings 0, area 1.6e-05."""
from pyspark.sql import functions as F

from verdant.operators import prescription as PM


def test_single_cell_prescription(spark):
    ring = [[-61.0, -34.0], [-60.6, -34.0], [-60.6, -33.6], [-61.0, -33.6], [-61.0, -34.0]]
    regions = spark.createDataFrame([("r1", ring)], "region_id string, geometry array<array<double>>")
    pts = spark.createDataFrame([("r1", 1, -60.8, -33.8, 0.9)],
                                "region_id string, point_id int, lon double, lat double, stress double")
    cells = PM.prescription(regions, pts, "soybean", resolution_m=100.0, efficiency=0.8, units="raw")
    rows = cells.collect()
    assert len(rows) == 1
    assert abs(rows[0].stress - 0.5) < 1e-12
    assert abs(rows[0].rate - 6.25) < 1e-12 and rows[0].zone == 3
    summ = PM.prescription_summary(cells).first()
    assert abs(summ.irrigation_uniformity_coefficient - 1.0) < 1e-12
    assert summ.variable_rate_water_savings_percent == 0.0
    z = {r.zone: r for r in PM.zone_stats(cells).collect()}
    assert abs(z[3].area_percentage - 100.0) < 1e-9 and z[1].pixel_count == 0
    area = regions.select(PM.field_area_ha("geometry", "raw").alias("a")).first().a
    assert abs(area - 1.6e-05) < 1e-12


def test_nearest_matches_brute_force(spark):
    ring = [[0.0, 0.0], [1.0, 0.0], [1.0, 1.0], [0.0, 1.0], [0.0, 0.0]]
    regions = spark.createDataFrame([("r", ring)], "region_id string, geometry array<array<double>>")
    import random
    rnd = random.Random(7)
    pts = [("r", i, rnd.random(), rnd.random() ** 3, rnd.random()) for i in range(40)]
    pdf = spark.createDataFrame(pts, "region_id string, point_id int, lon double, lat double, stress double")
    cells = PM.grid(regions, 0.05, units="raw")
    got = {(r.row, r.col): r.stress for r in PM.nearest_stress(cells, pdf).collect()}
    for c in cells.collect():
        best = min(pts, key=lambda p: ((c.lon - p[2]) ** 2 + (c.lat - p[3]) ** 2, p[1]))
        assert abs(got[(c.row, c.col)] - best[4]) < 1e-12
