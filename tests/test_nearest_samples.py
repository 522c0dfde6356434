"""Nearest samples against brute force, on crowded, tied, sparse and empty inputs, by every way of joining."""
import random

import pytest

from verdant.operators import prescription as PM

POINT = "region_id string, point_id int, lon double, lat double, stress double"


def ring(x0, y0, x1, y1):
    return [[float(x), float(y)] for x, y in ((x0, y0), (x1, y0), (x1, y1), (x0, y1), (x0, y0))]


def samples():
    rnd = random.Random(11)
    far = [("wide", i, rnd.random() * 4, rnd.random() * 0.2, rnd.random()) for i in range(60)]
    crowd = [("crowd", i, 0.2 + rnd.random() * 1e-3, 0.7 + rnd.random() * 1e-3, rnd.random()) for i in range(400)]
    crowd += [("crowd", 900, 0.9, 0.1, 0.3), ("crowd", 901, 0.9, 0.1, 0.4), ("crowd", 902, None, 0.1, 0.9), ("crowd", 903, 0.5, 0.5, None)]
    tied = [("tied", i, x, y, i / 10) for i, (x, y) in enumerate([(1.0, 1.0), (0.0, 0.0), (1.0, 0.0), (0.0, 1.0)])]
    outside = [("outside", i, 5.0 + i, -3.0, 0.1 * i) for i in range(3)]
    return far + crowd + tied + outside + [("few", 1, 0.1, 0.1, 0.9), ("few", 2, 0.2, 0.2, 0.8), ("elsewhere", 1, 0.0, 0.0, 1.0)]


def expected(cells, points):
    held = {}
    for p in points:
        if None not in p:
            held.setdefault(p[0], []).append(p)
    told = {}
    for c in cells:
        near = held.get(c.region_id, [])
        told[c.region_id, c.row, c.col] = 0.5 if len(near) < 3 else min(near, key=lambda p: ((c.lon - p[2]) ** 2 + (c.lat - p[3]) ** 2, p[1]))[4]
    return told


@pytest.mark.parametrize("settings", [{}, {"CELLS_PER_TILE": 16}, {"CHUNK": 8, "FEW": 2}, {"CHUNK": 4, "BROADCAST_ENTRIES": 0, "CELLS_PER_TILE": 64}])
def test_every_cell_takes_the_nearest_sample(spark, monkeypatch, settings):
    for name, value in settings.items():
        monkeypatch.setattr(PM, name, value)
    areas = {"wide": ring(0, 0, 4, 0.2), "crowd": ring(0, 0, 1, 1), "tied": ring(0, 0, 1, 1), "outside": ring(0, 0, 1, 0.5), "few": ring(0, 0, 0.5, 0.5),
             "none": ring(0, 0, 0.3, 0.3), "line": ring(0, 0, 1, 0)}
    regions = spark.createDataFrame(list(areas.items()), "region_id string, geometry array<array<double>>")
    points = samples() + [("line", i, i / 7, 0.0, i / 10) for i in range(5)]
    cells = PM.grid(regions, 0.05, units="raw")
    got = PM.nearest_stress(cells, spark.createDataFrame(points, POINT))
    assert got.columns == [*cells.columns, "stress"]
    rows = got.collect()
    want = expected(cells.collect(), points)
    assert len(rows) == len(want)
    assert {(r.region_id, r.row, r.col): r.stress for r in rows} == want


def test_empty_tables(spark):
    regions = spark.createDataFrame([("r", ring(0, 0, 1, 1))], "region_id string, geometry array<array<double>>")
    cells, none = PM.grid(regions, 0.5, units="raw"), spark.createDataFrame([], POINT)
    assert {r.stress for r in PM.nearest_stress(cells, none).collect()} == {0.5}
    assert PM.nearest_stress(cells.limit(0), spark.createDataFrame(samples(), POINT)).collect() == []
