"""Regions cut into cells against the even-odd test of whole rings; ids with several positions."""

import random

import numpy as np
from pyspark.sql import functions as F

from wayline.operators.spatial import region_of, ring_cells, ring_holds, within_distance

RING = "region string, ring array<struct<lon double, lat double>>"


def test_cut_rings_hold_the_same_points(spark):
    rnd = random.Random(5)
    rings = []
    for k in range(4):
        n, cx, cy = rnd.choice([5, 40]), rnd.uniform(-20, 20), rnd.uniform(-10, 10)
        pts = [(float(cx + rnd.uniform(0.2, 4) * np.cos(t)), float(cy + rnd.uniform(0.2, 4) * np.sin(t))) for t in np.linspace(0, 2 * np.pi, n, endpoint=False)]
        rings.append((f"r{k}", [*pts, pts[0]]))
    rings += [("box", [(0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 1.0), (0.0, 0.0)]), ("few", [(0.0, 0.0), (1.0, 0.0), (0.0, 0.0)]), ("none", None), (None, [(0.0, 0.0)] * 5)]
    regions = spark.createDataFrame(rings, RING)
    pts = [(i, (rnd.uniform(-25, 25), rnd.uniform(-15, 15))) for i in range(3000)] + [(9000, (0.0, 0.0)), (9001, (1.0, 0.5)), (9002, (0.5, 0.0)), (9003, (0.5, 1.0)), (9004, None)]
    points = spark.createDataFrame(pts, "id int, pos struct<lon double, lat double>")
    want = {tuple(r) for r in points.where("pos is not null").select("id", "pos.lon", "pos.lat").crossJoin(regions.where("region is not null and size(ring) > 3")).where(ring_holds("ring", "lon", "lat")).select("id", "region").collect()}
    for cell in (0.5, 3.0):
        assert {tuple(r) for r in region_of(points, regions, cell).collect()} == want
    assert region_of(points.limit(0), regions).count() == 0 and region_of(points, regions.limit(0)).count() == 0


def test_cells_inside_need_no_edges():
    x, y = np.array([0.0, 10, 10, 0, 0]), np.array([0.0, 0, 10, 10, 0])
    got = {(cx, cy): e is None for cx, cy, e in ring_cells(x, y, 1.0)}
    assert all(got[(i, j)] for i in range(1, 9) for j in range(1, 9)) and (12, 5) not in got and not got[(0, 5)]


def test_ids_with_several_positions(spark):
    pos = "id int, pos struct<lon double, lat double>"
    a = spark.createDataFrame([(1, (0.0, 1.0)), (1, (0.001, 1.0)), (1, (0.0, 1.0)), (2, (50.0, 1.0)), (3, None), (None, (0.0, 1.0))], pos)
    b = spark.createDataFrame([(7, (0.0011, 1.0)), (8, (50.0, 1.0)), (8, (50.0001, 1.0)), (9, (0.1, 1.0))], pos)
    got = {(r.a_id, r.b_id): round(r.metres, 1) for r in within_distance(a, b, 300.0).collect()}
    assert got == {(1, 7): 11.1, (2, 8): 0.0}
    assert within_distance(a, b, 300.0).count() == 2 and within_distance(a.limit(0), b, 300.0).agg(F.count("*")).first()[0] == 0
