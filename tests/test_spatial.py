"""Spatial joins against brute force."""

import math
import random

import pytest
from pyspark.sql import functions as F

from furrow.functions import geo
from furrow.operators import spatial

R = 6371008.8


def hav(a, b):
    (x1, y1), (x2, y2) = a, b
    p = math.radians
    h = math.sin(p(y2 - y1) / 2) ** 2 + math.cos(p(y1)) * math.cos(p(y2)) * math.sin(p(x2 - x1) / 2) ** 2
    return 2 * R * math.asin(min(1, math.sqrt(h)))


def frames(spark, pts, places):
    p = spark.createDataFrame([(i, x, y) for i, (x, y) in enumerate(pts)], "pid long, lon double, lat double")
    q = spark.createDataFrame([(i, x, y) for i, (x, y) in enumerate(places)], "sid long, lon double, lat double")
    return p, q


def brute(pts, places):
    return {i: min((round(hav(p, q), 3), j) for j, q in enumerate(places)) for i, p in enumerate(pts)}


def test_nearest_anywhere(spark):
    rnd = random.Random(3)
    places = [(rnd.uniform(-180, 180), rnd.uniform(-89, 89)) for _ in range(150)]
    places += [(36.8 + rnd.gauss(0, 0.01), -1.3 + rnd.gauss(0, 0.01)) for _ in range(150)]  # a dense town
    places += [(36.8, -1.3)] * 30  # copies
    pts = [(rnd.uniform(-180, 180), rnd.uniform(-89, 89)) for _ in range(150)]
    pts += [(36.8 + rnd.gauss(0, 0.02), -1.3) for _ in range(50)] + [(179.99, 10.0), (-179.99, 10.0), (0.0, 90.0), (36.8, -1.3)]
    p, q = frames(spark, pts, places)
    for levels in (None, [2, 5]):
        got = {r.pid: (r.distance_m, r.sid) for r in spatial.nearest_place(p, q, "pid", "sid", levels).collect()}
        want = brute(pts, places)
        assert got.keys() == want.keys()
        for k in want:
            assert got[k][0] == pytest.approx(want[k][0], abs=0.002)
            if hav(pts[k], places[got[k][1]]) > hav(pts[k], places[want[k][1]]) + 0.002:
                raise AssertionError((k, got[k], want[k]))


def test_nearest_within_radius(spark):
    rnd = random.Random(5)
    places = [(36 + rnd.uniform(0, 1), -1 + rnd.uniform(0, 1)) for _ in range(120)]
    pts = [(36 + rnd.uniform(-0.2, 1.2), -1 + rnd.uniform(-0.2, 1.2)) for _ in range(200)]
    p, q = frames(spark, pts, places)
    got = {r.pid: r.sid for r in spatial.nearest_within(p, q, "pid", "sid", 8000.0).collect()}
    want = {k: j for k, (d, j) in brute(pts, places).items() if d <= 8000}
    assert got == want


OUTER = [(0.0, 0.0), (10.0, 0.0), (10.0, 10.0), (5.0, 5.0), (0.0, 10.0), (0.0, 0.0)]
HOLE = [(1.0, 1.0), (2.0, 1.0), (2.0, 2.0), (1.0, 2.0), (1.0, 1.0)]


def test_polygon_with_hole_and_boundary(spark):
    pts = {(5.0, 2.0): "in", (5.0, 7.0): "out", (1.5, 1.5): "out", (5.0, 5.0): "edge", (10.0, 3.0): "edge", (1.0, 1.5): "edge",
           (-1.0, 0.0): "out", (0.0, 0.0): "edge", (9.0, 8.5): "in", (5.0, 0.0): "edge", (11.0, 0.0): "out"}
    df = spark.createDataFrame([(x, y) for x, y in pts], "lon double, lat double")
    for boundary, keep in (("exclude", {"in"}), ("include", {"in", "edge"})):
        got = {(r.lon, r.lat) for r in spatial.within_area(df, [OUTER, HOLE], boundary).collect()}
        assert got == {p for p, k in pts.items() if k in keep}


def test_point_area_join_matches_filter(spark):
    rnd = random.Random(7)
    pts = [(rnd.uniform(-2, 12), rnd.uniform(-2, 12)) for _ in range(300)]
    p = spark.createDataFrame([(i, x, y) for i, (x, y) in enumerate(pts)], "pid long, lon double, lat double")
    ring = lambda pts: F.array(*[geo.point(F.lit(x), F.lit(y)) for x, y in pts])
    areas = spark.range(1).select(F.lit("a").alias("name"), F.array(ring(OUTER), ring(HOLE)).alias("area"))
    got = {r.pid for r in spatial.join_points_to_areas(p, areas, bucket_deg=0.7).collect()}
    want = {r.pid for r in spatial.within_area(p, [OUTER, HOLE], "include").collect()}
    assert got == want and len(got) > 50
    left = spatial.join_points_to_areas(p, areas, bucket_deg=3.0, how="left")
    assert left.count() == 300 and left.where("name is not null").count() == len(got)


def test_tiles_cover_only_what_overlaps(spark):
    ring = lambda pts: F.array(*[geo.point(F.lit(x), F.lit(y)) for x, y in pts])
    tri = [(0.01, 0.01), (0.5, 0.01), (0.01, 0.5), (0.01, 0.01)]
    a = spark.range(1).select(F.array(ring(tri)).alias("area"))
    rows = spatial.tiles(a, "area", 5000).collect()
    # tiles wholly beyond the slanted side are absent, those under it present
    inside = [r for r in rows if r.lon1 + r.lat1 < 0.5]
    assert inside and all(r.lon0 + r.lat0 < 0.52 for r in rows)
    assert len(rows) < 11 * 11


def test_irregular_axis(spark):
    axis = spark.createDataFrame([(c,) for c in (0.0, 1.0, 3.0, 3.5, 7.0)], "c double")
    vals = [-5.0, 0.4, 0.5, 2.0, 3.2, 3.3, 5.25, 9.0]
    p = spark.createDataFrame(list(enumerate(vals)), "i int, v double")
    got = {r.i: r.c for r in spatial.nearest_on_axis(p, axis, "v", "c", 3.5, ["i"]).collect()}
    assert got == {i: min((abs(c - v), c) for c in (0.0, 1.0, 3.0, 3.5, 7.0))[1] for i, v in enumerate(vals)}


def test_snap_and_gaps(spark):
    df = spark.createDataFrame([(0.02,), (0.52,), (2.0,), (0.3,)], "v double")
    got = [r.i for r in df.select(spatial.snap(F.col("v"), 0.0, 0.5, 0.1).alias("i")).collect()]
    assert got == [0, 1, 4, None]
    filled = spatial.fill_index_gaps(spark.createDataFrame([(0,), (1,), (4,)], "i int"), "i").orderBy("i").collect()
    assert [(r.i, r.is_gap_filled) for r in filled] == [(0, False), (1, False), (2, True), (3, True), (4, False)]
    assert spatial.is_contiguous(spark.createDataFrame([(0,), (1,), (4,)], "i int"), "i").first().contiguous is False
    assert spatial.axis_origin(-27.0, -28.1, 0.5) == -28.5
