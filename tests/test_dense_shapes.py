"""Shapes that lie so densely that all their pairs would be too many: the joins meet few of them, with the same results."""

import math
import random

import pytest

from gridlode.operators import geometry

SEGMENT = "geom_id int, x1 double, y1 double, x2 double, y2 double"
PLACE = "id int, x double, y double"


def lines(seed, n, side=100.0, length=12.0):
    draw = random.Random(seed)
    out = []
    for i in range(n):
        x, y = draw.uniform(0, side), draw.uniform(0, side)
        out.append((i, x, y, x + draw.uniform(-length, length), y + draw.uniform(-length, length)))
    return [*out, (n, 5.0, 0.0, 5.0, side), (n + 1, 0.0, 7.0, side, 7.0), (n + 1, side, 7.0, side + 5, 9.0)]


def crossing(a, b):
    (_, x1, y1, x2, y2), (_, x3, y3, x4, y4) = a, b
    d = (x2 - x1) * (y4 - y3) - (y2 - y1) * (x4 - x3)
    if d == 0:
        return None
    t, u = ((x3 - x1) * (y4 - y3) - (y3 - y1) * (x4 - x3)) / d, ((x3 - x1) * (y2 - y1) - (y3 - y1) * (x2 - x1)) / d
    return (x1 + t * (x2 - x1), y1 + t * (y2 - y1)) if 0 <= t <= 1 and 0 <= u <= 1 else None


def test_the_nearest_of_many_sites_is_met_in_small_tiles(spark, monkeypatch):
    draw, sizes, tiles = random.Random(3), [], geometry.tiles_of
    monkeypatch.setattr(geometry, "tiles_of", lambda lo, hi, size: sizes.append(size) or tiles(lo, hi, size))
    sites = [(i, float(draw.randrange(200)), float(draw.randrange(200))) for i in range(3000)] + [(5000, 900.0, 900.0), (4000, 900.0, 900.0), (6000, None, 1.0)]
    points = [(i, float(draw.randrange(200)), float(draw.randrange(200))) for i in range(400)] + [(900, 900.0, 980.0), (901, 900.0, 981.0), (902, None, 5.0), (903, math.nan, 5.0)]
    frames = [spark.createDataFrame(rows, PLACE) for rows in (points, sites)]
    got = {r.id: r.site for r in geometry.nearest_within(frames[0], frames[1].selectExpr("*", "id AS site"), 80.0, "id", "site").collect()}

    def best(x, y):
        near = min(((sx - x) ** 2 + (sy - y) ** 2, i) for i, sx, sy in sites if sx is not None)
        return near[1] if near[0] <= 6400 else None

    assert got == {i: best(x, y) if x is not None and x == x else None for i, x, y in points}
    assert got[900] == 4000 and got[901] is None and min(sizes) < 10


@pytest.mark.parametrize("tests", [2_000_000, 40])
def test_crossings_of_dense_lines(spark, monkeypatch, tests):
    monkeypatch.setattr(geometry, "TESTS", tests)
    a, b = lines(1, 150), lines(2, 150)
    out = geometry.crossings(spark.createDataFrame(a, SEGMENT), spark.createDataFrame(b, SEGMENT), 50.0)
    got = sorted((r.a_id, r.b_id, r.x, r.y) for r in out.collect())
    want = sorted((p[0], q[0], *at) for p in a for q in b if (at := crossing(p, q)))
    stretches = {(150, 150), (151, 151)}  # lines of both layers that lie on each other share stretches
    found, wanted = ([r for r in rows if r[:2] not in stretches] for rows in (got, want))
    assert len(found) == len(wanted) and all(p[:2] == q[:2] and math.dist(p[2:], q[2:]) < 1e-9 for p, q in zip(found, wanted, strict=True))
    assert tests > 40 or out.rdd.getNumPartitions() > 4  # tasks grow with the pairs


def test_node_distance_without_all_crossings(spark, monkeypatch):
    def every(*_):
        raise AssertionError("all crossings were made")

    monkeypatch.setattr(geometry, "crossings", every)
    a, b = lines(1, 300), lines(2, 300)
    nodes = [at for p in a for q in b if (at := crossing(p, q))]
    points = [(i, 10.0 + 8 * (i % 10), 10.0 + 8 * (i // 10)) for i in range(100)]
    out = geometry.node_distance(spark.createDataFrame(points, PLACE), spark.createDataFrame(a, SEGMENT), spark.createDataFrame(b, SEGMENT), 20.0, ["id"], 7.0)
    got = {r.id: r.distance for r in out.collect()}
    stretch = [7.0, 5.0]  # the shared stretches lie on y = 7 and x = 5
    want = {i: min(*(math.dist((x, y), n) for n in nodes), y - stretch[0], x - stretch[1]) for i, x, y in points}
    assert got.keys() == want.keys() and all(math.isclose(got[i], want[i], abs_tol=1e-9) for i in want)


def test_points_far_from_all_lines_meet_all_crossings(spark):
    a = spark.createDataFrame([(1, 0.0, 0.0, 2.0, 2.0)], SEGMENT)
    b = spark.createDataFrame([(1, 0.0, 2.0, 2.0, 0.0)], SEGMENT)
    points = spark.createDataFrame([(1, 1.0, 1.5), (2, 1.0, 101.0), (3, None, 1.0)], PLACE)
    assert {r.id: r.distance for r in geometry.node_distance(points, a, b, 1.0, ["id"], 7.0).collect()} == {1: 0.5, 2: 100.0, 3: None}
