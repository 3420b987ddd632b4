"""Tiled rasters against the operators on pixels, and mosaics against plain interpolation."""

import math
import random

import pytest
from pyspark.sql import functions as F

from gridlode.operators import terrain, tiles
from gridlode.operators.tiles import Grid


def pixels(spark, rows, columns, seed=1, holes=0.1):
    rng = random.Random(seed)
    data = [(r, c, None if rng.random() < holes else rng.uniform(-50, 900)) for r in range(rows) for c in range(columns)]
    return spark.createDataFrame(data, "r long, c long, v double")


def as_dict(df, *values):
    return {(r.r, r.c): tuple(r[v] for v in values) for r in df.collect()}


def test_there_and_back(spark):
    grid = Grid(23, 37, side=8)
    p = pixels(spark, 23, 37)
    t = tiles.tiled(p, "v", grid)
    assert t.count() == 15 and max(len(r["values"]) for r in t.collect()) == 64
    assert as_dict(tiles.pixels(t, grid, ["values"]), "values") == as_dict(p, "v")


@pytest.mark.parametrize("rows,columns,side", [(23, 37, 8), (40, 9, 16), (7, 30, 64), (3, 2, 8), (17, 1, 7)])
def test_derivatives_as_on_pixels(spark, rows, columns, side):
    grid = Grid(rows, columns, side=side)
    p = pixels(spark, rows, columns)
    got = as_dict(tiles.pixels(tiles.derivatives(tiles.tiled(p, "v", grid), grid), grid, ["elevation", *tiles.DERIVED]), "elevation", *tiles.DERIVED)
    assert len(got) == rows * columns
    if min(rows, columns) < 7:
        return plain_derivatives(as_dict(p, "v"), rows, columns, got)
    want = as_dict(terrain.derivatives(p, "v", rows, columns), "elevation", *tiles.DERIVED)
    for k, v in want.items():
        assert got[k] == pytest.approx(v, abs=1e-4, nan_ok=True) if v[0] is not None else got[k][0] is None and got[k][1:] == pytest.approx(v[1:], abs=1e-4), k


def plain_derivatives(values, rows, columns, got):
    """Position only, by its definition, where the window is wider than the raster."""
    known = [v for (v,) in values.values() if v is not None]
    mean = sum(known) / len(known)
    fold = lambda i, n: i % (2 * n) if i % (2 * n) < n else 2 * n - 1 - i % (2 * n)
    e = {k: mean if v is None else v for k, (v,) in values.items()}
    for (r, c), v in got.items():
        near = [e[fold(r + i, rows), fold(c + j, columns)] for i in range(-7, 8) for j in range(-7, 8)]
        assert v[3] == pytest.approx(e[r, c] - sum(near) / 225, abs=1e-6)


def test_missing_tiles_count_as_the_mean(spark):
    grid = Grid(20, 20, side=8)
    p = pixels(spark, 20, 20, holes=0).where("r < 8 OR c < 8")
    got = as_dict(tiles.pixels(tiles.derivatives(tiles.tiled(p, "v", grid), grid), grid, ["elevation", "slope"]), "elevation", "slope")
    full = p.select("r", "c", "v").unionByName(spark.range(400).select((F.col("id") / 20).cast("long").alias("r"), (F.col("id") % 20).alias("c"), F.lit(None).cast("double").alias("v")).where("r >= 8 AND c >= 8"))
    want = as_dict(terrain.derivatives(full, "v", 20, 20), "elevation", "slope")
    assert len(got) == 400 and all(got[k][1] == pytest.approx(want[k][1]) and (got[k][0] is None) == (want[k][0] is None) for k in want)
    empty = tiles.derivatives(tiles.tiled(p.where("r < 0"), "v", grid), grid)
    assert {v for v in as_dict(tiles.pixels(empty, grid, ["slope"]), "slope").values()} == {(0.0,)}


def test_strips_must_fit(spark):
    with pytest.raises(ValueError):
        tiles.derivatives(tiles.tiled(pixels(spark, 9, 9), "v", Grid(9, 9, side=4)), Grid(9, 9, side=4))


def plain_mosaic(sources, grid):
    out = {}
    for r in range(grid.rows):
        for c in range(grid.columns):
            x, y = grid.x0 + (c + 0.5) * grid.dx, grid.top - (r + 0.5) * grid.dy
            out[r, c] = None
            for g, values in sources:
                row, column = (g.top - y) / g.dy, (x - g.x0) / g.dx
                if not (0 <= row < g.rows and 0 <= column < g.columns):
                    continue
                total = weight = 0.0
                for i in (math.floor(row - 0.5), math.floor(row - 0.5) + 1):
                    for j in (math.floor(column - 0.5), math.floor(column - 0.5) + 1):
                        w = (1 - abs(row - 0.5 - i)) * (1 - abs(column - 0.5 - j))
                        v = values.get((i, j), (None,))[0]
                        if v is not None and w > 0:
                            total, weight = total + w * v, weight + w
                if weight > 0:
                    out[r, c] = total / weight
                    break
    return out


def test_mosaic(spark):
    """Overlapping rasters of several resolutions, cut into tiles of their own, on a padded box."""
    target = Grid.over((10.0, 5.0, 60.0, 45.0), 1.5, 1.25, pad=2.0, side=16)
    assert (target.rows, target.columns, target.x0, target.top) == (35, 36, 8.0, 47.0)
    grids = [Grid(20, 20, 0.0, 40.0, 1.0, 1.0, 8), Grid(12, 30, 15.0, 50.0, 2.0, 1.6, 7), Grid(40, 10, 40.0, 60.0, 3.0, 1.5, 16), Grid(5, 5, 500.0, 500.0, 1.0, 1.0, 8)]
    held = [(g, pixels(spark, g.rows, g.columns, seed=k, holes=0.3)) for k, g in enumerate(grids)]
    parts = None
    for k, (g, p) in enumerate(held):
        b = tiles.blocks(tiles.tiled(p, "v", g), g, f"s{k}", k)
        parts = b if parts is None else parts.unionByName(b)
    got = as_dict(tiles.pixels(tiles.mosaic(parts, target), target, ["values"]), "values")
    want = plain_mosaic([(g, as_dict(p, "v")) for g, p in held], target)
    assert sum(v is not None for v in want.values()) > 500
    for k, v in want.items():
        assert got.get(k, (None,))[0] == (None if v is None else pytest.approx(v, abs=1e-9)), k
    assert tiles.place_of(parts.where("priority = 0")) == (0.0, 20.0, 20.0, 40.0) and tiles.place_of(parts.where("priority = 9")) is None
    assert tiles.mosaic(parts.where("priority = 3"), target).count() == 0


def test_one_tile_under_many_rasters(spark):
    grid = Grid(4, 4, 0.0, 4.0, side=16)
    one = tiles.tiled(pixels(spark, 4, 4, holes=0), "v", grid)
    many = tiles.blocks(one, grid, "x", 0).withColumn("priority", F.explode(F.sequence(F.lit(1), F.lit(60)))).withColumn("values", F.transform("values", lambda v: v + F.col("priority")))
    got = as_dict(tiles.pixels(tiles.mosaic(many, grid), grid, ["values"]), "values")
    want = as_dict(tiles.pixels(one, grid, ["values"]), "values")
    assert all(got[k][0] == pytest.approx(v[0] + 1) for k, v in want.items())


def test_samples(spark):
    grid = Grid(23, 37, 100.0, 230.0, 10.0, 10.0, 8)
    p = pixels(spark, 23, 37)
    points = spark.createDataFrame([(i, 95.0 + 3.1 * i, 235.0 - 2.0 * i) for i in range(140)] + [(999, None, 3.0)], "k long, x double, y double")
    got = {r.k: r["values"] for r in tiles.sample(points, tiles.tiled(p, "v", grid), grid, ["values"]).collect()}
    v = as_dict(p, "v")
    want = {i: v.get((math.floor((230.0 - (235.0 - 2.0 * i)) / 10), math.floor((95.0 + 3.1 * i - 100.0) / 10)), (None,))[0] for i in range(140)}
    assert got == {**want, 999: None}
