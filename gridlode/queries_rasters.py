"""Registered queries of tiled rasters, projections and images, and their DuckDB SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from gridlode.functions import projections
from gridlode.operators import terrain, tiles
from gridlode.operators.tiles import Grid
from gridlode.plans.materialize import ensure_checkpoint_dir
from gridlode.queries import FULL, OCC, _rounded, query
from gridlode.queries_points import _HOLED, _gradient_sql, _holed, _window_sql
from gridlode.sources import geotiff, tables

#: Pixels of a side of a tile in these queries, so that small tables have several.
TILE = 64
PIXEL = 10.0


def _derived_sql(source: str) -> str:
    return f"""{source}, {_gradient_sql('g', 'v', 'd1')}, {_gradient_sql('d1', 'd1x', 'd2')}, {_gradient_sql('d2', 'd1y', 'd3')}, {_window_sql('near', 7)}, {_window_sql('fine', 4)}
SELECT d3.r, d3.c, e AS elevation, round(sqrt(d1x * d1x + d1y * d1y), 6) AS slope, round(d2x + d3y, 6) AS curvature, round(v - nearv, 6) AS position, round(sqrt(greatest(fines - finev * finev, 0)), 4) AS roughness
FROM d3 JOIN near USING (r, c) JOIN fine USING (r, c)"""


def _rounded_derivatives(out):
    return out.select("r", "c", "elevation", *[_rounded(c, n).alias(c) for c, n in (("slope", 6), ("curvature", 6), ("position", 6), ("roughness", 4))])


@query(_derived_sql(f"WITH {FULL}, {_HOLED}"))
def tiled_derivatives(spark, d):
    """The derivatives of terrain_derivatives, over tiles with strips of their neighbours."""
    holed = _holed(spark, d)
    grid = Grid(*terrain.shape(holed), side=TILE)
    out = tiles.derivatives(tiles.tiled(holed, "v", grid), grid)
    return _rounded_derivatives(tiles.pixels(out, grid, ["elevation", *tiles.DERIVED]))


#: Columns that each of three overlapping rasters covers; every fourth pixel, another in each, is missing.
COVERS = [(0, 50), (30, 80), (60, 100)]


def _sources(spark, d):
    """Blocks of the three rasters, which overlap, and the rows that they have."""
    o = tables.table(spark, d, "orders").select("o_custkey", F.floor(F.col("o_orderkey") / tables.RELIEF_COLUMNS).cast("long").alias("r"), (F.col("o_orderkey") % tables.RELIEF_COLUMNS).alias("c"), F.floor(F.col("o_totalprice") / 1000).cast("double").alias("v"))
    rows, _ = terrain.shape(o)
    parts = None
    for k, (lo, hi) in enumerate(COVERS):
        grid = Grid(rows, hi - lo, lo * PIXEL, rows * PIXEL, PIXEL, PIXEL, TILE)
        own = o.where(F.col("c").between(lo, hi - 1)).select("r", (F.col("c") - lo).alias("c"), F.when(F.col("o_custkey") % 4 != k, F.col("v") + 1000 * k).alias("v"))
        b = tiles.blocks(tiles.tiled(own, "v", grid), grid, f"s{k}", k)
        parts = b if parts is None else parts.unionByName(b)
    return parts, rows


def _target(rows: int) -> Grid:
    """The padded box, whose pixels' centres are corners of the rasters' pixels."""
    return Grid.over((100.0, 100.0, 900.0, (rows - 10) * PIXEL), PIXEL, PIXEL, pad=5.0, side=TILE)


_MOSAIC = f"""o AS (SELECT o_orderkey // {tables.RELIEF_COLUMNS} AS r, o_orderkey % {tables.RELIEF_COLUMNS} AS c, o_custkey AS k, floor(o_totalprice / 1000)::DOUBLE AS v FROM orders),
n AS (SELECT max(r) + 1 AS n FROM o), s(s, lo, hi) AS (VALUES {', '.join(f'({k}, {lo}, {hi})' for k, (lo, hi) in enumerate(COVERS))}),
p AS (SELECT s, r, c, CASE WHEN k % 4 <> s THEN v + 1000 * s END AS v FROM o, s WHERE c >= lo AND c < hi),
a AS (SELECT s, r - 10 + i AS r, c - 10 + j AS c, avg(v) AS v, max((i = 0 AND j = 0)::INT) AS held FROM p, (SELECT unnest([0, 1]) AS i), (SELECT unnest([0, 1]) AS j) GROUP BY ALL),
m AS (SELECT r, c, arg_min(v, s) AS v FROM a, n WHERE held = 1 AND v IS NOT NULL AND r BETWEEN 0 AND n - 20 AND c BETWEEN 0 AND 80 GROUP BY ALL)"""


@query(f"WITH {_MOSAIC} SELECT r, c, round(v, 6) AS v FROM m")
def dem_mosaic(spark, d):
    """Three overlapping rasters as one on a padded box, interpolated, the first one with a value first."""
    parts, rows = _sources(spark, d)
    grid = _target(rows)
    return tiles.pixels(tiles.mosaic(parts, grid), grid, ["values"]).where("values IS NOT NULL").select("r", "c", _rounded("values").alias("v"))


@query(
    f"""WITH {_MOSAIC}, {OCC}, w AS (SELECT i AS r, j AS c FROM (SELECT unnest(range(n - 19)) AS i FROM n), (SELECT unnest(range(81)) AS j)),
e AS (SELECT w.r, w.c, coalesce(m.v, (SELECT avg(v) FROM m)) AS v FROM w LEFT JOIN m USING (r, c)),
g AS (SELECT e.r, e.c,
  CASE WHEN c = 0 THEN lead(v) OVER h - v WHEN c = 80 THEN v - lag(v) OVER h ELSE (lead(v) OVER h - lag(v) OVER h) / 2 END AS gx,
  CASE WHEN r = 0 THEN lead(v) OVER u - v WHEN r = (SELECT max(r) FROM w) THEN v - lag(v) OVER u ELSE (lead(v) OVER u - lag(v) OVER u) / 2 END AS gy
  FROM e WINDOW h AS (PARTITION BY r ORDER BY c), u AS (PARTITION BY c ORDER BY r)),
t AS (SELECT id, floor(((SELECT n FROM n) * 10 - 95 - y / 10.0) / 10)::BIGINT AS r, floor((x / 20.0 - 95) / 10)::BIGINT AS c FROM occ)
SELECT id, m.v AS elevation, round(sqrt(gx * gx + gy * gy), 5) AS slope FROM t LEFT JOIN g USING (r, c) LEFT JOIN (SELECT r, c, round(v, 6) AS v FROM m) m USING (r, c)"""
)
def sampled_relief(spark, d):
    """Mosaic, derivatives and their values at points: the whole way from tiles of relief to features."""
    parts, rows = _sources(spark, d)
    grid = _target(rows)
    derived = tiles.derivatives(tiles.mosaic(parts, grid), grid)
    points = tables.occurrences(spark, d).select("id", (F.col("x") / 20).alias("x"), (F.col("y") / 10).alias("y"))
    out = tiles.sample(points, derived, grid, ["elevation", "slope"])
    return out.select("id", _rounded("elevation").alias("elevation"), _rounded("slope", 5).alias("slope"))


@query(f"WITH {FULL}, {_HOLED} SELECT r, c, e AS v FROM h WHERE e IS NOT NULL AND r BETWEEN 3 AND 120 AND c BETWEEN 20 AND 80")
def image_window(spark, d):
    """A raster written as an image, and a window of it read back."""
    holed = _holed(spark, d)
    grid = Grid(*terrain.shape(holed), 0.0, 0.0, 1.0, 1.0, TILE)
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/image-{uuid.uuid4().hex}.tif"
    spark.dataSource.register(geotiff.GeoTiff)
    tiles.tiled(holed, "v", grid).write.format("geotiff").options(rows=str(grid.rows), columns=str(grid.columns), side=str(TILE)).mode("overwrite").save(path)
    back = spark.read.format("geotiff").option("window", "3,121,20,81").load(path)
    each = back.select("r0", "c0", "columns", F.posexplode("values").alias("at", "v"))
    return each.where("v IS NOT NULL").select((F.col("r0") + F.floor(F.col("at") / F.col("columns"))).alias("r"), (F.col("c0") + F.col("at") % F.col("columns")).alias("c"), "v")


#: A zone of Gauss and Krüger on Krassovsky's ellipsoid, and places around it in degrees on the same.
ZONE = "+proj=tmerc +lon_0=105 +lat_0=0 +x_0=500000 +y_0=0 +k_0=1 +ellps=krass +units=m"
PLAIN = "+proj=longlat +ellps=krass"
_PLACES = "pl AS (SELECT id, 100 + x / 2000.0::DOUBLE AS lon, 60 + y / 1000.0::DOUBLE AS lat FROM occ)"


def _places(spark, d):
    return tables.occurrences(spark, d).select("id", (100 + F.col("x") / 2000).alias("lon"), (60 + F.col("y") / 1000).alias("lat"))


def _forward_sql() -> str:
    p = projections.parse(ZONE)
    c = projections.series(projections.FORWARD, p.n)
    north = " + ".join(f"{a!r}::DOUBLE * sin({2 * j} * xi) * cosh({2 * j} * eta)" for j, a in enumerate(c, 1))
    east = " + ".join(f"{a!r}::DOUBLE * cos({2 * j} * xi) * sinh({2 * j} * eta)" for j, a in enumerate(c, 1))
    scale = projections.rectifying_radius(p)
    return f"""a AS (SELECT id, radians(lon - 105) AS l, sin(radians(lat)) AS s, tan(radians(lat)) AS t FROM pl),
b AS (SELECT id, l, t, sinh({p.e!r}::DOUBLE * atanh({p.e!r}::DOUBLE * s)) AS g FROM a), c AS (SELECT id, l, t * sqrt(1 + g * g) - g * sqrt(1 + t * t) AS t FROM b),
e AS (SELECT id, atan2(t, cos(l)) AS xi, asinh(sin(l) / sqrt(t * t + cos(l) * cos(l))) AS eta FROM c)
SELECT id, round({scale!r}::DOUBLE * (eta + {east}) + 500000, 4) AS x, round({scale!r}::DOUBLE * (xi + {north}), 4) AS y FROM e"""


@query(f"WITH {OCC}, {_PLACES}, {_forward_sql()}")
def projected_points(spark, d):
    """Geographic coordinates in a zone of the transverse Mercator projection."""
    out = projections.reproject(_places(spark, d), [("lon", "lat")], PLAIN, ZONE)
    return out.select("id", _rounded("lon", 4).alias("x"), _rounded("lat", 4).alias("y"))


def _albers_sql() -> str:
    p = projections.parse(5070)
    n, c, origin = projections._conic(p)
    e, e2 = repr(p.e), repr(p.e2)
    return f"""SELECT id, round({p.a!r}::DOUBLE * rho * sin({n!r}::DOUBLE * l), 4) AS x, round({p.a!r}::DOUBLE * ({origin!r}::DOUBLE - rho * cos({n!r}::DOUBLE * l)), 4) AS y FROM (
  SELECT id, radians(lon - 200 + 96) AS l, sqrt({c!r}::DOUBLE - {n!r}::DOUBLE * (1 - {e2}::DOUBLE) * (s / (1 - {e2}::DOUBLE * s * s) + atanh({e}::DOUBLE * s) / {e}::DOUBLE)) / {n!r}::DOUBLE AS rho
  FROM (SELECT id, lon, sin(radians(lat - 25)) AS s FROM pl))"""


@query(f"WITH {OCC}, {_PLACES} {_albers_sql()}")
def equal_area_points(spark, d):
    """Geographic coordinates of another datum without a shift in an equal-area cone."""
    places = _places(spark, d).select("id", (F.col("lon") - 200).alias("lon"), (F.col("lat") - 25).alias("lat"))
    out = projections.reproject(places, [("lon", "lat")], 4269, 5070)
    return out.select("id", _rounded("lon", 4).alias("x"), _rounded("lat", 4).alias("y"))


@query(f"WITH {OCC}, {_PLACES} SELECT id, round(lon, 7) AS lon, round(lat, 7) AS lat FROM pl")
def reprojected_back(spark, d):
    """From WGS 84 through a shifted datum, a zone, a cone and a UTM zone, and back to where it began."""
    shifted = "+towgs84=23.57,-140.95,-79.8,0,0.35,0.79,-0.22"
    way = [4326, f"{ZONE} {shifted}", f"+proj=lcc +lat_1=60 +lat_2=75 +lat_0=65 +lon_0=100 +ellps=krass {shifted}", f"{PLAIN} {shifted}", 32648, 4326]
    out = _places(spark, d)
    for a, b in zip(way, way[1:], strict=False):
        out = projections.reproject(out, [("lon", "lat")], a, b)
    return out.select("id", _rounded("lon", 7).alias("lon"), _rounded("lat", 7).alias("lat"))
