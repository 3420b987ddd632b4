"""Registered queries of the spatial operators, and their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridlode.functions import numeric
from gridlode.operators import components, features, geometry, grid, metrics, models, points, sampling, terrain, validation
from gridlode.sources import tables

SIDE = tables.SIDE
DISTANCES = {"facies": "q", "paleo": "p", "struct": "d", "magm": "t", "tect1": "mq", "tect2": "mp"}
AREAS = [0.05, 0.1, 0.15, 0.2]
QUERIES: dict = {}
ORACLE: dict = {}

CELLS = f"""cells AS (
  SELECT r, c, ((sum(round(l_quantity * 100)::BIGINT) * 100)::BIGINT // count(*)) / 10000.0::DOUBLE AS q, ((sum(round(l_extendedprice * 100)::BIGINT) * 100)::BIGINT // count(*)) / 10000.0::DOUBLE AS p, ((sum(round(l_discount * 100)::BIGINT) * 100)::BIGINT // count(*)) / 10000.0::DOUBLE AS d, ((sum(round(l_tax * 100)::BIGINT) * 100)::BIGINT // count(*)) / 10000.0::DOUBLE AS t,
         max(l_quantity) AS mq, min(l_extendedprice) AS mp, count(*) AS n
  FROM (SELECT *, (l_orderkey * 7 + l_linenumber * 3) % {SIDE} AS r, (l_partkey * 11 + l_suppkey) % {SIDE} AS c FROM lineitem)
  WHERE (r - 20) * (r - 20) + (c - 20) * (c - 20) <= 361 GROUP BY r, c)"""
RAST = f"rast AS (SELECT r, c, CASE WHEN (r * {SIDE} + c) % 17 <> 0 THEN p END AS v FROM cells)"
#: The raster of one pixel an order; its last column, and its rows.
FULL = f"f AS (SELECT o_orderkey // {tables.RELIEF_COLUMNS} AS r, o_orderkey % {tables.RELIEF_COLUMNS} AS c, floor(o_totalprice / 1000)::DOUBLE AS v FROM orders)"
LAST, ROWS = tables.RELIEF_COLUMNS - 1, "(SELECT max(r) + 1 FROM f)"
OCC = "occ AS (SELECT o_orderkey AS id, (o_orderkey * 7919 + o_custkey * 104729) % 20000 AS x, (o_orderkey * 15485863 + o_custkey * 32452843) % 20000 AS y, o_orderstatus AS status, o_totalprice AS price FROM orders)"
SEGS = """segs AS (SELECT geom_id, x1, y1, x1 + 500 + (geom_id * 389) % 3000 AS x2, y1 - 1500 + (geom_id * 769) % 3000 AS y2
  FROM (SELECT s_suppkey AS geom_id, (s_suppkey * 6151) % 20000 AS x1, (s_suppkey * 3079 + s_nationkey::BIGINT * 1543) % 20000 AS y1 FROM supplier))"""
BOXES = """boxes AS (SELECT geom_id, x0, y0, x0 + 1000 + (k * 37) % 2000 AS x1, y0 + 1000 + (k * 53) % 2000 AS y1
  FROM (SELECT n_nationkey AS geom_id, n_nationkey::BIGINT AS k, (n_nationkey::BIGINT % 5) * 4000 + 300 AS x0, (n_nationkey::BIGINT // 5) * 4000 + 300 AS y0 FROM nation))"""
FEATS = f"feats AS (SELECT vec_id AS cell_id, {', '.join(f'embedding[{i + 1}]::DOUBLE AS f{i}' for i in range(13))}, (label = 3)::INT AS presence, vec_id % 20 AS block FROM embeddings)"
HASH = "('0x' || substr(md5({}), 1, 8))::BIGINT"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def _rounded(c, digits: int = 6):
    return F.round(c, digits)


def _robust_sql(expression: str, source: str, low: float, high: float) -> str:
    """The scaled value, given one row z of limits."""
    return f"(SELECT quantile_cont({expression}, {low}) AS lo, quantile_cont({expression}, {high}) AS hi, min({expression}) AS a, max({expression}) AS b FROM {source})"


def _scaled(v: str, z: str) -> str:
    inside = f"greatest(0, least(1, ({v} - {z}.lo) / ({z}.hi - {z}.lo)))"
    return f"CASE WHEN abs({z}.lo - {z}.hi) > 1e-8 + 1e-5 * abs({z}.hi) THEN {inside} WHEN abs({z}.a - {z}.b) <= 1e-8 + 1e-5 * abs({z}.b) THEN 0.5 ELSE ({v} - {z}.a) / ({z}.b - {z}.a) END"


# numeric kernel


@query(f"WITH {CELLS}, z AS (SELECT min(p) AS a, max(p) AS b FROM cells) SELECT r, c, round((p - a) / (b - a), 6) AS scaled FROM cells, z")
def normalize_minmax(spark, d):
    g = tables.cells(spark, d)
    return g.select("r", "c", _rounded(numeric.minmax_01(g, F.col("p"))).alias("scaled"))


@query(f"WITH {CELLS}, z AS {_robust_sql('q', 'cells', 0.03, 0.97)} SELECT r, c, round({_scaled('q', 'z')}, 6) AS scaled FROM cells, z")
def normalize_robust(spark, d):
    g = tables.cells(spark, d)
    return g.select("r", "c", _rounded(numeric.robust_01(g, F.col("q"))).alias("scaled"))


@query(f"WITH {CELLS}, {RAST}, z AS {_robust_sql('v', 'rast', 0.02, 0.98)} SELECT r, c, round(CASE WHEN v IS NOT NULL THEN {_scaled('v', 'z')} END, 6) AS scaled FROM rast, z")
def normalize_with_gaps(spark, d):
    g = tables.raster(spark, d)
    return g.select("r", "c", _rounded(numeric.robust_01(g, F.col("v"), 0.02, 0.98)).alias("scaled"))


def _prox_sql() -> str:
    root = {"sqrt": "sqrt", "cbrt": "cbrt"}
    limits = ", ".join(f"quantile_cont({root[features.PROXIMITY[k][0]]}({c}), {features.PROXIMITY[k][1]}) AS s_{k}, avg({root[features.PROXIMITY[k][0]]}({c})) AS m_{k}" for k, c in DISTANCES.items())
    columns = ", ".join(f"greatest(0, least(1, exp(-{root[features.PROXIMITY[k][0]]}({c}) / CASE WHEN s_{k} > 0 THEN s_{k} ELSE greatest(m_{k}, 1) END))) AS prox_{k}" for k, c in DISTANCES.items())
    return f"sc AS (SELECT {limits} FROM cells), px AS (SELECT cells.*, {columns} FROM cells, sc)"


@query(f"WITH {CELLS}, {_prox_sql()} SELECT r, c, {', '.join(f'round(prox_{k}, 6) AS prox_{k}' for k in DISTANCES)} FROM px")
def proximities(spark, d):
    g = features.proximities(tables.cells(spark, d), DISTANCES)
    return g.select("r", "c", *[_rounded(f"prox_{k}").alias(f"prox_{k}") for k in DISTANCES])


_INTERACTIONS = f"""{_prox_sql()},
  i1 AS (SELECT *, 0.5 * (prox_tect1 + prox_tect2) AS combo FROM px),
  i2 AS (SELECT *, prox_tect1 * prox_tect2 AS tt, sqrt(combo * prox_magm) AS tm, sqrt(combo * prox_struct) AS ts, sqrt(prox_paleo * prox_struct) AS ps,
    sqrt(combo * (0.55 * prox_magm + 0.45 * prox_struct) * (0.60 * prox_paleo + 0.40 * prox_facies)) AS core,
    greatest(0, least(1, combo - (0.40 * prox_magm + 0.35 * prox_struct + 0.25 * prox_paleo))) AS bare FROM i1),
  zc AS {_robust_sql('core', 'i2', 0.02, 0.98)}, zb AS {_robust_sql('bare', 'i2', 0.02, 0.98)}"""


@query(
    f"WITH {CELLS}, {_INTERACTIONS} SELECT r, c, round(combo, 6) AS tect_combo, round(tt, 6) AS tect_intersection, round(tm, 6) AS tect_magm_intersection, "
    f"round(ts, 6) AS tect_struct_intersection, round(ps, 6) AS paleo_struct_intersection, round({_scaled('core', 'zc')}, 6) AS coincidence_score, round({_scaled('bare', 'zb')}, 6) AS tect_only_penalty FROM i2, zc, zb"
)
def factor_interactions(spark, d):
    g = features.interactions(features.proximities(tables.cells(spark, d), DISTANCES))
    names = ["tect_combo", "tect_intersection", "tect_magm_intersection", "tect_struct_intersection", "paleo_struct_intersection", "coincidence_score", "tect_only_penalty"]
    return g.select("r", "c", *[_rounded(n).alias(n) for n in names])


@query(f"WITH {CELLS}, {_INTERACTIONS}, lb AS (SELECT r, c, 0.38 * tt + 0.37 * tm + 0.25 * ts AS v FROM i2), z AS {_robust_sql('v', 'lb', 0.02, 0.98)} SELECT r, c, round({_scaled('v', 'z')}, 6) AS local_bonus FROM lb, z")
def local_bonus(spark, d):
    g = features.interactions(features.proximities(tables.cells(spark, d), DISTANCES))
    return g.select("r", "c", _rounded(features.local_bonus(g)).alias("local_bonus"))


def _taxonomy_sql() -> str:
    roots = ", ".join(f"{features.PROXIMITY[k][0]}({c}) AS z_{k}" for k, c in DISTANCES.items())
    ends = ", ".join(f"min(z_{k}) AS a_{k}, max(z_{k}) AS b_{k}" for k in DISTANCES)
    total = " + ".join(f"CASE WHEN b_{k} > a_{k} THEN {features.TAXONOMY[k]} * (z_{k} - a_{k}) / (b_{k} - a_{k}) ELSE 0 END" for k in DISTANCES)
    return f"t0 AS (SELECT r, c, {roots} FROM cells), t1 AS (SELECT {ends} FROM t0), t2 AS (SELECT r, c, {total} AS s FROM t0, t1), t3 AS (SELECT r, c, s / (SELECT avg(s) + 2 * stddev_pop(s) FROM t2) AS dist FROM t2), zt AS {_robust_sql('-dist', 't3', 0.02, 0.98)}"


@query(f"WITH {CELLS}, {_taxonomy_sql()} SELECT r, c, round(dist, 6) AS taxonomy_distance, round({_scaled('-dist', 'zt')}, 6) AS geo_score FROM t3, zt")
def taxonomy_score(spark, d):
    g = features.taxonomy_score(tables.cells(spark, d), DISTANCES)
    return g.select("r", "c", _rounded("taxonomy_distance").alias("taxonomy_distance"), _rounded("geo_score").alias("geo_score"))


@query(f"WITH {CELLS}, z AS (SELECT min(p) AS a, max(p) AS b FROM cells) SELECT r, c, least(floor(round((p - a) / (b - a), 6) * 20), 19)::INT AS class FROM cells, z")
def display_classes(spark, d):
    g = tables.cells(spark, d)
    return g.select("r", "c", numeric.classes(_rounded(numeric.minmax_01(g, F.col("p")))).alias("class"))


@query(f"WITH {CELLS} SELECT r, c, round((row_number() OVER (ORDER BY p, r * {SIDE} + c) - 1) / (SELECT count(*) - 1 FROM cells)::DOUBLE, 6) AS rank01 FROM cells")
def percentile_rank(spark, d):
    g = tables.cells(spark, d).withColumn("id", F.col("r") * SIDE + F.col("c"))
    return metrics.percentile_rank(g, "p", "id").select("r", "c", _rounded("rank01").alias("rank01"))


# grids

_OFFSETS = ", ".join(f"({a}, {b}, {w})" for (a, b), w in grid.SMOOTHING.items())


def _smooth_sql(source: str, value: str, passes: int) -> str:
    steps = [f"k(dr, dc, w) AS (VALUES {_OFFSETS})", f"s0 AS (SELECT r, c, {value} AS v FROM {source})"]
    for i in range(passes):
        steps.append(f"s{i + 1} AS (SELECT r + dr AS r, c + dc AS c, sum(v * w) / sum(w) AS v FROM s{i}, k WHERE v IS NOT NULL AND r + dr BETWEEN 0 AND {SIDE - 1} AND c + dc BETWEEN 0 AND {SIDE - 1} GROUP BY 1, 2)")
    return ", ".join(steps)


@query(f"WITH {CELLS}, {RAST}, {_smooth_sql('rast', 'v', 1)} SELECT rast.r, rast.c, round(s1.v + 0.0000001, 4) AS v FROM rast LEFT JOIN s1 USING (r, c)")
def smooth_once(spark, d):
    return grid.smooth(tables.raster(spark, d), "v", SIDE, SIDE).select("r", "c", _rounded(F.col("v") + 1e-7, 4).alias("v"))


@query(f"WITH {CELLS}, {RAST}, {_smooth_sql('rast', 'v', 3)} SELECT rast.r, rast.c, round(s3.v + 0.0000001, 4) AS v FROM rast LEFT JOIN s3 USING (r, c)")
def smooth_three_times(spark, d):
    return grid.smooth(tables.raster(spark, d), "v", SIDE, SIDE, 3).select("r", "c", _rounded(F.col("v") + 1e-7, 4).alias("v"))


@query(f"WITH {CELLS}, {RAST} SELECT x.r, x.c, x.v, coalesce(x.v >= max(y.v), false) AS peak FROM rast x LEFT JOIN rast y ON y.r BETWEEN x.r - 1 AND x.r + 1 AND y.c BETWEEN x.c - 1 AND x.c + 1 GROUP BY x.r, x.c, x.v")
def local_maxima(spark, d):
    return grid.local_maxima(tables.raster(spark, d), "v").select("r", "c", "v", "peak")


@query(
    f"""WITH {FULL} SELECT r, c,
  round(CASE WHEN c = 0 THEN lead(v) OVER h - v WHEN c = {LAST} THEN v - lag(v) OVER h ELSE (lead(v) OVER h - lag(v) OVER h) / 2 END, 6) AS gx,
  round(CASE WHEN r = 0 THEN lead(v) OVER w - v WHEN r = {ROWS} - 1 THEN v - lag(v) OVER w ELSE (lead(v) OVER w - lag(v) OVER w) / 2 END, 6) AS gy
FROM f WINDOW h AS (PARTITION BY r ORDER BY c), w AS (PARTITION BY c ORDER BY r)"""
)
def terrain_gradients(spark, d):
    full = tables.full_raster(spark, d)
    return grid.gradients(full, "v", *terrain.shape(full)).select("r", "c", _rounded("gx").alias("gx"), _rounded("gy").alias("gy"))


def _mirrored(axis: str, n: int | str) -> str:
    return f"CASE WHEN {axis} < 0 THEN -1 - {axis} WHEN {axis} >= {n} THEN 2 * {n} - 1 - {axis} ELSE {axis} END"


@query(
    f"""WITH {FULL}, k AS (SELECT i - 7 AS dr FROM range(15) AS x(i)),
m AS (SELECT f.r, f.c, avg(g.v) AS v FROM f, k, k AS k2, f AS g WHERE g.r = {_mirrored('(f.r + k.dr)', ROWS)} AND g.c = {_mirrored('(f.c + k2.dr)', LAST + 1)} GROUP BY ALL)
SELECT f.r, f.c, round(f.v - m.v, 6) AS tpi FROM f JOIN m USING (r, c)"""
)
def terrain_position(spark, d):
    full = tables.full_raster(spark, d)
    mean = grid.window_mean(full, "v", 15, *terrain.shape(full)).withColumnRenamed("v", "m")
    return full.join(mean, ["r", "c"]).select("r", "c", _rounded(F.col("v") - F.col("m")).alias("tpi"))


@query(
    f"""WITH {FULL}, k AS (SELECT i - 4 AS dr FROM range(9) AS x(i)),
m AS (SELECT f.r, f.c, avg(g.v) AS v, avg(g.v * g.v) AS s FROM f, k, k AS k2, f AS g WHERE g.r = {_mirrored('(f.r + k.dr)', ROWS)} AND g.c = {_mirrored('(f.c + k2.dr)', LAST + 1)} GROUP BY ALL)
SELECT r, c, round(sqrt(greatest(s - v * v, 0)), 4) AS roughness FROM m"""
)
def terrain_roughness(spark, d):
    full = tables.full_raster(spark, d)
    mean = grid.window_mean(full, "v", 9, *terrain.shape(full)).withColumnRenamed("v", "m")
    square = grid.window_mean(full.withColumn("v", F.col("v") * F.col("v")), "v", 9, *terrain.shape(full)).withColumnRenamed("v", "s")
    return mean.join(square, ["r", "c"]).select("r", "c", _rounded(F.sqrt(F.greatest(F.col("s") - F.col("m") * F.col("m"), F.lit(0.0))), 4).alias("roughness"))


@query(f"WITH {CELLS}, {RAST} SELECT r // 2 AS r, c // 2 AS c, round(avg(v), 6) AS v FROM rast GROUP BY ALL")
def resample_average(spark, d):
    return grid.coarsen(tables.raster(spark, d), "v", 2).select("r", "c", _rounded("v", 6).alias("v"))


@query(
    f"""WITH {CELLS}, {RAST}, pts AS (SELECT id, (y % 19000) / 500.0 AS py, (x % 19000) / 500.0 AS px FROM ({OCC[8:-1]})),
k(a, b) AS (VALUES (0, 0), (0, 1), (1, 0), (1, 1)),
e AS (SELECT id, floor(py) + a AS r, floor(px) + b AS c, (CASE a WHEN 1 THEN py - floor(py) ELSE 1 - (py - floor(py)) END) * (CASE b WHEN 1 THEN px - floor(px) ELSE 1 - (px - floor(px)) END) AS w FROM pts, k)
SELECT pts.id, round(sum(v * w) / sum(w), 3) AS v FROM pts LEFT JOIN (SELECT id, v, w FROM e JOIN rast USING (r, c) WHERE w > 0 AND v IS NOT NULL) USING (id) GROUP BY pts.id"""
)
def resample_bilinear(spark, d):
    points = tables.occurrences(spark, d).select("id", ((F.col("y") % 19000) / 500.0).alias("py"), ((F.col("x") % 19000) / 500.0).alias("px"))
    return grid.bilinear(tables.raster(spark, d), "v", points, F.col("py"), F.col("px")).select("id", _rounded("v", 3).alias("v"))


@query(f"WITH {CELLS}, {RAST}, {OCC} SELECT id, v FROM (SELECT id, y // 500 AS r, x // 500 AS c FROM occ) LEFT JOIN rast USING (r, c)")
def sample_nearest(spark, d):
    points = tables.occurrences(spark, d).select("id", F.floor(F.col("y") / 500).cast("long").alias("r"), F.floor(F.col("x") / 500).cast("long").alias("c"))
    return points.join(tables.raster(spark, d), ["r", "c"], "left").select("id", "v")


@query(f"WITH {CELLS}, {OCC}, h AS (SELECT DISTINCT y // 500 AS r, x // 500 AS c FROM occ WHERE status = 'P' AND x % 500 <> 0 AND y % 500 <> 0) SELECT cells.r, cells.c, (h.r IS NOT NULL)::INT AS presence FROM cells LEFT JOIN h USING (r, c)")
def mark_presence(spark, d):
    return grid.presence(tables.cells(spark, d), tables.occurrences(spark, d).where("status = 'P'"), 500).select("r", "c", "presence")


@query(f"WITH {CELLS}, {OCC}, o AS (SELECT id, y // 500 AS r, x // 500 AS c FROM occ WHERE x % 500 <> 0 AND y % 500 <> 0) SELECT r, c, count(*) AS points, min(id) AS first_id FROM cells JOIN o USING (r, c) GROUP BY ALL")
def points_in_cells(spark, d):
    inside = grid.cells_with_points(tables.occurrences(spark, d), 500)
    return tables.cells(spark, d).select("r", "c").join(inside, ["r", "c"]).groupBy("r", "c").agg(F.count(F.lit(1)).alias("points"), F.min("id").alias("first_id"))


@query(f"WITH {CELLS}, s AS (SELECT r, c FROM cells WHERE (r * 7 + c) % 53 = 0) SELECT DISTINCT cells.r, cells.c FROM cells JOIN s ON (cells.r - s.r) * (cells.r - s.r) + (cells.c - s.c) * (cells.c - s.c) <= 4")
def halo_neighbourhood(spark, d):
    g = tables.cells(spark, d)
    return grid.neighbourhood(g, g.where((F.col("r") * 7 + F.col("c")) % 53 == 0), 2).select("r", "c")


@query(f"WITH {CELLS}, z AS (SELECT min(r) AS r0, min(c) AS c0, max(r) AS r1 FROM cells) SELECT r, c, ((c - c0) // 8) * ((r1 - r0) // 8 + 1) + (r - r0) // 8 AS block FROM cells, z")
def spatial_blocks(spark, d):
    return grid.blocks(tables.cells(spark, d), F.col("c"), F.col("r"), 8).select("r", "c", "block")


_ZONE = f"""m AS (SELECT r, c, p FROM cells WHERE p >= (SELECT quantile_cont(p, 0.8) FROM cells)),
g AS (SELECT r * {SIDE} + c AS a, r * {SIDE} + c AS b FROM m UNION
      SELECT g.a, y.r * {SIDE} + y.c FROM g JOIN m y ON abs(g.b // {SIDE} - y.r) <= 1 AND abs(g.b % {SIDE} - y.c) <= 1),
l AS (SELECT a // {SIDE} AS r, a % {SIDE} AS c, min(b) AS zone FROM g GROUP BY a)"""


def _marked(spark, d):
    g = tables.cells(spark, d)
    return g.where(F.col("p") >= numeric.quantiles(g, F.col("p"), [0.8])[0])


@query(f"WITH RECURSIVE {CELLS}, {_ZONE} SELECT r, c, zone FROM l")
def connected_zones(spark, d):
    return components.label_zones(_marked(spark, d), SIDE).select("r", "c", "zone")


@query(f"WITH RECURSIVE {CELLS}, {_ZONE} SELECT zone, count(*) AS cells, round(sum(p), 4) AS strength FROM l JOIN m USING (r, c) GROUP BY zone HAVING count(*) >= 4 ORDER BY round(sum(p), 6) DESC, zone DESC LIMIT 30")
def strongest_zones(spark, d):
    return components.strongest_zones(_marked(spark, d), "p", SIDE, 4, 30).select("zone", "cells", _rounded("strength", 4).alias("strength"))


# geometry

_LEN = "((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1))::DOUBLE"
_CENTRES = "pts AS (SELECT r, c, c * 500 + 250 AS x, r * 500 + 250 AS y FROM cells)"


def _centres(spark, d):
    return tables.cells(spark, d).select("r", "c", (F.col("c") * 500 + 250).alias("x"), (F.col("r") * 500 + 250).alias("y"))


@query(
    f"""WITH {CELLS}, {SEGS}, {_CENTRES}, e AS (SELECT r, c, x, y, x1, y1, x2, y2, greatest(0, least(1, ((x - x1) * (x2 - x1) + (y - y1) * (y2 - y1)) / {_LEN})) AS t FROM pts, segs)
SELECT r, c, round(min(sqrt((x - (x1 + t * (x2 - x1))) ** 2 + (y - (y1 + t * (y2 - y1))) ** 2)), 4) AS distance FROM e GROUP BY r, c"""
)
def distance_to_lines(spark, d):
    out = geometry.nearest_distance(_centres(spark, d), tables.segments(spark, d), 1000.0, ["r", "c"])
    return out.select("r", "c", _rounded("distance", 4).alias("distance"))


@query(
    f"""WITH {CELLS}, {SEGS}, {_CENTRES}, e AS (SELECT r, c, {_LEN} AS a, 2.0 * ((x1 - x) * (x2 - x1) + (y1 - y) * (y2 - y1)) AS b, ((x1 - x) ** 2 + (y1 - y) ** 2 - 1500.0 * 1500.0) AS k FROM pts, segs),
g AS (SELECT r, c, a, b * b - 4 * a * k AS dd, b FROM e),
h AS (SELECT r, c, CASE WHEN dd > 0 THEN greatest(0, least(1, (-b + sqrt(dd)) / (2 * a)) - greatest(0, (-b - sqrt(dd)) / (2 * a))) * sqrt(a) ELSE 0 END AS len FROM g)
SELECT r, c, round(sum(len), 3) AS density FROM h GROUP BY r, c"""
)
def line_density(spark, d):
    out = geometry.line_density(_centres(spark, d), tables.segments(spark, d), 1500.0, ["r", "c"])
    return out.select("r", "c", _rounded("density", 3).alias("density"))


@query(
    f"""WITH {SEGS}, p AS (SELECT a.geom_id AS a_id, b.geom_id AS b_id, a.x1::DOUBLE AS ax1, a.y1::DOUBLE AS ay1, a.x2::DOUBLE AS ax2, a.y2::DOUBLE AS ay2, b.x1::DOUBLE AS bx1, b.y1::DOUBLE AS by1, b.x2::DOUBLE AS bx2, b.y2::DOUBLE AS by2
  FROM segs a, segs b WHERE a.geom_id % 2 = 0 AND b.geom_id % 2 = 1),
q AS (SELECT *, (ax2 - ax1) * (by2 - by1) - (ay2 - ay1) * (bx2 - bx1) AS d FROM p),
s AS (SELECT *, ((bx1 - ax1) * (by2 - by1) - (by1 - ay1) * (bx2 - bx1)) / d AS t, ((bx1 - ax1) * (ay2 - ay1) - (by1 - ay1) * (ax2 - ax1)) / d AS u FROM q WHERE d <> 0)
SELECT a_id, b_id, round(ax1 + t * (ax2 - ax1), 4) AS x, round(ay1 + t * (ay2 - ay1), 4) AS y FROM s WHERE t BETWEEN 0 AND 1 AND u BETWEEN 0 AND 1"""
)
def line_crossings(spark, d):
    s = tables.segments(spark, d)
    out = geometry.crossings(s.where("geom_id % 2 = 0"), s.where("geom_id % 2 = 1"), 2000.0)
    return out.select("a_id", "b_id", _rounded("x", 4).alias("x"), _rounded("y", 4).alias("y"))


@query(f"WITH {OCC}, {BOXES} SELECT geom_id, count(*) AS points, round(sum(price), 2) AS price FROM occ JOIN boxes ON x BETWEEN x0 AND boxes.x1 AND y BETWEEN y0 AND boxes.y1 GROUP BY geom_id")
def points_in_boxes(spark, d):
    out = geometry.points_in_boxes(tables.occurrences(spark, d), tables.boxes(spark, d), 2000.0)
    return out.groupBy("geom_id").agg(F.count(F.lit(1)).alias("points"), F.round(F.sum("price"), 2).alias("price"))


@query(
    f"""WITH {OCC}, {SEGS}, e AS (SELECT id, price, geom_id, (x - x1) ** 2 + (y - y1) ** 2 AS d2 FROM occ, segs WHERE status = 'P')
SELECT o.id, first_value AS site FROM (SELECT id FROM occ WHERE status = 'P') o LEFT JOIN (SELECT id, arg_min(geom_id, (d2, geom_id)) AS first_value FROM e WHERE d2 <= 640000 GROUP BY id) USING (id)"""
)
def nearest_site_within(spark, d):
    points = tables.occurrences(spark, d).where("status = 'P'").select("id", "x", "y")
    sites = tables.segments(spark, d).select(F.col("geom_id").alias("id"), F.col("x1").alias("x"), F.col("y1").alias("y"), F.col("geom_id").alias("site"))
    return geometry.nearest_within(points, sites, 800.0, "id", "site").select("id", "site")


# sampling and evaluation


@query(f"WITH {FEATS} SELECT cell_id, presence FROM feats WHERE presence = 1 UNION ALL (SELECT cell_id, presence FROM feats WHERE presence = 0 ORDER BY md5('42:' || cell_id), cell_id LIMIT 100)")
def presence_background(spark, d):
    return sampling.presence_background(tables.samples(spark, d).select("cell_id", "presence"), "cell_id", 100, 42)


@query(f"WITH {FEATS}, b AS (SELECT DISTINCT block FROM feats) SELECT block, ((row_number() OVER (ORDER BY md5('7:' || block), block) - 1) % 5)::INT AS fold FROM b")
def shuffled_folds(spark, d):
    return sampling.folds(tables.samples(spark, d), 5, 7)


def _criterial_sql(where: str) -> str:
    stats = ", ".join(f"avg(f{i}) AS m{i}, stddev_pop(f{i}) AS s{i}, avg(f{i} * presence) - avg(f{i}) * avg(presence) AS x{i}" for i in range(13))
    total = " + ".join(f"CASE WHEN abs(x{i}) < 1e-12 THEN 0 WHEN x{i} > 0 THEN 1 ELSE -1 END * (f{i} - m{i}) / (s{i} + 1e-9)" for i in range(13))
    return f"st AS (SELECT {stats} FROM feats WHERE {where}), scored AS (SELECT cell_id, presence, block, ({total}) / 13 AS score FROM feats, st)"


def _scored(spark, d):
    g = tables.samples(spark, d)
    return g.withColumn("score", metrics.criterial(g.where("block % 5 <> 0"), [f"f{i}" for i in range(13)]))


@query(f"WITH {FEATS}, {_criterial_sql('block % 5 <> 0')} SELECT cell_id, round(score, 6) AS score FROM scored")
def criterial_score(spark, d):
    return _scored(spark, d).select("cell_id", _rounded("score").alias("score"))


def _area(df):
    return df.select("area", "cells", "hits", _rounded("coverage").alias("coverage"), _rounded("lift").alias("lift"))


def _area_query(where: str) -> str:
    limits = " UNION ALL ".join(f"SELECT {a}::DOUBLE AS area, quantile_cont(score, {1.0 - a!r}) AS t FROM scored WHERE {where}" for a in AREAS)
    hits, of = "count(*) FILTER (score >= t AND presence = 1)", "(count(*) FILTER (presence = 1))::DOUBLE"
    return f"th AS ({limits}) SELECT area, count(*) FILTER (score >= t) AS cells, {hits} AS hits, round({hits} / {of}, 6) AS coverage, round({hits} / {of} / area, 6) AS lift FROM scored, th GROUP BY area"


@query(f"WITH {FEATS}, {_criterial_sql('block % 5 <> 0')}, {_area_query('true')}")
def top_area_coverage(spark, d):
    return _area(metrics.top_area(_scored(spark, d), AREAS))


@query(f"WITH {FEATS}, {_criterial_sql('block % 5 <> 0')}, {_area_query('presence = 0')}")
def top_area_lift_over_background(spark, d):
    return _area(metrics.top_area(_scored(spark, d), AREAS, background_only=True))


@query(
    f"""WITH {FEATS}, {_criterial_sql('block % 5 <> 0')},
r AS (SELECT presence, score, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0 AS rk FROM scored),
n AS (SELECT sum(presence)::DOUBLE AS p, sum(1 - presence)::DOUBLE AS q FROM scored),
a AS (SELECT score, sum(presence) AS pos, sum(sum(presence)) OVER (ORDER BY score DESC) AS tp, sum(count(*)) OVER (ORDER BY score DESC) AS k FROM scored GROUP BY score)
SELECT round(((SELECT sum(rk) FROM r WHERE presence = 1) - p * (p + 1) / 2)::DOUBLE / (p * q), 6) AS auc, round((SELECT sum(pos * tp::DOUBLE / k) FROM a) / p, 6) AS average_precision,
  round((SELECT avg(score) FROM scored WHERE presence = 1), 6) AS mean_positive, round((SELECT avg(score) FROM scored WHERE presence = 0), 6) AS mean_negative FROM n"""
)
def binary_metrics(spark, d):
    out = metrics.binary_metrics(_scored(spark, d))
    return out.select(*[_rounded(c).alias(c) for c in out.columns])


def _folded(spark, d):
    """Lift of the criterial score on each held-out fold, fitted on the other folds."""
    g, columns = tables.samples(spark, d), [f"f{i}" for i in range(13)]
    out = None
    for k in range(5):
        test = g.where(F.col("block") % 5 == k).withColumn("score", metrics.criterial(g.where(F.col("block") % 5 != k), columns))
        one = metrics.top_area(test, [0.1, 0.2]).withColumn("fold", F.lit(k))
        out = one if out is None else out.unionByName(one)
    return out


def _folded_sql() -> str:
    parts, folds = [], []
    for k in range(5):
        parts.append(_criterial_sql(f"block % 5 <> {k}").replace("st AS", f"st{k} AS").replace("scored AS", f"sc{k} AS").replace("FROM feats, st)", f"FROM feats, st{k} WHERE block % 5 = {k})"))
        for a in (0.1, 0.2):
            folds.append(f"SELECT {k} AS fold, {a}::DOUBLE AS area, count(*) FILTER (score >= t AND presence = 1) / (count(*) FILTER (presence = 1))::DOUBLE AS coverage FROM sc{k}, (SELECT quantile_cont(score, {1.0 - a!r}) AS t FROM sc{k})")
    return ", ".join(parts) + ", cv AS (" + " UNION ALL ".join(folds) + ")"


@query(f"WITH {FEATS}, {_folded_sql()} SELECT fold, area, round(coverage, 6) AS coverage, round(coverage / area, 6) AS lift FROM cv")
def spatial_cross_validation(spark, d):
    return _folded(spark, d).select("fold", "area", _rounded("coverage").alias("coverage"), _rounded("lift").alias("lift"))


@query(f"WITH {FEATS}, {_folded_sql()} SELECT area, round(avg(coverage), 6) AS coverage, round(avg(coverage / area), 6) AS lift_mean, round(stddev_samp(coverage / area), 6) AS lift_std FROM cv GROUP BY area")
def cross_validation_summary(spark, d):
    return _folded(spark, d).groupBy("area").agg(_rounded(F.avg("coverage")).alias("coverage"), _rounded(F.avg("lift")).alias("lift_mean"), _rounded(F.stddev_samp("lift")).alias("lift_std"))


@query(f"WITH {FEATS}, {_folded_sql()} SELECT fold, round(max(coverage / area) FILTER (area = 0.1), 6) AS lift_10, round(max(coverage / area) FILTER (area = 0.2), 6) AS lift_20 FROM cv GROUP BY fold")
def cross_validation_pivot(spark, d):
    out = _folded(spark, d).groupBy("fold").pivot("area", [0.1, 0.2]).agg(_rounded(F.max("lift")))
    return out.withColumnsRenamed({"0.1": "lift_10", "0.2": "lift_20"})


@query(
    f"""WITH {CELLS}, pr AS (SELECT row_number() OVER (ORDER BY r) - 1 AS pos, v FROM (SELECT r, round(avg(q - 25), 6) AS v FROM cells GROUP BY r)), n AS (SELECT count(*) AS n FROM pr),
dr AS (SELECT b, {HASH.format("'5:' || b || ':' || j")} % (SELECT n FROM n) AS pos FROM range(500) AS x(b), (SELECT unnest(range((SELECT n FROM n))) AS j)),
m AS (SELECT b, avg(v) AS mean FROM dr JOIN pr USING (pos) GROUP BY b)
SELECT round(quantile_cont(mean, 0.025), 6) AS low, round(quantile_cont(mean, 0.975), 6) AS high, (SELECT round(avg(v), 6) FROM pr) AS mean FROM m"""
)
def bootstrap_interval(spark, d):
    pairs = tables.cells(spark, d).groupBy("r").agg(F.round(F.avg(F.col("q") - 25), 6).alias("v"))
    drawn = sampling.bootstrap_means(pairs, "r", "v", 500, 5)
    ends = drawn.agg(F.percentile("mean", 0.025).alias("low"), F.percentile("mean", 0.975).alias("high"))
    return ends.select(_rounded("low").alias("low"), _rounded("high").alias("high")).crossJoin(F.broadcast(pairs.agg(_rounded(F.avg("v")).alias("mean"))))


DRAWS = 20


def _permutation_sql() -> str:
    columns = [f"f{i}" for i in range(13)]
    stats = ", ".join(f"avg({c}) AS m{c}, stddev_pop({c}) AS s{c}, avg({c} * presence) - avg({c}) * avg(presence) AS x{c}" for c in columns)
    total = " + ".join(f"CASE WHEN abs(x{c}) < 1e-12 THEN 0 WHEN x{c} > 0 THEN 1 ELSE -1 END * ({c} - m{c}) / (s{c} + 1e-9)" for c in columns)
    return f"""n AS (SELECT sum(presence) AS k FROM feats), dr AS (SELECT b AS seed, cell_id, row_number() OVER (PARTITION BY b ORDER BY {HASH.format("'9:' || b || ':' || cell_id")}, cell_id) AS nth FROM feats, range(0, {DRAWS + 1}) AS x(b)),
ce AS (SELECT seed, cell_id, block % 5 AS fold, {", ".join(columns)}, CASE WHEN seed = 0 THEN presence ELSE (nth <= (SELECT k FROM n))::INT END AS presence FROM feats JOIN dr USING (cell_id)),
st AS (SELECT seed, k AS fold, {stats} FROM ce, range(5) AS x(k) WHERE fold <> k GROUP BY seed, k),
sc AS (SELECT presence, seed, fold, ({total}) / 13 AS score FROM ce JOIN st USING (seed, fold)),
th AS (SELECT seed, fold, quantile_cont(score, 0.9) AS t FROM sc GROUP BY seed, fold),
lf AS (SELECT seed, avg(lift) AS lift FROM (SELECT seed, fold, count(*) FILTER (score >= t) / count(*)::DOUBLE / 0.1 AS lift FROM sc JOIN th USING (seed, fold) WHERE presence = 1 GROUP BY seed, fold) GROUP BY seed)"""


@query(
    f"""WITH {FEATS}, {_permutation_sql()}, o AS (SELECT lift FROM lf WHERE seed = 0)
SELECT round(any_value(o.lift), 6) AS observed, round(avg(lf.lift), 6) AS null_mean, round(quantile_cont(lf.lift, 0.95), 6) AS null_95, round(avg((lf.lift >= o.lift - 1e-12)::INT), 6) AS p_value FROM lf, o WHERE seed > 0"""
)
def permutation_null(spark, d):
    """Lift over held-out folds against that of random presence, learnt again for each draw and fold."""
    g = tables.samples(spark, d).withColumn("fold", (F.col("block") % 5).cast("int"))
    out = validation.permutation_test(g, "cell_id", [f"f{i}" for i in range(13)], 5, 0.1, DRAWS, 9)
    return out.select(*[_rounded(c).alias(c) for c in out.columns])


@query("SELECT p_partkey, p_name FROM part WHERE lower(concat_ws(';', coalesce(p_name, ''), coalesce(p_type, ''))) LIKE '%ring%'")
def commodity_filter(spark, d):
    return tables.table(spark, d, "part").where(points.mentions(["p_name", "p_type"], "ring")).select("p_partkey", "p_name")


@query(f"WITH {CELLS}, {RAST} SELECT 'v' AS layer, min(v) AS lo, max(v) AS hi, round(avg((v IS NULL)::INT), 6) AS missing FROM rast")
def layer_report(spark, d):
    return tables.raster(spark, d).agg(F.min("v").alias("lo"), F.max("v").alias("hi"), _rounded(F.avg(F.col("v").isNull().cast("int"))).alias("missing")).withColumn("layer", F.lit("v"))


# models: Spark ML's fits are beyond SQL; tests/test_models.py holds them against planted labels


def _modelled(estimator):
    def run(spark, d):
        g, columns = tables.samples(spark, d), [f"f{i}" for i in range(13)]
        train, test = g.where("block % 5 <> 0"), g.where("block % 5 = 0")
        return models.fit_score(estimator(columns), train, test).select("cell_id", "presence", "score")

    return run


for _name, _estimator in {
    "forest_scores": models.forest,
    "boosted_scores": models.boosted,
    "logistic_scores": models.logistic,
    "maxent_scores": lambda c: models.logistic(c, degree=2, penalty=0.1),
}.items():
    QUERIES[_name] = _modelled(_estimator)


@query()
def ensemble_scores(spark, d):
    return models.ensemble(tables.samples(spark, d), "cell_id", [f"f{i}" for i in range(13)])


@query()
def reliable_negative_scores(spark, d):
    g, columns = tables.samples(spark, d), [f"f{i}" for i in range(13)]
    first = models.fit_score(models.logistic(columns), g, g, "first")
    return models.fit_score(models.forest(columns), models.reliable_negatives(first, "first"), g).select("cell_id", "score")
