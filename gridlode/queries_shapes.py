"""Registered queries on polygons, cells as squares, resampling and zones, and their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridlode.operators import features, geometry, grid, points, terrain
from gridlode.queries import _CENTRES, _INTERACTIONS, BOXES, CELLS, DISTANCES, OCC, RAST, SEGS, SIDE, _centres, _robust_sql, _rounded, _scaled, _smooth_sql, query
from gridlode.sources import tables


def _hypot(a: str, b: str) -> str:
    return f"sqrt(({a}) ** 2 + ({b}) ** 2)"


def _point_segment_sql(x: str, y: str) -> str:
    t = f"greatest(0, least(1, (({x} - x1) * (x2 - x1) + ({y} - y1) * (y2 - y1)) / ((x2 - x1) ** 2 + (y2 - y1) ** 2)))"
    return _hypot(f"{x} - x1 - {t} * (x2 - x1)", f"{y} - y1 - {t} * (y2 - y1)")


def _slab_sql(at: str, start: str, end: str, half: float) -> tuple[str, str]:
    a, b = f"({at} - {half} - {start}) / nullif({end} - {start}, 0)", f"({at} + {half} - {start}) / nullif({end} - {start}, 0)"
    flat = f"CASE WHEN {end} <> {start} THEN {{}} WHEN abs({start} - {at}) <= {half} THEN {{}} ELSE {{}} END"
    return flat.format(f"least({a}, {b})", "0.0", "2.0"), flat.format(f"greatest({a}, {b})", "1.0", "-1.0")


def _touch_sql(half: float) -> str:
    (lx, hx), (ly, hy) = _slab_sql("x", "x1", "x2", half), _slab_sql("y", "y1", "y2", half)
    return f"greatest(0.0, {lx}, {ly}) <= least(1.0, {hx}, {hy})"


def _box_distance_sql(x: str, y: str) -> str:
    return _hypot(f"greatest(x0 - {x}, 0, {x} - x1)", f"greatest(y0 - {y}, 0, {y} - y1)")


def _beyond(at: str, p: str) -> str:
    return f"greatest(abs({p} - {at}) - 250, 0)"


_CELL_DISTANCE = f"CASE WHEN {_touch_sql(250.0)} THEN 0 ELSE least({', '.join([_hypot(_beyond('x', f'x{k}'), _beyond('y', f'y{k}')) for k in (1, 2)] + [_point_segment_sql(f'(x + {i})', f'(y + {j})') for i in (-250, 250) for j in (-250, 250)])}) END"


@query(
    f"""WITH {BOXES}, e AS (SELECT min(x0) AS lx, min(y0) AS ly, max(x1) AS hx, max(y1) AS hy FROM boxes),
g AS (SELECT r, c, lx + c * 500 AS a, ly + r * 500 AS b FROM e, (SELECT unnest(range(ceil((hy - ly) / 500.0)::BIGINT)) AS r FROM e), (SELECT unnest(range(ceil((hx - lx) / 500.0)::BIGINT)) AS c FROM e))
SELECT row_number() OVER (ORDER BY r, c) - 1 AS cell_id, r, c, a + 250.0::DOUBLE AS x, b + 250.0::DOUBLE AS y
FROM g WHERE EXISTS (SELECT 1 FROM boxes WHERE a <= boxes.x1 AND a + 500 >= boxes.x0 AND b <= boxes.y1 AND b + 500 >= boxes.y0)"""
)
def build_grid(spark, d):
    return geometry.build_grid(geometry.box_edges(tables.boxes(spark, d)), 500.0)


@query(f"WITH {CELLS} SELECT r, c, 100.0::DOUBLE + (c + 0.5::DOUBLE) * 500 AS x, 20100.0::DOUBLE - (r + 0.5::DOUBLE) * 500 AS y FROM cells")
def cell_centres(spark, d):
    """Centres of a grid whose first row is its north."""
    return terrain.cell_centres(tables.cells(spark, d), 100.0, 100.0, 500.0, 500.0, SIDE).select("r", "c", "x", "y")


@query(f"WITH {CELLS}, {SEGS}, {_CENTRES} SELECT DISTINCT r, c FROM pts, segs WHERE {_touch_sql(250.0)}")
def cells_touched_by_lines(spark, d):
    return geometry.cells_touched(_centres(spark, d), tables.segments(spark, d), 250.0, ["r", "c"])


@query(f"WITH {CELLS}, {SEGS}, {_CENTRES} SELECT r, c, round(min({_CELL_DISTANCE}), 4) AS distance FROM pts, segs GROUP BY r, c")
def cell_distance_to_lines(spark, d):
    out = geometry.nearest_distance(_centres(spark, d), tables.segments(spark, d), 1000.0, ["r", "c"], half=250.0)
    return out.select("r", "c", _rounded("distance", 4).alias("distance"))


@query(f"WITH {CELLS}, {BOXES}, {_CENTRES} SELECT r, c, round(min({_box_distance_sql('x', 'y')}), 4) AS distance FROM pts, boxes GROUP BY r, c")
def distance_to_polygons(spark, d):
    out = geometry.distance_to_polygons(_centres(spark, d), geometry.box_edges(tables.boxes(spark, d)), 1000.0, ["r", "c"])
    return out.select("r", "c", _rounded("distance", 4).alias("distance"))


@query(f"WITH {CELLS}, {BOXES}, {_CENTRES} SELECT r, c, max((x BETWEEN x0 AND x1 AND y BETWEEN y0 AND y1)::INT) AS mask FROM pts, boxes GROUP BY r, c")
def mask_raster(spark, d):
    out = geometry.distance_to_polygons(_centres(spark, d), geometry.box_edges(tables.boxes(spark, d)), 1000.0, ["r", "c"])
    return out.select("r", "c", (F.col("distance") == 0).cast("int").alias("mask"))


def _sector(ax: str, ay: str, bx: str, by: str) -> str:
    return f"atan2({ax} * {by} - {ay} * {bx}, {ax} * {bx} + {ay} * {by}) * 1125000.0"


@query(
    f"""WITH {CELLS}, {BOXES}, {_CENTRES},
e AS (SELECT r, c, geom_id, unnest([x0, x1, x1, x0])::DOUBLE - x AS px, unnest([y0, y0, y1, y1])::DOUBLE - y AS py, unnest([x1, x1, x0, x0])::DOUBLE - x AS qx, unnest([y0, y1, y1, y0])::DOUBLE - y AS qy FROM pts, boxes),
k AS (SELECT *, (qx - px) ** 2 + (qy - py) ** 2 AS a, 2 * (px * (qx - px) + py * (qy - py)) AS b, px * px + py * py - 1500.0 * 1500.0 AS cc FROM e),
t AS (SELECT *, b * b - 4 * a * cc AS dd, greatest(0, least(1, (-b - sqrt(greatest(b * b - 4 * a * cc, 0))) / (2 * a))) AS lo, greatest(0, least(1, (-b + sqrt(greatest(b * b - 4 * a * cc, 0))) / (2 * a))) AS hi FROM k),
u AS (SELECT *, px + lo * (qx - px) AS ux, py + lo * (qy - py) AS uy, px + hi * (qx - px) AS vx, py + hi * (qy - py) AS vy FROM t),
s AS (SELECT r, c, geom_id, abs(sum(CASE WHEN dd > 0 AND hi > lo THEN {_sector("px", "py", "ux", "uy")} + (ux * vy - uy * vx) / 2 + {_sector("vx", "vy", "qx", "qy")} ELSE {_sector("px", "py", "qx", "qy")} END)) AS area FROM u GROUP BY ALL)
SELECT r, c, abs(round(sum(area), 2)) AS density FROM s GROUP BY r, c"""
)
def polygon_density(spark, d):
    out = geometry.density(_centres(spark, d), geometry.box_edges(tables.boxes(spark, d)), 1500.0, ["r", "c"], "area")
    return out.select("r", "c", F.abs(_rounded("density", 2)).alias("density"))


@query(
    f"""WITH {CELLS}, {SEGS}, {_CENTRES}, p AS (SELECT a.x1::DOUBLE AS ax, a.y1::DOUBLE AS ay, (a.x2 - a.x1)::DOUBLE AS ux, (a.y2 - a.y1)::DOUBLE AS uy, b.x1::DOUBLE AS bx, b.y1::DOUBLE AS by_, (b.x2 - b.x1)::DOUBLE AS vx, (b.y2 - b.y1)::DOUBLE AS vy
  FROM segs a, segs b WHERE a.geom_id % 2 = 0 AND b.geom_id % 2 = 1),
q AS (SELECT *, ((bx - ax) * vy - (by_ - ay) * vx) / nullif(ux * vy - uy * vx, 0) AS t, ((bx - ax) * uy - (by_ - ay) * ux) / nullif(ux * vy - uy * vx, 0) AS u FROM p),
n AS (SELECT ax + t * ux AS nx, ay + t * uy AS ny FROM q WHERE t BETWEEN 0 AND 1 AND u BETWEEN 0 AND 1)
SELECT r, c, round(coalesce((SELECT min({_hypot("x - nx", "y - ny")}) FROM n), 20000), 3) AS distance FROM pts"""
)
def line_node_distance(spark, d):
    s = tables.segments(spark, d)
    out = geometry.node_distance(_centres(spark, d), s.where("geom_id % 2 = 0"), s.where("geom_id % 2 = 1"), 2000.0, ["r", "c"], 20000.0)
    return out.select("r", "c", _rounded("distance", 3).alias("distance"))


_CORNERS = f"""pts AS (SELECT id, (y % 19000) / 500.0 AS py, (x % 19000) / 500.0 AS px FROM ({OCC[8:-1]})), k(a, b) AS (VALUES (0, 0), (0, 1), (1, 0), (1, 1)),
e AS (SELECT id, floor(py) + a AS r, floor(px) + b AS c, (CASE a WHEN 1 THEN py - floor(py) ELSE 1 - (py - floor(py)) END) * (CASE b WHEN 1 THEN px - floor(px) ELSE 1 - (px - floor(px)) END) AS w FROM pts, k)"""


@query(
    f"""WITH {CELLS}, {RAST}, {_CORNERS}, g AS (SELECT r, c, radians(v % 360 - 180) AS v FROM rast WHERE v IS NOT NULL)
SELECT pts.id, round(degrees(atan2(sum(sin(v) * w) / sum(w), sum(cos(v) * w) / sum(w))), 3) AS angle FROM pts LEFT JOIN (SELECT id, v, w FROM e JOIN g USING (r, c) WHERE w > 0) USING (id) GROUP BY pts.id"""
)
def resample_angle(spark, d):
    placed = tables.occurrences(spark, d).select("id", ((F.col("y") % 19000) / 500.0).alias("py"), ((F.col("x") % 19000) / 500.0).alias("px"))
    angles = tables.raster(spark, d).select("r", "c", (F.col("v") % 360 - 180).alias("angle"))
    return grid.bilinear_angle(angles, "angle", placed, F.col("py"), F.col("px")).select("id", _rounded("angle", 3).alias("angle"))


@query(
    f"""WITH {CELLS}, {RAST}, s AS (SELECT r * 500 - 50 AS b, c * 500 - 100 AS a, v FROM rast WHERE v IS NOT NULL),
o AS (SELECT i AS r, j AS c, v, greatest(0, least(b + 500, (i + 1) * 700) - greatest(b, i * 700)) * greatest(0, least(a + 500, (j + 1) * 700) - greatest(a, j * 700)) AS w FROM s, range(-1, 31) AS x(i), range(-1, 31) AS y(j))
SELECT r, c, round(sum(v * w) / sum(w), 8) AS v FROM o WHERE w > 0 GROUP BY r, c"""
)
def resample_area(spark, d):
    return grid.resample_area(tables.raster(spark, d), "v", 500.0, 700.0, 100.0, 50.0).select("r", "c", _rounded("v", 8).alias("v"))


@query(f"WITH {CELLS}, {RAST}, {OCC} SELECT id, v FROM (SELECT id, trunc((y - 600) / 500.0)::BIGINT AS r, trunc((x - 600) / 500.0)::BIGINT AS c FROM occ) LEFT JOIN rast USING (r, c)")
def sample_truncated(spark, d):
    """Raster values at points whose cell is truncated towards zero, so that places just before the edge fall into the first cell."""
    return points.sample(tables.occurrences(spark, d), tables.raster(spark, d), ["v"], 600, 600, 500, truncate=True).select("id", "v")


@query(f"WITH {CELLS}, {RAST} SELECT r, c, round(coalesce(v, (SELECT quantile_cont(v, 0.5) FROM rast)), 6) AS v FROM rast")
def median_fill(spark, d):
    filled, _ = terrain.with_samples(tables.cells(spark, d).select("r", "c"), tables.raster(spark, d), ["v"])
    return filled.select("r", "c", _rounded("v").alias("v"))


@query(f"WITH {CELLS} SELECT r, c, round(nullif(mq, 50) * 0.2, 6) AS v FROM cells")
def nodata_and_scale(spark, d):
    return tables.cells(spark, d).select("r", "c", _rounded(terrain.measured(F.col("mq"), [50.0], 0.2)).alias("v"))


@query(
    f"""WITH {OCC} SELECT id, (CASE WHEN lat < 0 THEN 'S' ELSE 'N' END) || lpad(abs(lat)::VARCHAR, 2, '0') || (CASE WHEN lon < 0 THEN 'W' ELSE 'E' END) || lpad(abs(lon)::VARCHAR, 3, '0') AS tile
FROM (SELECT id, floor(y / 200.0 - 50)::BIGINT AS lat, floor(x / 100.0 - 100)::BIGINT AS lon FROM occ)"""
)
def tile_names(spark, d):
    """Name of the one-degree tile of each point."""
    return tables.occurrences(spark, d).select("id", points.tile_name(F.col("x") / 100 - 100, F.col("y") / 200 - 50).alias("tile"))


@query(f"WITH {OCC} SELECT id, (floor((x / 100.0 - 100) / 5) * 1000 + floor((y / 200.0 - 50) / 5))::BIGINT AS block FROM occ")
def degree_blocks(spark, d):
    return tables.occurrences(spark, d).select("id", points.degree_block(F.col("x") / 100 - 100, F.col("y") / 200 - 50, 5).alias("block"))


@query(f"WITH {CELLS}, {OCC} SELECT id, coalesce(p >= 38000, false) AS hit FROM (SELECT id, y // 500 AS r, x // 500 AS c FROM occ) LEFT JOIN cells USING (r, c)")
def points_with_score(spark, d):
    """Points with whether their cell's score is high; points outside of the grid are no hits."""
    placed = tables.occurrences(spark, d).select("id", F.floor(F.col("y") / 500).alias("r"), F.floor(F.col("x") / 500).alias("c"))
    return placed.join(tables.cells(spark, d), ["r", "c"], "left").select("id", F.coalesce(F.col("p") >= 38000, F.lit(False)).alias("hit"))


@query(f"WITH {OCC}, u AS (SELECT 'open' AS layer, x, y FROM occ WHERE status = 'O' UNION ALL SELECT 'filled', x, y FROM occ WHERE status = 'F') SELECT layer, count(*) AS points, sum(x) AS x, sum(y) AS y FROM u GROUP BY layer")
def layer_union(spark, d):
    o = tables.occurrences(spark, d)
    one = o.where("status = 'O'").select(F.lit("open").alias("layer"), "x", "y")
    both = one.unionByName(o.where("status = 'F'").select(F.lit("filled").alias("layer"), "id", "x", "y"), allowMissingColumns=True)
    return both.groupBy("layer").agg(F.count(F.lit(1)).alias("points"), F.sum("x").alias("x"), F.sum("y").alias("y"))


@query(
    f"""WITH {CELLS}, z AS (SELECT min(r) AS r0, min(c) AS c0, max(r) AS r1 FROM cells)
SELECT ((c - c0) // 4) * ((r1 - r0) // 4 + 1) + (r - r0) // 4 AS block, round(avg(q), 8) AS q, round(avg(p), 8) AS p, max((mq >= 50)::INT) AS presence, round(avg(c * 500 + 250), 8) AS x, round(avg(r * 500 + 250), 8) AS y FROM cells, z GROUP BY 1"""
)
def coarse_blocks(spark, d):
    g = grid.blocks(tables.cells(spark, d), F.col("c"), F.col("r"), 4)
    mean = lambda e, n: F.round(F.avg(e), 8).alias(n)
    return g.groupBy("block").agg(mean("q", "q"), mean("p", "p"), F.max((F.col("mq") >= 50).cast("int")).alias("presence"), mean(F.col("c") * 500 + 250, "x"), mean(F.col("r") * 500 + 250, "y"))


@query(
    f"WITH {CELLS}, {_smooth_sql('cells', 'q / 50', 2)}, m AS (SELECT cells.r, cells.c, s2.v FROM cells JOIN s2 USING (r, c)), z AS {_robust_sql('v', 'm', 0.02, 0.98)} "
    f"SELECT r, c, round({_scaled('v', 'z')}, 5) AS prospectivity, round(1 - {_scaled('v', 'z')}, 5) AS prognoz FROM m, z"
)
def prospectivity(spark, d):
    g = tables.cells(spark, d).withColumn("score", F.col("q") / 50)
    return features.prospectivity(g, "score", SIDE, SIDE).select("r", "c", _rounded("prospectivity", 5).alias("prospectivity"), _rounded("prognoz", 5).alias("prognoz"))


@query(
    f"""WITH RECURSIVE {CELLS}, {_INTERACTIONS}, sw AS (SELECT i2.*, {_scaled('core', 'zc')} AS coin FROM i2, zc),
m AS (SELECT r, c, prox_struct * (0.5 + 0.5 * prox_magm + 0.5 * coin) AS w FROM sw WHERE prox_struct >= (SELECT quantile_cont(prox_struct, 0.85) FROM sw)),
g AS (SELECT r * {SIDE} + c AS a, r * {SIDE} + c AS b FROM m UNION SELECT g.a, y.r * {SIDE} + y.c FROM g JOIN m y ON abs(g.b // {SIDE} - y.r) <= 1 AND abs(g.b % {SIDE} - y.c) <= 1),
l AS (SELECT a // {SIDE} AS r, a % {SIDE} AS c, min(b) AS zone FROM g GROUP BY a),
t AS (SELECT zone, sum(w) AS total FROM l JOIN m USING (r, c) GROUP BY zone HAVING count(*) >= 4),
k AS (SELECT zone, (row_number() OVER (ORDER BY round(total, 6) DESC, zone DESC))::INT AS rank FROM t QUALIFY rank <= 30)
SELECT r, c, zone, rank FROM l JOIN k USING (zone)"""
)
def gold_zones(spark, d):
    g = features.interactions(features.proximities(tables.cells(spark, d), DISTANCES))
    return features.gold_zones(g, "prox_struct", "prox_magm", "coincidence_score", SIDE, 0.85)
