"""Registered queries of masks, points under a score, zones, sample gates, standardisation and joined layers, and their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridlode.functions import numeric
from gridlode.operators import components, geometry, grid, metrics, validation
from gridlode.queries import _CENTRES, _LEN, _ZONE, CELLS, FEATS, OCC, RAST, SEGS, SIDE, _centres, _marked, _rounded, query
from gridlode.queries_validation import COLUMNS, _cv_sql, _scored
from gridlode.sources import shapes, tables

_TOP = "tp AS (SELECT quantile_cont(v, 0.85) AS t_ FROM rast)"


@query(f"WITH {CELLS}, {RAST}, {_TOP} SELECT r, c, coalesce(v >= t_, false) AS gold FROM rast, tp")
def gold_mask(spark, d):
    """Cells whose score is among the top share; those without a score never are."""
    g = tables.raster(spark, d)
    return g.select("r", "c", metrics.top_mask(g, "v", 0.15).alias("gold"))


_POINTS = "po AS (SELECT id, y // 500 AS r, x // 500 AS c FROM occ), ht AS (SELECT id, v, coalesce(v >= t_, false) AS hit FROM po CROSS JOIN tp LEFT JOIN rast USING (r, c))"


def _points(spark, d):
    return tables.occurrences(spark, d).select("id", F.floor(F.col("y") / 500).cast("long").alias("r"), F.floor(F.col("x") / 500).cast("long").alias("c"))


@query(f"WITH {CELLS}, {RAST}, {OCC}, {_TOP}, {_POINTS} SELECT * FROM ht")
def scores_at_points(spark, d):
    """All points with the score of their cell and whether it is among the top share."""
    return metrics.scores_at(_points(spark, d), tables.raster(spark, d), ["r", "c"], "v", 0.15).select("id", "v", "hit")


@query(f"WITH {CELLS}, {RAST}, {OCC}, {_TOP}, {_POINTS} SELECT count(*) AS points, count(*) FILTER (hit) AS hits, round(avg(hit::INT), 6) AS coverage FROM ht")
def point_coverage(spark, d):
    out = metrics.point_coverage(_points(spark, d), tables.raster(spark, d), ["r", "c"], "v")
    return out.select("points", "hits", _rounded("coverage").alias("coverage"))


@query(f"WITH {CELLS}, {RAST} SELECT r, c, coalesce(least(floor(v / 60000 * 20), 19), 0)::INT AS class FROM rast")
def classes_with_gaps(spark, d):
    """Display classes; cells without a score are class 0."""
    return tables.raster(spark, d).select("r", "c", numeric.classes(F.col("v") / 60000).alias("class"))


@query(f"WITH RECURSIVE {CELLS}, {_ZONE}, k AS (SELECT zone, count(*) AS cells FROM l GROUP BY zone HAVING count(*) >= 6) SELECT r, c, zone, cells FROM l JOIN k USING (zone)")
def large_zones(spark, d):
    return components.keep_large(_marked(spark, d).select("r", "c"), SIDE, 6)


@query(f"WITH RECURSIVE {CELLS}, {_ZONE} SELECT count(DISTINCT zone) AS zones, count(*) AS cells FROM l")
def zone_count(spark, d):
    return components.zone_count(_marked(spark, d), SIDE)


@query("SELECT o_orderkey AS id FROM orders JOIN (SELECT o_custkey, count(*) AS n, sum((o_orderstatus = 'P')::INT) AS p FROM orders GROUP BY o_custkey HAVING n >= 12 AND p >= 5) USING (o_custkey)")
def groups_with_enough(spark, d):
    """Rows of the groups with enough rows and enough presence."""
    o = tables.table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), "o_custkey", (F.col("o_orderstatus") == "P").cast("int").alias("presence"))
    return metrics.with_enough(o, ["o_custkey"], 12, 5).select("id")


@query(f"WITH {FEATS} SELECT cell_id, " + ", ".join(f"round((f{i} - avg(f{i}) OVER ()) / stddev_pop(f{i}) OVER (), 6) AS f{i}" for i in range(3)) + " FROM feats")
def standardised_features(spark, d):
    g = tables.samples(spark, d)
    scaled = numeric.standardised(g, ["f0", "f1", "f2"])
    return g.select("cell_id", *[_rounded(v).alias(k) for k, v in scaled.items()])


@query(f"WITH {FEATS}, {_cv_sql(COLUMNS, [0.1])} SELECT cell_id, round(avg(score), 6) AS score FROM sc GROUP BY cell_id")
def seed_averaged_scores(spark, d):
    """Mean over the seeds of each cell's held-out score."""
    return validation.seed_average(_scored(spark, d), "cell_id").select("cell_id", _rounded("score").alias("score"))


@query(
    f"""WITH {CELLS}, {SEGS}, {_CENTRES}, e AS (SELECT r, c, x, y, x1, y1, x2, y2, greatest(0, least(1, ((x - x1) * (x2 - x1) + (y - y1) * (y2 - y1)) / {_LEN})) AS t FROM pts, segs WHERE geom_id % 5 IN (3, 4))
SELECT r, c, round(min(sqrt((x - (x1 + t * (x2 - x1))) ** 2 + (y - (y1 + t * (y2 - y1))) ** 2)), 4) AS distance FROM e GROUP BY r, c"""
)
def distance_to_joined_layers(spark, d):
    """Distance to two layers of lines taken as one."""
    lines = tables.segments(spark, d).withColumn("layer", F.element_at(F.array(*[F.lit(k) for k in ("paleo", "struct", "magm", "tect1", "tect2")]), (F.col("geom_id") % 5 + 1).cast("int")))
    both = shapes.joined(lines, ["tect1", "tect2"], "tect").where("layer = 'tect'")
    return geometry.nearest_distance(_centres(spark, d), both, 1000.0, ["r", "c"]).select("r", "c", _rounded("distance", 4).alias("distance"))


_COARSE = ["q", "p", "d", "t", "mp", "n"]


@query(
    f"""WITH {CELLS}, z AS (SELECT min(r) AS r0, min(c) AS c0, max(r) AS r1 FROM cells)
SELECT ((c - c0) // 4) * ((r1 - r0) // 4 + 1) + (r - r0) // 4 AS block, {', '.join(f'round(avg({c}), 8) AS {c}' for c in _COARSE)}, max((mq >= 50)::INT) AS presence, round(avg(c * 500 + 250), 8) AS x, round(avg(r * 500 + 250), 8) AS y FROM cells, z GROUP BY 1"""
)
def coarse_support(spark, d):
    """Means of all features, presence and place of each block."""
    g = grid.blocks(tables.cells(spark, d), F.col("c"), F.col("r"), 4).withColumn("presence", (F.col("mq") >= 50).cast("int"))
    out = grid.coarse_support(g, _COARSE, "presence", F.col("c") * 500 + 250, F.col("r") * 500 + 250)
    return out.select("block", *[_rounded(c, 8).alias(c) for c in _COARSE], "presence", _rounded("x", 8).alias("x"), _rounded("y", 8).alias("y"))
