"""Registered queries of occurrence points, samples, reports and derived rasters, and their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridlode.operators import features, points, terrain
from gridlode.queries import CELLS, DISTANCES, FULL, HASH, LAST, OCC, RAST, ROWS, SIDE, _mirrored, _robust_sql, _rounded, _scaled, _smooth_sql, _taxonomy_sql, query
from gridlode.sources import tables

BOX = (4000.0, 3000.0, 11000.0, 9000.0)
SAMPLED = "smp AS (SELECT occ.*, v FROM occ LEFT JOIN rast ON rast.r = (y - 600) // 500 AND rast.c = (x - 600) // 500 AND x >= 600 AND y >= 600)"


def _sampled(spark, d):
    return points.sample(tables.occurrences(spark, d), tables.raster(spark, d), ["v"], 600, 600, 500)


@query(f"WITH {OCC} SELECT id FROM occ WHERE nullif(status, 'O') IS DISTINCT FROM 'F'")
def null_keeping_filter(spark, d):
    o = tables.occurrences(spark, d)
    return o.where(points.differs(F.nullif(F.col("status"), F.lit("O")), "F")).select("id")


@query(f"WITH {OCC} SELECT id, x, y FROM occ WHERE x BETWEEN 4000 AND 11000 AND y BETWEEN 3000 AND 9000 AND status IN ('O', 'P')")
def box_filter(spark, d):
    return tables.occurrences(spark, d).where(points.in_box(F.col("x"), F.col("y"), BOX) & F.col("status").isin("O", "P")).select("id", "x", "y")


@query(f"WITH {CELLS}, {RAST}, {OCC}, {SAMPLED} SELECT id, v FROM smp WHERE v IS NOT NULL ORDER BY id LIMIT 40")
def first_valid_rows(spark, d):
    """The first 40 points, by id, at which the raster is finite; the number is what is asked for."""
    return points.first_valid(_sampled(spark, d), ["v"], ["id"], 40).select("id", "v")


@query(f"WITH {CELLS}, {RAST}, {OCC}, {SAMPLED} SELECT id, v FROM smp")
def sample_floor(spark, d):
    return _sampled(spark, d).select("id", "v")


@query(f"WITH {CELLS}, {RAST}, {OCC} SELECT id, tile, v * (tile + 1) AS v FROM (SELECT id, id % 3 AS tile, y // 500 AS r, x // 500 AS c FROM occ) LEFT JOIN (SELECT r, c, v FROM rast) USING (r, c)")
def tiled_sample(spark, d):
    """Each point is sampled from the raster of its own tile."""
    raster = tables.raster(spark, d).withColumn("tile", F.explode(F.array(*[F.lit(k).cast("long") for k in range(3)])))
    o = tables.occurrences(spark, d).withColumn("tile", F.col("id") % 3)
    return points.sample(o, raster.withColumn("v", F.col("v") * (F.col("tile") + 1)), ["v"], 0, 0, 500, keys=("tile",)).select("id", "tile", "v")


#: Places of the occurrences in degrees, around 0, and the box of them.
LONLAT = "ll AS (SELECT id, x / 1000.0::DOUBLE - 8 AS lon, y / 2000.0::DOUBLE - 3 AS lat FROM occ)"
LLBOX = "bx AS (SELECT min(lon) AS a, min(lat) AS b, max(lon) AS c, max(lat) AS d FROM ll)"


def lonlat(spark, d):
    return tables.occurrences(spark, d).select("id", (F.col("x") / 1000 - 8).alias("lon"), (F.col("y") / 2000 - 3).alias("lat"))


def lonlat_box(spark, d):
    return tuple(lonlat(spark, d).agg(F.min("lon"), F.min("lat"), F.max("lon"), F.max("lat")).first())


@query(
    f"""WITH {OCC}, {LONLAT}, {LLBOX}, x AS (SELECT unnest(range(floor(a - 0.5)::BIGINT, floor(c + 0.5)::BIGINT + 1)) AS lon FROM bx), y AS (SELECT unnest(range(floor(b - 0.5)::BIGINT, floor(d + 0.5)::BIGINT + 1)) AS lat FROM bx)
SELECT lon, lat, (CASE WHEN lat < 0 THEN 'S' ELSE 'N' END) || lpad(abs(lat)::VARCHAR, 2, '0') || (CASE WHEN lon < 0 THEN 'W' ELSE 'E' END) || lpad(abs(lon)::VARCHAR, 3, '0') AS tile FROM x, y"""
)
def tiles_in_box(spark, d):
    """The tiles under the padded box of the occurrences."""
    return points.tiles_in(spark, lonlat_box(spark, d), 0.5)


@query(
    f"""WITH {OCC}, {LONLAT}, {LLBOX}, n AS (SELECT ceil((c - a) / 0.1)::BIGINT AS n FROM bx), i AS (SELECT unnest(range(n)) AS i FROM n), j AS (SELECT unnest(range(ceil((d - b) / 0.1)::BIGINT)) AS j FROM bx)
SELECT j * n + i AS id, round(a + (i + 0.5::DOUBLE) * 0.1, 6) AS x, round(b + (j + 0.5::DOUBLE) * 0.1, 6) AS y FROM i, j, n, bx"""
)
def lonlat_mesh(spark, d):
    """The mesh over the box of the occurrences."""
    return points.mesh(spark, lonlat_box(spark, d), 0.1).select("id", _rounded("x").alias("x"), _rounded("y").alias("y"))


@query(f"WITH {CELLS}, {RAST}, w AS (SELECT q, p, v FROM cells JOIN rast USING (r, c)), e AS (SELECT 'q' AS layer, q AS v FROM w UNION ALL SELECT 'p', p FROM w UNION ALL SELECT 'v', v FROM w) SELECT layer, min(v) AS least, max(v) AS most, round(avg((v IS NULL)::INT), 6) AS missing FROM e GROUP BY layer")
def layers_report(spark, d):
    wide = tables.cells(spark, d).join(tables.raster(spark, d), ["r", "c"])
    return points.layer_report(wide, ["q", "p", "v"]).select("layer", "least", "most", _rounded("missing").alias("missing"))


@query(f"WITH {CELLS}, {RAST}, e AS (SELECT min(v) AS a, max(v) AS b, avg((v IS NULL)::INT) AS m FROM rast) SELECT 'v' AS layer, printf('| %s | %.3f | %.3f | %.1f%% |', 'v', a, b, m * 100) AS line FROM e")
def report_text(spark, d):
    return points.report_lines(points.layer_report(tables.raster(spark, d), ["v"]))


@query(f"WITH {CELLS}, {RAST} SELECT round(avg((v IS NOT NULL)::INT) FILTER (mq >= 50), 6) AS of_presence, round(avg((v IS NOT NULL)::INT) FILTER (mq < 50), 6) AS of_background FROM cells JOIN rast USING (r, c)")
def coverage_report(spark, d):
    rows = tables.cells(spark, d).withColumn("presence", (F.col("mq") >= 50).cast("int")).join(tables.raster(spark, d), ["r", "c"])
    out = points.covered(rows, ["v"])
    return out.select(*[_rounded(c).alias(c) for c in out.columns])


@query(f"WITH {CELLS}, {RAST}, {OCC}, {SAMPLED} SELECT id, v FROM smp WHERE v IS NOT NULL ORDER BY md5('7:' || id), id LIMIT 100")
def background_from_points(spark, d):
    return points.background_of(_sampled(spark, d), "id", ["v"], 100, 7).select("id", "v")


@query(
    f"""WITH {CELLS}, {RAST}, u AS (SELECT i AS id, {HASH.format("'7:' || i || ':x'")} / 4294967296.0 * 20000 AS x, {HASH.format("'7:' || i || ':y'")} / 4294967296.0 * 20000 AS y FROM range(600) AS t(i))
SELECT id, round(x, 4) AS x, round(y, 4) AS y, v FROM u JOIN rast ON r = floor(y / 500) AND c = floor(x / 500) WHERE v IS NOT NULL ORDER BY id LIMIT 200"""
)
def oversampled_background(spark, d):
    raster = tables.raster(spark, d)
    out = points.uniform_background(spark, 200, (0.0, 0.0, 20000.0, 20000.0), 7, lambda p: points.sample(p, raster, ["v"], 0, 0, 500), ["v"])
    return out.select("id", _rounded("x", 4).alias("x"), _rounded("y", 4).alias("y"), "v")


@query("SELECT l_returnflag, l_linestatus, round(avg(l_quantity), 6) AS mean, round(stddev_samp(l_quantity), 6) AS std, printf('%.2f ± %.2f', avg(l_quantity), stddev_samp(l_quantity)) AS text FROM lineitem GROUP BY ALL")
def metrics_text(spark, d):
    out = points.metrics_table(tables.table(spark, d, "lineitem").withColumn("l_quantity", F.col("l_quantity").cast("double")), ["l_returnflag", "l_linestatus"], "l_quantity")
    return out.select("l_returnflag", "l_linestatus", _rounded("mean").alias("mean"), _rounded("std").alias("std"), "text")


_DIRTY = "CASE n % 5 WHEN 0 THEN 0 WHEN 1 THEN -9999 WHEN 2 THEN 1e38 ELSE q END"


@query(f"WITH {CELLS} SELECT r, c, round(CASE WHEN n % 5 > 2 THEN q * 0.2 END, 6) AS v FROM cells")
def measured_values(spark, d):
    """Zeros, a sentinel and impossibly large values are missing; the others are scaled."""
    return tables.cells(spark, d).withColumn("raw", F.expr(_DIRTY)).select("r", "c", _rounded(terrain.measured(F.col("raw"), [0.0, -9999.0], 0.2)).alias("v"))


@query(f"WITH {CELLS} SELECT r, c, round(q - 0.1119 * p, 6) AS v FROM cells")
def bouguer_anomaly(spark, d):
    return tables.cells(spark, d).select("r", "c", _rounded(terrain.bouguer(F.col("q"), F.col("p"))).alias("v"))


_HOLED = f"h AS (SELECT r, c, CASE WHEN (r * 7 + c) % 13 <> 0 THEN v END AS e FROM f), g AS (SELECT r, c, e, coalesce(e, (SELECT avg(e) FROM h)) AS v FROM h)"


def _gradient_sql(source: str, value: str, out: str) -> str:
    return f"""{out} AS (SELECT *, CASE WHEN c = 0 THEN lead({value}) OVER h{out} - {value} WHEN c = {LAST} THEN {value} - lag({value}) OVER h{out} ELSE (lead({value}) OVER h{out} - lag({value}) OVER h{out}) / 2 END AS {out}x,
  CASE WHEN r = 0 THEN lead({value}) OVER w{out} - {value} WHEN r = {ROWS} - 1 THEN {value} - lag({value}) OVER w{out} ELSE (lead({value}) OVER w{out} - lag({value}) OVER w{out}) / 2 END AS {out}y
  FROM {source} WINDOW h{out} AS (PARTITION BY r ORDER BY c), w{out} AS (PARTITION BY c ORDER BY r))"""


def _holed(spark, d):
    return tables.full_raster(spark, d).select("r", "c", F.when((F.col("r") * 7 + F.col("c")) % 13 != 0, F.col("v")).alias("v"))


def _window_sql(name: str, half: int) -> str:
    return f"""{name} AS (SELECT a.r, a.c, avg(b.v) AS {name}v, avg(b.v * b.v) AS {name}s FROM g a, (SELECT unnest(range({-half}, {half + 1})) AS i) x, (SELECT unnest(range({-half}, {half + 1})) AS j) y, g b
  WHERE b.r = {_mirrored('(a.r + x.i)', ROWS)} AND b.c = {_mirrored('(a.c + y.j)', LAST + 1)} GROUP BY a.r, a.c)"""


@query(
    f"""WITH {FULL}, {_HOLED}, {_gradient_sql('g', 'v', 'd1')}, {_gradient_sql('d1', 'd1x', 'd2')}, {_gradient_sql('d2', 'd1y', 'd3')}, {_window_sql('near', 7)}, {_window_sql('fine', 4)}
SELECT d3.r, d3.c, e AS elevation, round(sqrt(d1x * d1x + d1y * d1y), 6) AS slope, round(d2x + d3y, 6) AS curvature, round(v - nearv, 6) AS position, round(sqrt(greatest(fines - finev * finev, 0)), 4) AS roughness
FROM d3 JOIN near USING (r, c) JOIN fine USING (r, c)"""
)
def terrain_derivatives(spark, d):
    holed = _holed(spark, d)
    out = terrain.derivatives(holed, "v", *terrain.shape(holed))
    return out.select("r", "c", "elevation", *[_rounded(c, n).alias(c) for c, n in (("slope", 6), ("curvature", 6), ("position", 6), ("roughness", 4))])


@query(f"WITH {FULL}, {_HOLED}, {_gradient_sql('g', 'v', 'd1')} SELECT r, c, CASE WHEN e IS NOT NULL THEN round(sqrt(d1x * d1x + d1y * d1y), 6) END AS v FROM d1")
def gradient_magnitude(spark, d):
    holed = _holed(spark, d)
    return terrain.gradient_magnitude(holed, "v", *terrain.shape(holed)).select("r", "c", _rounded("v").alias("v"))


@query(
    f"""WITH {CELLS}, {RAST}, b AS (SELECT r, c, nullif(v, 0) * 0.2 AS relief, mq AS mean, radians(v % 360 - 180) AS a FROM rast JOIN cells USING (r, c)),
t AS (SELECT r, c FROM cells WHERE r < 20 AND c < 20)
SELECT t.r, t.c, round(avg(relief), 6) AS g_relief, round(avg(mean) * 0.2, 6) AS g_mean, round(degrees(atan2(avg(sin(a)), avg(cos(a)))), 3) AS g_angle FROM t LEFT JOIN b ON b.r // 2 = t.r AND b.c // 2 = t.c GROUP BY t.r, t.c"""
)
def common_grid(spark, d):
    """Three bands of cells of 500 on cells of 1000, whose centres lie between four of them."""
    cells, raster = tables.cells(spark, d), tables.raster(spark, d)
    band = lambda name, rows, v: rows.select(F.lit(name).alias("band"), "r", "c", v.cast("double").alias("value"))
    bands = band("relief", raster, F.col("v")).unionByName(band("mean", cells, F.col("mq"))).unionByName(band("angle", raster, F.col("v") % 360 - 180)).unionByName(band("other", cells, F.col("q")))
    target = cells.where("r < 20 AND c < 20").select("r", "c")
    out = terrain.to_common_grid(bands, 500.0, 0.0, 0.0, target, 1000.0, "g_", [0.0], 0.2, ("angle",), ("mean",), ["relief", "mean", "angle"])
    return out.select("r", "c", _rounded("g_relief").alias("g_relief"), _rounded("g_mean").alias("g_mean"), _rounded("g_angle", 3).alias("g_angle"))


@query(f"WITH {CELLS} SELECT max(r) + 1 AS rows, max(c) + 1 AS columns FROM cells")
def grid_shape(spark, d):
    return spark.createDataFrame([terrain.shape(tables.cells(spark, d))], "rows long, columns long")


@query(
    f"WITH {CELLS}, hs AS (SELECT quantile_cont(sqrt(q), 0.95) AS f, quantile_cont(sqrt(d), 0.95) AS s FROM cells) SELECT r, c, round(least(1, exp(-sqrt(q) / f)), 6) AS halo_facies, round(least(1, exp(-sqrt(d) / s)), 6) AS halo_struct FROM cells, hs"
)
def wide_halos(spark, d):
    out = features.halo_proximities(tables.cells(spark, d), DISTANCES)
    return out.select("r", "c", *[_rounded(f"halo_{k}").alias(f"halo_{k}") for k in ("facies", "struct")])


@query(
    f"WITH {CELLS}, {_taxonomy_sql()}, gs AS (SELECT r, c, {_scaled('-dist', 'zt')} AS g FROM t3, zt), {_smooth_sql('gs', 'g', 2)}, m AS (SELECT gs.r, gs.c, s2.v FROM gs JOIN s2 USING (r, c)), z AS {_robust_sql('v', 'm', 0.02, 0.98)} SELECT r, c, round({_scaled('v', 'z')}, 5) AS geo_score_sm FROM m, z"
)
def smoothed_taxonomy_score(spark, d):
    g = features.taxonomy_score(tables.cells(spark, d), DISTANCES)
    return features.smoothed_geo_score(g, SIDE, SIDE).select("r", "c", _rounded("geo_score_sm", 5).alias("geo_score_sm"))


@query(f"WITH {OCC} SELECT id FROM occ WHERE contains(lower(status || ';' || status), 'o')")
def occurrences_that_mention(spark, d):
    return tables.occurrences(spark, d).where(points.mentions(["status", "status"], "O")).select("id")
