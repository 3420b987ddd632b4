"""Distances, densities and crossings of segments and boxes, joined by tiles."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from gridlode.plans.materialize import materialize, shuffle_partitions

#: Pairs of segments that a task tests, and so many more than that a single tile's are dealt over several.
TESTS = 2_000_000
#: Sites that a tile holds on average where the search for the nearest begins, and how often reach is halved at most until then.
FEW, HALVINGS = 2, 24


def point_segment_distance(x: Column, y: Column, x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    dx, dy = x2 - x1, y2 - y1
    length = dx * dx + dy * dy
    t = F.when(length > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((x - x1) * dx + (y - y1) * dy) / length))).otherwise(0.0)
    return F.hypot(x - (x1 + t * dx), y - (y1 + t * dy))


def segment_in_circle(x: Column, y: Column, radius: float, x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """Length of the part of a segment within the radius of a point."""
    dx, dy, fx, fy = x2 - x1, y2 - y1, x1 - x, y1 - y
    a, b, c = dx * dx + dy * dy, 2 * (fx * dx + fy * dy), fx * fx + fy * fy - radius * radius
    d = b * b - 4 * a * c
    root = F.sqrt(F.greatest(d, F.lit(0.0)))
    lo = F.greatest(F.lit(0.0), F.try_divide(-b - root, 2 * a))
    hi = F.least(F.lit(1.0), F.try_divide(-b + root, 2 * a))
    return F.when((a > 0) & (d > 0) & (hi > lo), (hi - lo) * F.sqrt(a)).otherwise(0.0)


def cell_segment_distance(x: Column, y: Column, half: float, x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """Least distance between a segment and the square cell of half that side around x, y; 0 where they touch."""

    def slab(at: Column, start: Column, step: Column) -> tuple[Column, Column]:
        within = F.abs(start - at) <= half
        a, b = F.try_divide(at - half - start, step), F.try_divide(at + half - start, step)
        flat = step == 0
        lo = F.when(flat, F.when(within, 0.0).otherwise(2.0)).otherwise(F.least(a, b))
        return lo, F.when(flat, F.when(within, 1.0).otherwise(-1.0)).otherwise(F.greatest(a, b))

    (lx, hx), (ly, hy) = slab(x, x1, x2 - x1), slab(y, y1, y2 - y1)
    touches = F.greatest(F.lit(0.0), lx, ly) <= F.least(F.lit(1.0), hx, hy)
    beyond = lambda at, p: F.greatest(F.abs(p - at) - half, F.lit(0.0))
    ends = [F.hypot(beyond(x, px), beyond(y, py)) for px, py in ((x1, y1), (x2, y2))]
    corners = [point_segment_distance(x + i * half, y + j * half, x1, y1, x2, y2) for i in (-1, 1) for j in (-1, 1)]
    return F.when(touches, 0.0).otherwise(F.least(*ends, *corners))


def tiles_of(lo: Column, hi: Column, size: float) -> Column:
    return F.explode(F.sequence(F.floor(lo / size).cast("long"), F.floor(hi / size).cast("long")))


def near_segments(points: DataFrame, segments: DataFrame, radius: float) -> DataFrame:
    """Pairs of points and segments whose boxes are within the radius: an equality join on tiles of that size."""
    s = segments.withColumn("_tx", tiles_of(F.least("x1", "x2") - radius, F.greatest("x1", "x2") + radius, radius))
    s = s.withColumn("_ty", tiles_of(F.least("y1", "y2") - radius, F.greatest("y1", "y2") + radius, radius))
    p = points.withColumns({"_tx": F.floor(F.col("x") / radius).cast("long"), "_ty": F.floor(F.col("y") / radius).cast("long")})
    return p.join(s, ["_tx", "_ty"]).drop("_tx", "_ty")


def line_density(points: DataFrame, segments: DataFrame, radius: float, keys: list[str]) -> DataFrame:
    """points with density: the length of segments within the radius, 0 where there is none."""
    length = segment_in_circle(F.col("x"), F.col("y"), radius, F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2"))
    summed = near_segments(points, segments, radius).groupBy(*keys).agg(F.sum(length).alias("density"))
    return points.join(summed, keys, "left").na.fill(0.0, ["density"])


def nearest_distance(points: DataFrame, segments: DataFrame, radius: float, keys: list[str], half: float = 0.0) -> DataFrame:
    """points with distance to the nearest segment, searched in rings of doubled radius until every point has one.

    With half, points are the centres of square cells of half that side, and the cell's own distance counts.
    Points without a finite place, or with a null key, have no distance; segments without a finite end are left out.
    """
    ends = [F.col(k) for k in ("x1", "y1", "x2", "y2")]
    whole = F.lit(True)
    for end in ends:
        whole = whole & (F.abs(end.cast("double")) < float("inf"))
    segments = segments.where(whole)
    distance = cell_segment_distance(F.col("x"), F.col("y"), half, *ends) if half else point_segment_distance(F.col("x"), F.col("y"), *ends)
    if segments.isEmpty():
        raise ValueError("there is no segment to measure to")
    placed = F.lit(True)
    for k in ("x", "y"):
        placed = placed & (F.abs(F.col(k).cast("double")) < float("inf"))
    for k in keys:
        placed = placed & F.col(k).isNotNull()
    measured = points.where(placed)
    left, found = measured, None
    while True:
        near = near_segments(left, segments, radius + half).groupBy(*keys).agg(F.min(distance).alias("distance")).where(F.col("distance") <= radius)
        near = materialize(near)  # or else every ring would search all rings before it again
        found = near if found is None else found.unionByName(near)
        left = measured.join(found, keys, "left_anti")
        if left.isEmpty():
            return points.join(found, keys, "left")
        radius *= 2


def cells_touched(cells: DataFrame, segments: DataFrame, half: float, keys: list[str]) -> DataFrame:
    """keys of the cells (centres x, y) that a segment touches, their edges included."""
    distance = cell_segment_distance(F.col("x"), F.col("y"), half, *[F.col(k) for k in ("x1", "y1", "x2", "y2")])
    return near_segments(cells, segments, half).where(distance == 0).select(*keys).distinct()


def box_edges(boxes: DataFrame) -> DataFrame:
    """The four edges (geom_id, x1, y1, x2, y2) of boxes, counter-clockwise."""
    ring = [("x0", "y0", "x1", "y0"), ("x1", "y0", "x1", "y1"), ("x1", "y1", "x0", "y1"), ("x0", "y1", "x0", "y0")]
    edges = F.array(*[F.struct(*[F.col(k).alias(n) for k, n in zip(e, ("x1", "y1", "x2", "y2"), strict=True)]) for e in ring])
    return boxes.select("geom_id", F.explode(edges).alias("e")).select("geom_id", "e.*")


def _extents(edges: DataFrame, margin: float = 0.0) -> DataFrame:
    ends = [f(g(k + "1", k + "2")) + m for f, g, m in ((F.min, F.least, -margin), (F.max, F.greatest, margin)) for k in ("x", "y")]
    return edges.groupBy("geom_id").agg(*[e.alias(n) for e, n in zip(ends, ("x0", "y0", "x1", "y1"), strict=True)])


def points_in_polygons(points: DataFrame, edges: DataFrame, size: float, keys: list[str]) -> DataFrame:
    """keys and geom_id of polygons that hold the points, by the even-odd rule over the edges of all their rings.

    A point meets only the edges in its own band of height size, so no polygon is gathered whole.
    """
    near = points_in_boxes(points.select(*keys, "x", "y"), _extents(edges), size).select(*keys, "x", "y", "geom_id")
    bands = edges.withColumn("_band", tiles_of(F.least("y1", "y2"), F.greatest("y1", "y2"), size))
    met = near.withColumn("_band", F.floor(F.col("y") / size).cast("long")).join(bands, ["geom_id", "_band"])
    straddles = (F.col("y1") <= F.col("y")) != (F.col("y2") <= F.col("y"))
    at = F.col("x1") + F.try_divide((F.col("y") - F.col("y1")) * (F.col("x2") - F.col("x1")), F.col("y2") - F.col("y1"))
    crossed = F.sum(F.when(straddles & (F.col("x") < at), 1).otherwise(0))
    return met.groupBy(*keys, "geom_id").agg(crossed.alias("_n")).where("_n % 2 = 1").drop("_n")


def distance_to_polygons(points: DataFrame, edges: DataFrame, radius: float, keys: list[str]) -> DataFrame:
    """points with distance to the nearest polygon, 0 within one."""
    inside = points_in_polygons(points, edges, radius, keys).select(*keys, F.lit(True).alias("_in")).distinct()
    measured = nearest_distance(points, edges, radius, keys).join(inside, keys, "left")
    return measured.withColumn("distance", F.when(F.col("_in"), 0.0).otherwise(F.col("distance"))).drop("_in")


def circle_under_edge(x: Column, y: Column, radius: float, x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """Signed area that a circle shares with the triangle of its centre and an edge; over a ring these add up to the shared area."""
    px, py, qx, qy = x1 - x, y1 - y, x2 - x, y2 - y
    dx, dy = qx - px, qy - py
    a, b, c = dx * dx + dy * dy, 2 * (px * dx + py * dy), px * px + py * py - radius * radius
    d = b * b - 4 * a * c
    root = F.sqrt(F.greatest(d, F.lit(0.0)))
    clamp = lambda t: F.greatest(F.lit(0.0), F.least(F.lit(1.0), t))
    lo, hi = clamp(F.try_divide(-b - root, 2 * a)), clamp(F.try_divide(-b + root, 2 * a))
    sector = lambda ax, ay, bx, by: F.atan2(ax * by - ay * bx, ax * bx + ay * by) * (radius * radius / 2)
    ux, uy, vx, vy = px + lo * dx, py + lo * dy, px + hi * dx, py + hi * dy
    chord = sector(px, py, ux, uy) + (ux * vy - uy * vx) / 2 + sector(vx, vy, qx, qy)
    return F.when(a == 0, 0.0).when((d > 0) & (hi > lo), chord).otherwise(sector(px, py, qx, qy))


def polygon_density(points: DataFrame, edges: DataFrame, radius: float, keys: list[str]) -> DataFrame:
    """points with density: the area of polygons within the radius; overlapping polygons count each."""
    near = points_in_boxes(points.select(*keys, "x", "y"), _extents(edges, radius), radius).select(*keys, "x", "y", "geom_id")
    part = circle_under_edge(F.col("x"), F.col("y"), radius, *[F.col(k) for k in ("x1", "y1", "x2", "y2")])
    shared = near.join(edges, "geom_id").groupBy(*keys, "geom_id").agg(F.abs(F.sum(part)).alias("a"))
    return points.join(shared.groupBy(*keys).agg(F.sum("a").alias("density")), keys, "left").na.fill(0.0, ["density"])


def density(points: DataFrame, shapes: DataFrame, radius: float, keys: list[str], measure: str) -> DataFrame:
    """Length of segments or area of polygons (given by their edges) within the radius."""
    if measure not in ("length", "area"):
        raise ValueError(f"unknown measure: {measure}")
    return (line_density if measure == "length" else polygon_density)(points, shapes, radius, keys)


def _finite(*names: str) -> Column:
    """Whether all columns are numbers, neither null nor infinite."""
    out = F.lit(True)
    for k in names:
        out = out & F.coalesce(F.abs(F.col(k).cast("double")) < float("inf"), F.lit(False))
    return out


def _lengths(segments: DataFrame) -> Row:
    """Number, length and box of segments, one row."""
    dx, dy = F.abs(F.col("x2") - F.col("x1")).cast("double"), F.abs(F.col("y2") - F.col("y1")).cast("double")
    box = [f(g(k + "1", k + "2")).cast("double").alias(n + k) for n, f, g in (("lo_", F.min, F.least), ("hi_", F.max, F.greatest)) for k in ("x", "y")]
    return segments.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.hypot(dx, dy)), F.lit(0.0)).alias("length"), F.coalesce(F.sum(dx + dy), F.lit(0.0)).alias("steps"), *box).first()


def _area(a: Row, b: Row) -> float:
    """Area of the box of both layers, neither of which is empty; a thin box counts as wide as a hundredth of its length."""
    w, h = (max(a["hi_" + k], b["hi_" + k]) - min(a["lo_" + k], b["lo_" + k]) for k in ("x", "y"))
    return max(w, h / 100) * max(h, w / 100)


def node_distance(points: DataFrame, a: DataFrame, b: DataFrame, size: float, keys: list[str], otherwise: float) -> DataFrame:
    """points with distance to the nearest crossing of two line layers; otherwise where nothing crosses.

    Up to size the search doubles its radius, from one at which a point meets a line or so of each layer, and crosses only
    what it meets: the crossings of dense lines are far more than the lines. What is still without one meets all crossings.
    """
    points, parts = materialize(points), shuffle_partitions(points.sparkSession)
    ends = ["x1", "y1", "x2", "y2"]
    a, b = (materialize(s.where(_finite(*ends)).select("geom_id", *[F.col(k).cast("double").alias(k) for k in ends]).repartition(parts)) for s in (a, b))
    placed = points.where(_finite("x", "y"))
    for k in keys:
        placed = placed.where(F.col(k).isNotNull())
    placed = placed.select(*keys, F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
    of_a, of_b, n = _lengths(a), _lengths(b), placed.count()
    if not of_a["n"] or not of_b["n"]:
        return points.withColumn("distance", F.lit(float(otherwise)))
    area, found, left = _area(of_a, of_b), None, placed
    most, radius = area / (2 * (of_a["length"] * of_b["length"]) ** 0.5) if of_a["length"] * of_b["length"] else size, float(size)
    for _ in range(HALVINGS):
        radius = radius / 2 if radius > most else radius
    own = [F.col(k) for k in ("px", "py")]
    while n and radius <= size:
        tile = max(radius, min(size, (area / n) ** 0.5))  # about a point a tile, if points are fewer than lines

        def met(segments: DataFrame, name: str, tile: float = tile, radius: float = radius, left: DataFrame = left) -> DataFrame:
            near = near_segments(left, segments, tile).where(point_segment_distance(F.col("x"), F.col("y"), *[F.col(k) for k in ends]) <= radius * 1.001)
            return near.select(*keys, F.col("x").alias("px"), F.col("y").alias("py"), *[F.col(k).alias(name + k) for k in ends])

        nodes = _crossed(met(a, "a").join(met(b, "b").drop("px", "py"), keys))
        distance = point_segment_distance(*own, *[F.col(k) for k in ("x", "y", "x2", "y2")])
        near = materialize(nodes.groupBy(*keys).agg(F.min(distance).alias("distance")).where(F.col("distance") <= radius))
        found = near if found is None else found.unionByName(near)
        left = placed.join(found, keys, "left_anti")
        n, radius = left.count(), radius * 2
    if n:
        nodes = materialize(crossings(a, b, size))
        if nodes.isEmpty():
            return points.withColumn("distance", F.lit(float(otherwise)))
        nodes = nodes.select(F.col("a_id").alias("geom_id"), F.col("x").alias("x1"), F.col("y").alias("y1"), "x2", "y2")
        far = nearest_distance(left, nodes, size, keys).select(*keys, "distance")
        found = far if found is None else found.unionByName(far)
    return points.withColumn("distance", F.lit(float(otherwise))) if found is None else points.join(found, keys, "left")


def build_grid(mask: DataFrame, size: float) -> DataFrame:
    """cell_id, r, c, x, y (centres) of the square cells from the mask's lower left corner that touch the mask's polygons.

    mask holds polygon edges. Cells are numbered by row, then column; the prefix sum runs over one row per grid row.
    """
    lo = mask.agg(*[F.min(F.least(k + "1", k + "2")).cast("double").alias(f"lo_{k}") for k in ("x", "y")], *[F.max(F.greatest(k + "1", k + "2")).cast("double").alias(f"hi_{k}") for k in ("x", "y")]).first()
    spark = mask.sparkSession
    if lo["lo_x"] is None:
        return spark.createDataFrame([], "cell_id long, r long, c long, x double, y double")
    rows, columns = (max(1, -int(-(lo[f"hi_{k}"] - lo[f"lo_{k}"]) // size)) for k in ("y", "x"))
    every = spark.range(rows * columns).select(F.floor(F.col("id") / columns).cast("long").alias("r"), (F.col("id") % columns).alias("c"))
    every = every.withColumns({"x": lo["lo_x"] + (F.col("c") + 0.5) * size, "y": lo["lo_y"] + (F.col("r") + 0.5) * size})
    held = cells_touched(every, mask, size / 2, ["r", "c"]).unionByName(points_in_polygons(every, mask, size, ["r", "c"]).select("r", "c")).distinct()
    kept = every.join(held, ["r", "c"], "left_semi")
    before = kept.groupBy("r").count().select("r", F.coalesce(F.sum("count").over(Window.orderBy("r").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    at = F.row_number().over(Window.partitionBy("r").orderBy("c")) - 1
    return kept.join(before, "r").select((at + F.col("_before")).alias("cell_id"), "r", "c", "x", "y")


def _crossed(pairs: DataFrame) -> DataFrame:
    """Those pairs of segments (ax1 to ay2, bx1 to by2, doubles) that cross, with x, y, x2, y2 of what they share in place of their ends.

    They share a point, or a stretch of one line. The place is on a, kept within both segments' boxes, so that it lies in one of their tiles.
    """
    ends = [n + k for n in ("a", "b") for k in ("x1", "y1", "x2", "y2")]
    kept = [f for f in pairs.schema.fields if f.name not in ends]
    names, places = [f.name for f in kept], ["x", "y", "x2", "y2"]

    def cross(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ax1, ay1, ax2, ay2, bx1, by1, bx2, by2 = (batch.column(k).to_numpy(zero_copy_only=False) for k in ends)
            ux, uy, vx, vy, wx, wy = ax2 - ax1, ay2 - ay1, bx2 - bx1, by2 - by1, bx1 - ax1, by1 - ay1
            d, length = ux * vy - uy * vx, ux * ux + uy * uy
            with np.errstate(divide="ignore", invalid="ignore"):
                t, u = (wx * vy - wy * vx) / d, (wx * uy - wy * ux) / d
                # on one line: the stretch of a that b covers
                start, to = (wx * ux + wy * uy) / length, ((bx2 - ax1) * ux + (by2 - ay1) * uy) / length
                lo, hi = np.maximum(0.0, np.minimum(start, to)), np.minimum(1.0, np.maximum(start, to))
                point = (d != 0) & (t >= 0) & (t <= 1) & (u >= 0) & (u <= 1)
                stretch = (d == 0) & (wx * uy == wy * ux) & (length > 0) & (lo <= hi)
            at = np.flatnonzero(point | stretch)
            shares = (np.where(point, v, w)[at] for v, w in ((t, lo), (t, hi)))
            boxes = [[f(g(a1[at], a2[at]), g(b1[at], b2[at])) for f, g in ((np.maximum, np.minimum), (np.minimum, np.maximum))] for a1, a2, b1, b2 in ((ax1, ax2, bx1, bx2), (ay1, ay2, by1, by2))]
            found = [np.minimum(np.maximum(a1[at] + share * step[at], least), most) for share in shares for (least, most), a1, step in zip(boxes, (ax1, ay1), (ux, uy), strict=True)]
            rest = batch.select(names).take(pa.array(at))
            yield pa.RecordBatch.from_arrays([*rest.columns, *map(pa.array, found)], names=[*names, *places])

    return pairs.mapInArrow(cross, StructType([*kept, *[StructField(k, DoubleType()) for k in places]]))


def _line_tiles(s: DataFrame, name: str, size: float) -> DataFrame:
    """Segments once for each tile (_tx, _ty) that they pass, by columns of tiles; a little beyond, against rounding."""
    x1, y1, x2, y2 = (F.col(name + k) for k in ("x1", "y1", "x2", "y2"))
    out = s.withColumn("_tx", tiles_of(F.least(x1, x2), F.greatest(x1, x2), size))
    low, high, slope = F.least(y1, y2), F.greatest(y1, y2), (y2 - y1) / F.when(x1 != x2, x2 - x1)
    at = lambda tile: y1 + (F.least(F.greatest(tile * size, F.least(x1, x2)), F.greatest(x1, x2)) - x1) * slope
    ends = at(F.col("_tx")), at(F.col("_tx") + 1)
    pad = 1e-6 * size + 1e-9 * (F.greatest(F.abs(y1), F.abs(y2)) + F.greatest(F.abs(x1), F.abs(x2)) * F.abs(slope))
    lo, hi = F.greatest(low, F.least(*ends) - pad), F.least(high, F.greatest(*ends) + pad)
    return out.withColumn("_ty", tiles_of(F.when(slope.isNull(), low).otherwise(lo), F.when(slope.isNull(), high).otherwise(hi), size))


def crossings(a: DataFrame, b: DataFrame, size: float) -> DataFrame:
    """Where segments of a cross segments of b: a_id, b_id, x, y, x2, y2; lines that lie on each other share a stretch, all others a point.

    Every crossing is kept in the one tile that holds its beginning, so geometries that meet several times have a row for each.
    Tiles of that size are halved while pairs outnumber segments and it spares pairs; a tile of many pairs is dealt by the
    lines of a, so tasks grow in number, not in length.
    """
    ends, parts = ("x1", "y1", "x2", "y2"), shuffle_partitions(a.sparkSession)
    a, b = (s.where(_finite(*ends)) for s in (a, b))
    of_a, of_b = _lengths(a), _lengths(b)
    if of_a["n"] and of_b["n"]:
        area = _area(of_a, of_b)
        rows = lambda at: [of["n"] + of["steps"] / at for of in (of_a, of_b)]
        pairs = lambda at: rows(at)[0] * rows(at)[1] * at * at / area if area else 0.0
        while pairs(size) > sum(rows(size)) and pairs(size / 2) < 0.9 * pairs(size):
            size /= 2
    named = lambda s, name: s.select(F.col("geom_id").alias(f"{name}_id"), *[F.col(k).cast("double").alias(name + k) for k in ends])
    tiled = {name: _line_tiles(named(s, name).repartition(parts), name, size) for name, s in (("a", a), ("b", b))}
    held = [tiled[k].groupBy("_tx", "_ty").agg(F.count(F.lit(1)).alias("_n" + k)) for k in ("a", "b")]
    load = materialize(held[0].join(held[1], ["_tx", "_ty"]).select("_tx", "_ty", F.ceil(F.col("_na") * F.col("_nb") / TESTS).cast("long").alias("_deals"), (F.col("_na") * F.col("_nb")).alias("_pairs")))
    tasks = max(parts, (load.agg(F.sum("_pairs")).first()[0] or 0) // TESTS + 1)
    dealt = load.select("_tx", "_ty", "_deals")  # without tiles of one layer alone
    left = tiled["a"].join(dealt, ["_tx", "_ty"]).withColumn("_deal", F.pmod(F.xxhash64("a_id"), F.col("_deals"))).drop("_deals")
    right = tiled["b"].join(dealt, ["_tx", "_ty"]).withColumn("_deal", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_deals") - 1))).drop("_deals")
    left, right = (x.repartition(tasks, "_tx", "_ty", "_deal") for x in (left, right))  # so many tasks whichever side Spark broadcasts
    placed = _crossed(left.join(right, ["_tx", "_ty", "_deal"]))
    own = placed.where((F.floor(F.col("x") / size) == F.col("_tx")) & (F.floor(F.col("y") / size) == F.col("_ty")))
    # equal crossings are of one tile and deal, so as many tasks tell them apart
    return own.repartition(tasks, "_tx", "_ty", "_deal").distinct().select("a_id", "b_id", "x", "y", "x2", "y2")


def points_in_boxes(points: DataFrame, boxes: DataFrame, size: float) -> DataFrame:
    """Points with the boxes (x0, y0, x1, y1) that hold them, edges included."""
    tiled = boxes.withColumn("_tx", tiles_of(F.col("x0"), F.col("x1"), size)).withColumn("_ty", tiles_of(F.col("y0"), F.col("y1"), size))
    p = points.withColumns({"_tx": F.floor(F.col("x") / size).cast("long"), "_ty": F.floor(F.col("y") / size).cast("long")})
    return p.join(tiled, ["_tx", "_ty"]).where("x BETWEEN x0 AND x1 AND y BETWEEN y0 AND y1").drop("_tx", "_ty")


def nearest_within(points: DataFrame, sites: DataFrame, reach: float, key: str, value: str) -> DataFrame:
    """points with value of the nearest site (id, x, y) within reach, ties to the least id; null beyond.

    The search doubles its radius up to reach, from one at which a tile holds a site or two, so that a point meets few
    sites however many there are; of sites at one place only the least counts.
    """
    of = sites.where(_finite("x", "y")).select(F.col("id").alias("_site"), F.col("x").alias("_sx"), F.col("y").alias("_sy"), F.col(value).alias("_v"))
    of = materialize(of.groupBy("_sx", "_sy").agg(F.min_by(F.struct("_site", "_v"), F.struct("_site")).alias("_s")).select("_sx", "_sy", "_s.*"))
    tile = lambda x, y, size: [F.floor(F.col(k) / size).cast("long") for k in (x, y)]
    radii = [reach / 2**k for k in range(HALVINGS)]
    held = of.agg(F.count(F.lit(1)).alias("n"), *[F.approx_count_distinct(F.struct(*tile("_sx", "_sy", r))).alias(f"t{k}") for k, r in enumerate(radii)]).first()
    first = next((k for k in range(HALVINGS) if held["n"] <= FEW * held[f"t{k}"]), HALVINGS - 1)
    d2 = (F.col("x") - F.col("_sx")) * (F.col("x") - F.col("_sx")) + (F.col("y") - F.col("_sy")) * (F.col("y") - F.col("_sy"))
    places = points.where(_finite("x", "y") & F.col(key).isNotNull()).select(key, "x", "y")
    left, found = places, None
    for r in reversed(radii[: first + 1]):
        tiled = of.withColumn("_tx", tiles_of(F.col("_sx") - r, F.col("_sx") + r, r)).withColumn("_ty", tiles_of(F.col("_sy") - r, F.col("_sy") + r, r))
        p = left.withColumns(dict(zip(("_tx", "_ty"), tile("x", "y", r), strict=True)))
        near = p.join(tiled, ["_tx", "_ty"]).withColumn("_d2", d2).where(F.col("_d2") <= r * r)
        best = materialize(near.groupBy(key).agg(F.min_by("_v", F.struct("_d2", "_site")).alias(value)))
        found = best if found is None else found.unionByName(best)
        if r < reach:
            left = materialize(left.join(best.select(key), key, "left_anti"))
            if left.isEmpty():
                break
    return points.join(found, key, "left")
