"""Operators on regular grids held as rows (r, c, value): stencils, resampling, blocks, presence."""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridlode.plans.materialize import shuffle_partitions

#: Cells of a band of a moving window, and cells that one task averages.
STRIPE, TASK_CELLS = 256, 250_000
#: Weights of a smoothing step.
SMOOTHING = {(0, 0): 3.0, (0, 1): 1.2, (0, -1): 1.2, (1, 0): 1.2, (-1, 0): 1.2, (1, 1): 1.0, (1, -1): 1.0, (-1, 1): 1.0, (-1, -1): 1.0}


def scattered(grid: DataFrame, value: str, offsets: dict[tuple[int, int], float]) -> DataFrame:
    """Every value at all its neighbours: r, c, v and the offset's weight w. One narrow step, no join."""
    steps = F.array(*[F.struct(F.lit(dr).alias("dr"), F.lit(dc).alias("dc"), F.lit(w).alias("w")) for (dr, dc), w in offsets.items()])
    spread = grid.where(F.col(value).isNotNull()).select("r", "c", F.col(value).alias("v"), F.explode(steps).alias("o"))
    return spread.select((F.col("r") + F.col("o.dr")).alias("r"), (F.col("c") + F.col("o.dc")).alias("c"), "v", "o.w")


def smooth(grid: DataFrame, value: str, rows: int, columns: int, passes: int = 1) -> DataFrame:
    """grid with value replaced by its smoothed value; between passes the support grows within rows by columns."""
    held = grid.select("r", "c", F.col(value).alias("v"))
    for _ in range(max(1, passes)):
        near = scattered(held, "v", SMOOTHING).where(F.col("r").between(0, rows - 1) & F.col("c").between(0, columns - 1))
        held = near.groupBy("r", "c").agg((F.sum(F.col("v") * F.col("w")) / F.sum("w")).alias("v"))
    return grid.drop(value).join(held.withColumnRenamed("v", value), ["r", "c"], "left")


def window_mean(grid: DataFrame, value: str, size: int, rows: int, columns: int) -> DataFrame:
    """Mean over size by size cells, values beyond the edge mirrored; two passes, one per axis.

    A pass runs in bands of STRIPE cells along its axis: a cell goes to the bands that its window reaches, and all that a
    mean needs is then in one task. Tasks grow in number with the cells, so none holds more than about TASK_CELLS.
    """
    held, half = grid.select("r", "c", F.col(value).alias("v")), size // 2
    parts = max(shuffle_partitions(grid.sparkSession), -(-grid.count() // TASK_CELLS))
    for axis, n in (("r", rows), ("c", columns)):
        other = "c" if axis == "r" else "r"
        steps = F.array(*[F.lit(i) for i in range(-half, size - half)])
        # a cell at distance d inside the edge also stands for the mirrored cell beyond it
        images = F.array(F.col(axis), -1 - F.col(axis), 2 * n - 1 - F.col(axis))
        first, last = (F.floor(F.greatest(F.lit(0), F.least(F.lit(n - 1), e)) / STRIPE).cast("long") for e in (F.col("at") - (size - half - 1), F.col("at") + half))
        reaches = (F.col("at") - (size - half - 1) <= n - 1) & (F.col("at") + half >= 0)
        spread = held.select("r", "c", "v", F.explode(images).alias("at")).where(reaches)
        spread = spread.select(other, "v", "at", F.explode(F.sequence(first, last)).alias("band")).repartition(parts, "band", other)
        spread = spread.select(other, "v", "at", "band", F.explode(steps).alias("step")).withColumn("to", F.col("at") - F.col("step"))
        spread = spread.where(F.col("to").between(0, n - 1) & (F.floor(F.col("to") / STRIPE) == F.col("band")))
        held = spread.groupBy("band", other, F.col("to").alias(axis)).agg(F.avg("v").alias("v"))
    return held.select("r", "c", "v").repartition(parts, "r", "c")  # joins on cells keep these parts


def local_maxima(grid: DataFrame, value: str) -> DataFrame:
    """r, c and peak: whether no neighbour is higher; plateaus are peaks."""
    highest = scattered(grid, value, dict.fromkeys(product((-1, 0, 1), repeat=2), 1.0)).groupBy("r", "c").agg(F.max("v").alias("highest"))
    return grid.join(highest, ["r", "c"], "left").withColumn("peak", F.coalesce(F.col(value) >= F.col("highest"), F.lit(False))).drop("highest")


def gradients(grid: DataFrame, value: str, rows: int, columns: int) -> DataFrame:
    """r, c, gx, gy: central differences inside, one-sided ones at the edges of a full grid."""

    def along(axis: str, n: int, name: str) -> DataFrame:
        steps = F.array(*[F.struct(F.lit(d).alias("d"), F.lit(s).alias("s")) for d, s in ((1, -1.0), (-1, 1.0))])
        lead = F.explode(steps).alias("o")
        moved = grid.select("r", "c", F.col(value).alias("v"), lead)
        to = F.col(axis) + F.col("o.d")
        # the value counts for the neighbour on either side; at an edge the cell itself takes the missing side
        inner = moved.select(*[(to if a == axis else F.col(a)).alias(a) for a in ("r", "c")], (F.col("v") * F.col("o.s")).alias("part")).where(F.col(axis).between(0, n - 1))
        edge = grid.where((F.col(axis) == 0) | (F.col(axis) == n - 1)).select("r", "c", (F.col(value) * F.when(F.col(axis) == 0, -1.0).otherwise(1.0)).alias("part"))
        width = F.when(F.col(axis).isin(0, n - 1), 1.0).otherwise(2.0)
        return inner.unionByName(edge).groupBy("r", "c").agg(F.sum("part").alias("p")).select("r", "c", (F.col("p") / width).alias(name))

    return along("c", columns, "gx").join(along("r", rows, "gy"), ["r", "c"])


def coarsen(grid: DataFrame, value: str, factor: int) -> DataFrame:
    """Average of factor by factor cells, missing ones left out."""
    at = lambda a: F.floor(F.col(a) / factor).cast("long")
    return grid.groupBy(at("r").alias("r"), at("c").alias("c")).agg(F.avg(value).alias(value))


def bilinear(grid: DataFrame, value: str, points: DataFrame, row: Column, column: Column) -> DataFrame:
    """points with value interpolated at fractional cell centres; the weights of missing cells are dealt to the others."""
    corners = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in product((0, 1), repeat=2)])
    placed = points.withColumns({"_y": row, "_x": column})
    each = placed.select("_y", "_x").distinct().withColumn("_k", F.explode(corners))
    fy, fx = F.col("_y") - F.floor("_y"), F.col("_x") - F.floor("_x")
    w = F.when(F.col("_k.a") == 1, fy).otherwise(1 - fy) * F.when(F.col("_k.b") == 1, fx).otherwise(1 - fx)
    at = {"r_": F.floor("_y").cast("long") + F.col("_k.a"), "c_": F.floor("_x").cast("long") + F.col("_k.b"), "w_": w}
    found = each.withColumns(at).where("w_ > 0").join(grid.select(F.col("r").alias("r_"), F.col("c").alias("c_"), F.col(value).alias("v_")).where("v_ IS NOT NULL"), ["r_", "c_"])
    weighed = found.groupBy("_y", "_x").agg((F.sum(F.col("v_") * F.col("w_")) / F.sum("w_")).alias(value))
    return placed.join(weighed, ["_y", "_x"], "left").drop("_y", "_x")


def bilinear_angle(grid: DataFrame, value: str, points: DataFrame, row: Column, column: Column) -> DataFrame:
    """points with an angle in degrees, interpolated by its sine and cosine, so that -179 and 179 meet at 180."""
    parts = grid.select("r", "c", F.sin(F.radians(value)).alias("_sin"), F.cos(F.radians(value)).alias("_cos"))
    both = bilinear(parts, "_cos", bilinear(parts, "_sin", points, row, column), row, column)
    return both.withColumn(value, F.degrees(F.atan2("_sin", "_cos"))).drop("_sin", "_cos")


def resample_area(grid: DataFrame, value: str, size: float, to: float, dx: float = 0.0, dy: float = 0.0) -> DataFrame:
    """Average on a grid of cells of size to, shifted by dx and dy: every cell counts by the area that they share."""
    held = grid.where(F.col(value).isNotNull()).select("r", "c", F.col(value).alias("v"))
    for axis, shift in (("r", dy), ("c", dx)):
        lo = F.col(axis) * size - shift
        held = held.withColumns({f"_lo{axis}": lo, f"_hi{axis}": lo + size})
        first, last = F.floor(F.col(f"_lo{axis}") / to), F.ceil(F.col(f"_hi{axis}") / to) - 1
        held = held.withColumn(f"_to{axis}", F.explode(F.sequence(first.cast("long"), last.cast("long"))))
        held = held.withColumn(f"_w{axis}", F.least(F.col(f"_hi{axis}"), (F.col(f"_to{axis}") + 1) * to) - F.greatest(F.col(f"_lo{axis}"), F.col(f"_to{axis}") * to))
    w = F.col("_wr") * F.col("_wc")
    shared = held.withColumn("w", w).where("w > 0")
    return shared.groupBy(F.col("_tor").alias("r"), F.col("_toc").alias("c")).agg((F.sum(F.col("v") * F.col("w")) / F.sum("w")).alias(value))


def blocks(cells: DataFrame, x: Column, y: Column, size: float) -> DataFrame:
    """cells with block: the number of the size by size block."""
    lo = cells.agg(F.min(x).alias("x"), F.min(y).alias("y"), F.max(y).alias("top")).first()
    if lo["x"] is None:
        return cells.withColumn("block", F.lit(None).cast("long"))
    most = int((lo["top"] - lo["y"]) // size)
    return cells.withColumn("block", (F.floor((x - lo["x"]) / size) * (most + 1) + F.floor((y - lo["y"]) / size)).cast("long"))


def coarse_support(cells: DataFrame, columns: list[str], label: str, x: Column, y: Column) -> DataFrame:
    """block, the means of all columns (missing values left out), whether the block has presence, and the mean place of its cells."""
    means = [F.avg(c).alias(c) for c in columns]
    return cells.groupBy("block").agg(*means, F.max(label).alias(label), F.avg(x).alias("x"), F.avg(y).alias("y"))


def cells_with_points(points: DataFrame, size: int, x0: int = 0, y0: int = 0) -> DataFrame:
    """points with the cell (r, c) that they lie strictly within; those on an edge are left out."""
    dx, dy = F.col("x") - x0, F.col("y") - y0
    inside = (F.pmod(dx, F.lit(size)) != 0) & (F.pmod(dy, F.lit(size)) != 0)
    return points.where(inside).withColumns({"r": F.floor(dy / size).cast("long"), "c": F.floor(dx / size).cast("long")})


def presence(cells: DataFrame, points: DataFrame, size: int, x0: int = 0, y0: int = 0) -> DataFrame:
    """cells with presence: 1 where a point lies within; cell (0, 0) begins at (x0, y0)."""
    hit = cells_with_points(points, size, x0, y0).select("r", "c", F.lit(1).alias("presence")).distinct()
    return cells.join(hit, ["r", "c"], "left").na.fill(0, ["presence"])


def disc(radius: int) -> dict[tuple[int, int], float]:
    return {(a, b): 1.0 for a, b in product(range(-radius, radius + 1), repeat=2) if a * a + b * b <= radius * radius}


def neighbourhood(cells: DataFrame, seeds: DataFrame, radius: int) -> DataFrame:
    """Those cells within the radius, in cells, of a seed."""
    reached = scattered(seeds.withColumn("one", F.lit(1)), "one", disc(radius)).select("r", "c").distinct()
    return cells.join(reached, ["r", "c"], "left_semi")
