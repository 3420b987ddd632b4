"""Derived rasters, and bands of other grids brought to a common one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridlode.functions.numeric import finite, quantiles
from gridlode.operators.grid import bilinear, bilinear_angle, gradients, resample_area, window_mean
from gridlode.plans.materialize import materialize

#: Windows of the position and of the roughness, and the largest magnitude that is a measurement.
POSITION, ROUGHNESS, LARGEST = 15, 9, 1e30
#: Fixed value: pull of a metre of relief.
PULL = 0.1119


def shape(cells: DataFrame) -> tuple[int, int]:
    """Rows and columns up to the last ones that are held."""
    last = cells.agg(F.max("r"), F.max("c")).first()
    return (int(last[0]) + 1, int(last[1]) + 1) if last[0] is not None else (0, 0)


def cell_centres(cells: DataFrame, x0: float, y0: float, dx: float, dy: float, rows: int) -> DataFrame:
    """cells with the centre x, y; row 0 is the north."""
    return cells.withColumns({"x": x0 + (F.col("c") + 0.5) * dx, "y": y0 + rows * dy - (F.col("r") + 0.5) * dy})


def measured(value: Column, nodata: list[float] | None = None, scale: float = 1.0) -> Column:
    """The value by scale; nodata, not finite and impossibly large ones are missing."""
    v = finite(value)
    v = F.when(F.abs(v) <= LARGEST, v)
    return F.when(~v.isin(nodata), v) * scale if nodata else v * scale


def bouguer(free_air: Column, relief: Column) -> Column:
    """Free-air anomaly less the pull of the relief."""
    return free_air - PULL * relief


def filled(grid: DataFrame, value: str) -> DataFrame:
    """r, c and v: missing values replaced by the mean of all."""
    mean = grid.agg(F.avg(finite(F.col(value)))).first()[0]
    return grid.select("r", "c", F.coalesce(finite(F.col(value)), F.lit(mean or 0.0)).alias("v"))


def derivatives(grid: DataFrame, value: str, rows: int, columns: int) -> DataFrame:
    """r, c, elevation (as it is), slope, curvature, position and roughness of a full grid; gaps count as the mean."""
    held = materialize(filled(grid, value))
    slopes = materialize(gradients(held, "v", rows, columns).withColumn("slope", F.hypot("gx", "gy")))
    second = gradients(slopes, "gx", rows, columns).select("r", "c", F.col("gx").alias("gxx"))
    second = second.join(gradients(slopes, "gy", rows, columns).select("r", "c", F.col("gy").alias("gyy")), ["r", "c"])
    near = window_mean(held, "v", POSITION, rows, columns).select("r", "c", F.col("v").alias("near"))
    mean = window_mean(held, "v", ROUGHNESS, rows, columns).select("r", "c", F.col("v").alias("mean"))
    square = window_mean(held.withColumn("v", F.col("v") * F.col("v")), "v", ROUGHNESS, rows, columns).select("r", "c", F.col("v").alias("square"))
    out = grid.select("r", "c", F.col(value).alias("elevation"))
    for part in (held, slopes.select("r", "c", "slope"), second, near, mean, square):
        out = out.join(part, ["r", "c"])
    rough = F.sqrt(F.greatest(F.col("square") - F.col("mean") * F.col("mean"), F.lit(0.0)))
    return out.select("r", "c", "elevation", "slope", (F.col("gxx") + F.col("gyy")).alias("curvature"), (F.col("v") - F.col("near")).alias("position"), rough.alias("roughness"))


def gradient_magnitude(grid: DataFrame, value: str, rows: int, columns: int) -> DataFrame:
    """r, c and v: length of the gradient; missing where the grid is."""
    steep = gradients(materialize(filled(grid, value)), "v", rows, columns).select("r", "c", F.hypot("gx", "gy").alias("steep"))
    return grid.join(steep, ["r", "c"]).select("r", "c", F.when(finite(F.col(value)).isNotNull(), F.col("steep")).alias("v"))


def to_common_grid(bands: DataFrame, size: float, dx: float, dy: float, cells: DataFrame, to: float, prefix: str = "", nodata: list[float] | None = None, scale: float = 1.0, angles: tuple[str, ...] = (), averages: tuple[str, ...] = (), include: list[str] | None = None) -> DataFrame:
    """cells (r, c) with a column <prefix><band> of every band (band, r, c, value), resampled.

    A band's cells have that size and begin at (dx, dy) from the common grid's, whose cells have the
    size `to`. Angles go by sine and cosine, averages by shared area, all others between four neighbours.
    Bands outside of include are not read further than their name; an unknown one is a KeyError.
    """
    names = sorted(r["band"] for r in bands.select("band").distinct().collect())  # one per band
    if unknown := sorted(set(include or []) - set(names)):
        raise KeyError(f"no band {', '.join(unknown)}; there are {', '.join(names)}")
    # centres of the common cells in rows and columns of the band's grid
    row, column = [((F.col(f"t{k}") + 0.5) * to - shift) / size - 0.5 for k, shift in (("r", dy), ("c", dx))]
    targets = cells.select(F.col("r").alias("tr"), F.col("c").alias("tc"))
    out = cells
    for name in names if include is None else include:
        own = bands.where(F.col("band") == name).select("r", "c", measured(F.col("value"), nodata).alias("v"))
        if name in averages:
            one = cells.join(resample_area(own, "v", size, to, -dx, -dy), ["r", "c"], "left")
        else:
            one = (bilinear_angle if name in angles else bilinear)(own, "v", targets, row, column)
            one = one.select(F.col("tr").alias("r"), F.col("tc").alias("c"), "v")
        out = out.join(one.select("r", "c", (F.col("v") * (1.0 if name in angles else scale)).alias(prefix + name)), ["r", "c"], "left")
    return out


def with_samples(cells: DataFrame, samples: DataFrame | None, columns: list[str], least: float = 0.9) -> tuple[DataFrame, list[str]]:
    """cells (r, c) with the columns of samples, gaps filled by the median, and what to warn of; zeros where there are no samples."""
    if samples is None:
        return cells.withColumns({c: F.lit(0.0) for c in columns}), ["no samples: zeros"]
    joined = materialize(cells.join(samples.select("r", "c", *columns), ["r", "c"], "left"))
    held = joined.agg(*[F.avg(finite(F.col(c)).isNotNull().cast("int")).alias(c) for c in columns]).first()
    medians = {c: quantiles(joined, F.col(c), [0.5])[0] for c in columns}
    out = joined.withColumns({c: F.coalesce(finite(F.col(c)), F.lit(m or 0.0)) for c, m in medians.items()})
    return out, [f"{c}: {held[c]:.0%} covered" for c in columns if (held[c] or 0.0) < least]
