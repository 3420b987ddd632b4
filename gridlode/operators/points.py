"""Occurrence points: reading, choosing, sampling rasters at them, and reports on what was sampled."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridlode.functions.numeric import finite
from gridlode.operators.sampling import random_order, uniform_points


def read_occurrences(spark: SparkSession, path: str, columns: list[str], encoding: str = "ISO-8859-1") -> DataFrame:
    """Those columns of a CSV with a header, all as strings; what else the file has is not parsed."""
    return spark.read.option("header", True).option("encoding", encoding).csv(path).select(*columns)


def first_column(df: DataFrame, names: list[str]) -> Column:
    """The first of these columns that the table has."""
    for name in names:
        if name in df.columns:
            return F.col(name)
    raise KeyError(f"none of {', '.join(names)}; there are {', '.join(df.columns)}")


def differs(column: Column, value: str) -> Column:
    """Unequal; a missing value is unequal too."""
    return ~column.eqNullSafe(F.lit(value))


def in_box(x: Column, y: Column, box: tuple[float, float, float, float]) -> Column:
    """Within (x0, y0, x1, y1), edges included."""
    return x.between(box[0], box[2]) & y.between(box[1], box[3])


def mentions(columns: list[str], word: str) -> Column:
    """Whether any of the columns contains the word, in either case; missing ones are empty."""
    return F.contains(F.lower(F.concat_ws(";", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns])), F.lit(word.lower()))


def all_finite(columns: list[str]) -> Column:
    held = F.lit(True)
    for c in columns:
        held = held & finite(F.col(c)).isNotNull()
    return held


def first_valid(rows: DataFrame, columns: list[str], order: list[str], n: int) -> DataFrame:
    """The first n rows, in order, all of whose columns are finite."""
    return rows.where(all_finite(columns)).orderBy(*order).limit(n)


def degree_block(lon: Column, lat: Column, size: float) -> Column:
    return (F.floor(lon / size) * 1000 + F.floor(lat / size)).cast("long")


def tile_name(lon: Column, lat: Column, size: int = 1) -> Column:
    """Name of the tile that holds a place, by its south-west corner."""
    part = lambda v, minus, plus, width: F.concat(F.when(v < 0, minus).otherwise(plus), F.lpad(F.abs(v).cast("string"), width, "0"))
    corner = lambda v: F.floor(v / size) * size
    return F.concat(part(corner(lat), "S", "N", 2), part(corner(lon), "W", "E", 3))


def tiles_in(spark: SparkSession, box: tuple[float, float, float, float], pad: float = 0.0) -> DataFrame:
    """lon, lat and tile of all one-degree tiles that a padded box touches."""
    span = lambda a, b: F.explode(F.sequence(F.floor(F.lit(a - pad)).cast("long"), F.floor(F.lit(b + pad)).cast("long")))
    every = spark.range(1).select(span(box[0], box[2]).alias("lon")).select("lon", span(box[1], box[3]).alias("lat"))
    return every.withColumn("tile", tile_name(F.col("lon"), F.col("lat")))


def mesh(spark: SparkSession, box: tuple[float, float, float, float], step: float) -> DataFrame:
    """id, x and y: centres of the square cells of that step, row by row from the south-west."""
    columns, rows = (max(0, -int(-(b - a) // step)) for a, b in ((box[0], box[2]), (box[1], box[3])))
    at = spark.range(columns * rows)
    return at.select("id", (box[0] + (F.col("id") % columns + 0.5) * step).alias("x"), (box[1] + (F.floor(F.col("id") / max(columns, 1)) + 0.5) * step).alias("y"))


def sample(points: DataFrame, raster: DataFrame, values: list[str], x0: float, y0: float, size: float, truncate: bool = False, keys: tuple[str, ...] = ()) -> DataFrame:
    """points with the values of the cells (r, c) that they lie in, missing beyond the raster.

    With truncate, places are cut towards zero, so those just before the edge fall into the first cell.
    keys (such as a tile) must agree too; a raster of many tiles is joined, not loaded tile by tile.
    """
    at = lambda k, o: ((F.col(k) - o) / size).cast("long") if truncate else F.floor((F.col(k) - o) / size).cast("long")
    placed = points.withColumns({"r": at("y", y0), "c": at("x", x0)})
    return placed.join(raster.select("r", "c", *keys, *values), ["r", "c", *keys], "left").drop("r", "c")


def layer_report(rows: DataFrame, layers: list[str]) -> DataFrame:
    """layer, least, most and share of missing values of each layer, in one pass."""
    parts = F.explode(F.array(*[F.struct(F.lit(c).alias("layer"), finite(F.col(c)).alias("v")) for c in layers]))
    each = rows.select(parts.alias("p")).select("p.*")
    return each.groupBy("layer").agg(F.min("v").alias("least"), F.max("v").alias("most"), F.avg(F.col("v").isNull().cast("int")).alias("missing"))


def covered(rows: DataFrame, columns: list[str], label: str = "presence") -> DataFrame:
    """Share of presence and of background rows with all columns finite."""
    valid = all_finite(columns).cast("int")
    return rows.agg(F.avg(F.when(F.col(label) == 1, valid)).alias("of_presence"), F.avg(F.when(F.col(label) == 0, valid)).alias("of_background"))


def background_of(points: DataFrame, key: str, columns: list[str], n: int, seed: int) -> DataFrame:
    """n of the observed points whose columns are finite, in random order."""
    return points.where(all_finite(columns)).orderBy(random_order(seed, F.col(key)), key).limit(n)


def uniform_background(spark: SparkSession, n: int, box: tuple[float, float, float, float], seed: int, keep, columns: list[str], times: int = 3) -> DataFrame:
    """The first n of times n evenly drawn points that are finite in the columns which keep(points) adds."""
    return first_valid(keep(uniform_points(spark, times * n, box, seed)), columns, ["id"], n)


def metrics_table(rows: DataFrame, keys: list[str], value: str, digits: int = 2) -> DataFrame:
    """keys, mean, std and text, the two as one."""
    out = rows.groupBy(*keys).agg(F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"))
    return out.withColumn("text", F.format_string(f"%.{digits}f ± %.{digits}f", F.col("mean"), F.coalesce("std", F.lit(0.0))))


def report_lines(report: DataFrame) -> DataFrame:
    """One line of text for each row of a layer report."""
    return report.select("layer", F.format_string("| %s | %.3f | %.3f | %.1f%% |", "layer", "least", "most", F.col("missing") * 100).alias("line"))


def write_table(rows: DataFrame, path: str, form: str = "parquet") -> None:
    """A table as Parquet, or as gzipped CSV with a header."""
    if form not in ("parquet", "csv"):
        raise ValueError(f"unknown form: {form}")
    writer = rows.write.mode("overwrite")
    writer.parquet(path) if form == "parquet" else writer.option("header", True).option("compression", "gzip").csv(path)
