"""Deterministic sampling, folds and resampling: every random order is an order by md5 of seed and key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def random_order(seed: int, *keys: Column) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[k.cast("string") for k in keys]).cast("binary"))


def random_index(seed: int, n: int, *keys: Column) -> Column:
    """Number from 0 to n - 1."""
    return F.conv(F.substring(random_order(seed, *keys), 1, 8), 16, 10).cast("long") % n


def presence_background(cells: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """All cells of presence 1, and n of the others; the draw itself is the limit."""
    background = cells.where("presence = 0").orderBy(random_order(seed, F.col(key)), key).limit(n)
    return cells.where("presence = 1").unionByName(background)


def first_in_group(rows: DataFrame, keys: list[str], order: list[Column], n: int, parts: int = 64) -> DataFrame:
    """The first n rows of each group in ascending order; groups are cut into parts first, so that a large one isn't sorted by one task."""
    at = lambda *by: F.row_number().over(Window.partitionBy(*by).orderBy(*[F.col(f"_o{i}") for i in range(len(order))]))
    placed = rows.withColumns({f"_o{i}": o for i, o in enumerate(order)}).withColumn("_part", F.pmod(F.xxhash64(*[F.col(f"_o{i}") for i in range(len(order))]), F.lit(parts)))
    few = placed.withColumn("_at", at(*keys, "_part")).where(F.col("_at") <= n)
    return few.withColumn("_at", at(*keys)).where(F.col("_at") <= n).select(*rows.columns)


def folds(blocks: DataFrame, n: int, seed: int) -> DataFrame:
    """block and fold: blocks in random order, dealt round; one row per block."""
    order = Window.orderBy(random_order(seed, F.col("block")), "block")
    return blocks.select("block").distinct().withColumn("fold", ((F.row_number().over(order) - 1) % n).cast("int"))


def bootstrap_means(pairs: DataFrame, key: str, value: str, draws: int, seed: int) -> DataFrame:
    """draw and mean of as many values as there are, drawn with replacement; null means where there are none. pairs is one row per fold or seed."""
    placed = pairs.select((F.row_number().over(Window.orderBy(key)) - 1).alias("at"), F.col(value).alias("v"))
    n = placed.count()
    if not n:
        return pairs.sparkSession.range(draws).select(F.col("id").alias("draw"), F.lit(None).cast("double").alias("mean"))
    drawn = pairs.sparkSession.range(draws).withColumnRenamed("id", "draw").withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    drawn = drawn.withColumn("at", random_index(seed, n, F.col("draw"), F.col("j")))
    return drawn.join(placed, "at").groupBy("draw").agg(F.avg("v").alias("mean"))


def seeded_folds(blocks: DataFrame, n: int, seeds: list[int]) -> DataFrame:
    """block, seed and fold: for every seed its own random order of the blocks, dealt round."""
    each = blocks.select("block").distinct().withColumn("seed", F.explode(F.array(*[F.lit(s) for s in seeds])))
    order = F.md5(F.concat_ws(":", F.col("seed").cast("string"), F.col("block").cast("string")).cast("binary"))
    dealt = F.row_number().over(Window.partitionBy("seed").orderBy(order, "block"))  # a row per block
    return each.withColumn("fold", ((dealt - 1) % n).cast("int"))


def group_folds(cells: DataFrame, n: int, label: str | None = None) -> DataFrame:
    """block and fold of like sizes: blocks by size (by positives first, with a label), dealt there and back; one row per block.

    No block is split, and with n blocks or more no fold is empty.
    """
    positives = F.sum(F.col(label).cast("long")) if label else F.lit(0)
    sized = cells.groupBy("block").agg(positives.alias("p"), F.count(F.lit(1)).alias("k"))
    at = F.row_number().over(Window.orderBy(F.col("p").desc(), F.col("k").desc(), "block")) - 1
    turn = at % (2 * n)
    return sized.select("block", F.when(turn < n, turn).otherwise(2 * n - 1 - turn).cast("int").alias("fold"))


def uniform_points(spark: SparkSession, n: int, box: tuple[float, float, float, float], seed: int) -> DataFrame:
    """id, x and y of n points drawn evenly from the box (x0, y0, x1, y1)."""
    x0, y0, x1, y1 = box
    at = lambda axis: random_index(seed, 1 << 32, F.col("id"), F.lit(axis)) / float(1 << 32)
    return spark.range(n).select("id", (x0 + (x1 - x0) * at("x")).alias("x"), (y0 + (y1 - y0) * at("y")).alias("y"))


def paired_comparison(pairs: DataFrame, keys: list[str], a: str, b: str, draws: int, seed: int) -> DataFrame:
    """n, mean_a, mean_b, diff, its 95 % interval (low, high), win_rate of b and whether the interval leaves out 0.

    pairs is one row per fold and seed, the same folds for both models.
    """
    diff = pairs.select(F.concat_ws(":", *[F.lpad(F.col(k).cast("string"), 12, "0") for k in keys]).alias("at"), F.col(a).alias("a"), F.col(b).alias("b"), (F.col(b) - F.col(a)).alias("d"))
    drawn = bootstrap_means(diff, "at", "d", draws, seed)
    ends = drawn.agg(F.percentile("mean", 0.025).alias("low"), F.percentile("mean", 0.975).alias("high"))  # draws values
    whole = diff.agg(F.count("d").alias("n"), F.avg("a").alias("mean_a"), F.avg("b").alias("mean_b"), F.avg("d").alias("diff"), F.avg((F.col("d") > 0).cast("int")).alias("win_rate"))
    return whole.crossJoin(F.broadcast(ends)).withColumn("significant", (F.col("low") > 0) | (F.col("high") < 0))
