"""Grids, points and segments derived from the relational test tables by integer arithmetic."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SIDE = 40
RELIEF_COLUMNS = 100


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A round grid: r, c and averages of the order lines that fall into the cell."""
    lines = table(spark, sf_dir, "lineitem")
    r = (F.col("l_orderkey") * 7 + F.col("l_linenumber") * 3) % SIDE
    c = (F.col("l_partkey") * 11 + F.col("l_suppkey")) % SIDE
    grid = lines.select(r.alias("r"), c.alias("c"), "l_quantity", "l_extendedprice", "l_discount", "l_tax")
    grid = grid.where((F.col("r") - 20) * (F.col("r") - 20) + (F.col("c") - 20) * (F.col("c") - 20) <= 361)
    # whole hundredths, so that the average is the same in whatever order the rows come
    mean = lambda k: F.expr(f"(sum(cast(round({k} * 100) AS bigint)) * 100 div count(1)) / 10000D")
    return grid.groupBy("r", "c").agg(
        mean("l_quantity").alias("q"), mean("l_extendedprice").alias("p"), mean("l_discount").alias("d"), mean("l_tax").alias("t"), F.max("l_quantity").alias("mq"), F.min("l_extendedprice").alias("mp"), F.count(F.lit(1)).alias("n")
    )


def raster(spark: SparkSession, sf_dir: str) -> DataFrame:
    """r, c and v, which is missing in every seventeenth cell."""
    return cells(spark, sf_dir).select("r", "c", F.when((F.col("r") * SIDE + F.col("c")) % 17 != 0, F.col("p")).alias("v"))


def full_raster(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A raster of RELIEF_COLUMNS columns without gaps, one pixel an order, whose rows grow with the orders."""
    at = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(F.floor(at / RELIEF_COLUMNS).cast("long").alias("r"), (at % RELIEF_COLUMNS).alias("c"), F.floor(F.col("o_totalprice") / 1000).cast("double").alias("v"))


def occurrences(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    x = (F.col("o_orderkey") * 7919 + F.col("o_custkey") * 104729) % 20000
    y = (F.col("o_orderkey") * 15485863 + F.col("o_custkey") * 32452843) % 20000
    return o.select(F.col("o_orderkey").alias("id"), x.alias("x"), y.alias("y"), F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("price"))


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier").withColumns({"k": F.col("s_suppkey"), "n": F.col("s_nationkey").cast("long")})
    s = s.withColumns({"x1": (F.col("k") * 6151) % 20000, "y1": (F.col("k") * 3079 + F.col("n") * 1543) % 20000})
    return s.select(F.col("k").alias("geom_id"), "x1", "y1", (F.col("x1") + 500 + (F.col("k") * 389) % 3000).alias("x2"), (F.col("y1") - 1500 + (F.col("k") * 769) % 3000).alias("y2"))


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("n_nationkey").cast("long")
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("geom_id"), ((k % 5) * 4000 + 300).alias("x0"), (F.floor(k / 5) * 4000 + 300).cast("long").alias("y0"), k.alias("k"))
    return n.select("geom_id", "x0", "y0", (F.col("x0") + 1000 + (F.col("k") * 37) % 2000).alias("x1"), (F.col("y0") + 1000 + (F.col("k") * 53) % 2000).alias("y1"))


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """cell_id, f0 to f12, presence and block."""
    e = table(spark, sf_dir, "embeddings")
    parts = [F.col("embedding")[i].cast("double").alias(f"f{i}") for i in range(13)]
    return e.select(F.col("vec_id").alias("cell_id"), *parts, (F.col("label") == 3).cast("int").alias("presence"), (F.col("vec_id") % 20).alias("block"))
