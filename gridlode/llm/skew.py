"""Joins of hot keys: their rows are dealt over several tasks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridlode.plans.materialize import shuffle_partitions

#: A key is hot beyond this share of the rows of a task of even load; fewer rows than LEAST are never hot.
TASK_SHARE, LEAST = 0.25, 512
#: At most so many keys can be hot, as each holds at least this part of all rows.
MOST_HOT = 20_000


class Dealt:
    """A frame whose rows of hot keys are dealt over tasks by the column `by`, to be joined on those keys.

    The frame is read once more, to find its hot keys, and should be a written table. Those keys
    come to the driver: at most MOST_HOT by their share.
    """

    def __init__(self, big: DataFrame, keys: list[str], by: Column) -> None:
        self.big, self.keys, spark = big, keys, big.sparkSession
        counted = big.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
        total = big.count()
        even = max(LEAST, int(TASK_SHARE * total / shuffle_partitions(spark)), total // MOST_HOT)
        hot = counted.where(F.col("_n") > even).select(*keys, F.ceil(F.col("_n") / even).cast("int").alias("_deals"))
        rows = hot.collect() if total > LEAST else []
        self.table = F.broadcast(spark.createDataFrame(rows, hot.schema)) if rows else None
        if rows:
            deal = F.pmod(F.xxhash64(by, F.lit(3)), F.coalesce("_deals", F.lit(1))).cast("int")
            self.big = big.join(self.table, keys, "left").withColumn("_deal", deal).drop("_deals")

    def join(self, small: DataFrame, how: str = "inner") -> DataFrame:
        """Joined with small, whose rows of hot keys are copied to every deal; how is inner, left, left_semi or left_anti."""
        if self.table is None:
            return self.big.join(small, self.keys, how)
        deals = F.sequence(F.lit(0), F.coalesce("_deals", F.lit(1)) - 1)
        copied = small.join(self.table, self.keys, "left").withColumn("_deal", F.explode(deals)).drop("_deals")
        return self.big.join(copied, [*self.keys, "_deal"], how).drop("_deal")


def join_hot(big: DataFrame, small: DataFrame, keys: list[str], by: Column, how: str = "inner") -> DataFrame:
    """big joined with small on keys, as Dealt does."""
    return Dealt(big, keys, by).join(small, how)
