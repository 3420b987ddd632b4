"""Connected zones of marked grid cells, eight neighbours each."""

from __future__ import annotations

from itertools import product

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridlode.operators.grid import scattered
from gridlode.plans.materialize import materialize


def label_zones(cells: DataFrame, columns: int) -> DataFrame:
    """cells (r, c) with zone, the least r * columns + c of the cells connected with it.

    Labels spread to neighbours and then jump to their label's label, so long zones take few rounds.
    """
    around = dict.fromkeys(product((-1, 0, 1), repeat=2), 1.0)
    own = F.col("r") * columns + F.col("c")
    held = materialize(cells.select("r", "c", own.alias("id"), own.alias("zone")))
    while True:
        least = scattered(held, "zone", around).groupBy("r", "c").agg(F.min("v").alias("zone"))
        spread = held.select("r", "c", "id").join(least, ["r", "c"])
        jump = spread.select(F.col("id").alias("_of"), F.col("zone").alias("_further"))
        new = materialize(spread.join(jump, F.col("zone") == F.col("_of"), "left").select("r", "c", "id", F.least("zone", "_further").alias("zone")))
        moved = new.join(held.select("id", F.col("zone").alias("old")), "id").where("zone <> old").limit(1).count()
        held = new
        if not moved:
            return cells.join(held.select("r", "c", "zone"), ["r", "c"])


def strongest_zones(cells: DataFrame, strength: str, columns: int, least_cells: int, most: int) -> DataFrame:
    """The strongest zones by summed strength: zone, cells and strength. The number of zones is what is asked for."""
    zones = label_zones(cells, columns).groupBy("zone").agg(F.count(F.lit(1)).alias("cells"), F.sum(strength).alias("strength"))
    return zones.where(F.col("cells") >= least_cells).orderBy(F.round("strength", 6).desc(), F.col("zone").desc()).limit(most)


def keep_large(cells: DataFrame, columns: int, least_cells: int) -> DataFrame:
    """The cells of zones of so many cells at least, with zone and cells, the zone's size."""
    zones = label_zones(cells, columns)
    large = zones.groupBy("zone").agg(F.count(F.lit(1)).alias("cells")).where(F.col("cells") >= least_cells)
    return zones.join(large, "zone").select(*cells.columns, "zone", "cells")


def zone_count(cells: DataFrame, columns: int) -> DataFrame:
    """zones and cells: how many there are."""
    return label_zones(cells, columns).agg(F.countDistinct("zone").alias("zones"), F.count(F.lit(1)).alias("cells"))
