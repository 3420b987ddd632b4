"""Derived features of a cell table and the criterial score."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridlode.functions.numeric import clip01, proximity, quantiles, robust_01, rooted
from gridlode.operators.components import label_zones
from gridlode.operators.grid import smooth
from gridlode.plans.materialize import materialize

#: Root and quantile of the proximity of each factor.
PROXIMITY = {"facies": ("cbrt", 0.78), "paleo": ("cbrt", 0.76), "struct": ("sqrt", 0.72), "magm": ("sqrt", 0.42), "tect1": ("cbrt", 0.74), "tect2": ("cbrt", 0.74)}
#: Factors with wide halos, and root and quantile of those.
WIDE, HALO = ["facies", "struct"], ("sqrt", 0.95)
#: Weight of each factor in the taxonomy distance.
TAXONOMY = {"facies": 0.891, "paleo": 0.923, "struct": 0.849, "magm": 0.493, "tect1": 0.997, "tect2": 1.0}
#: Weights of the local bonus.
LOCAL_BONUS = {"tect_intersection": 0.38, "tect_magm_intersection": 0.37, "tect_struct_intersection": 0.25}


def proximities(cells: DataFrame, distances: dict[str, str]) -> DataFrame:
    """cells with prox_<factor> of every factor, given its distance column."""
    cells = materialize(cells)  # every factor's scale reads all of it
    return cells.withColumns({f"prox_{k}": proximity(cells, F.col(d), *PROXIMITY[k]) for k, d in distances.items()})


def interactions(cells: DataFrame) -> DataFrame:
    """cells with the products and geometric means of proximities, the coincidence score and the unsupported-structure penalty."""
    cells = materialize(cells)  # each scaling below reads all of it
    p = {k: F.col(f"prox_{k}") for k in PROXIMITY}
    out = cells.withColumn("tect_combo", 0.5 * (p["tect1"] + p["tect2"]))
    out = out.withColumns(
        {
            "tect_intersection": p["tect1"] * p["tect2"],
            "tect_magm_intersection": F.sqrt(F.col("tect_combo") * p["magm"]),
            "tect_struct_intersection": F.sqrt(F.col("tect_combo") * p["struct"]),
            "paleo_struct_intersection": F.sqrt(p["paleo"] * p["struct"]),
        }
    )
    core = clip01(F.col("tect_combo")) * clip01(0.55 * p["magm"] + 0.45 * p["struct"]) * clip01(0.60 * p["paleo"] + 0.40 * p["facies"])
    bare = clip01(F.col("tect_combo") - (0.40 * p["magm"] + 0.35 * p["struct"] + 0.25 * p["paleo"]))
    out = materialize(out.withColumns({"_core": F.sqrt(clip01(core)), "_bare": bare}))
    return out.withColumns({"coincidence_score": robust_01(out, F.col("_core"), 0.02, 0.98), "tect_only_penalty": robust_01(out, F.col("_bare"), 0.02, 0.98)}).drop("_core", "_bare")


def local_bonus(cells: DataFrame) -> Column:
    return robust_01(cells, sum((w * F.col(c) for c, w in LOCAL_BONUS.items()), F.lit(0.0)), 0.02, 0.98)


def taxonomy_score(cells: DataFrame, distances: dict[str, str]) -> DataFrame:
    """cells with taxonomy_distance (weighted distance from the least of all factors) and geo_score (1 is best)."""
    roots = {k: rooted(F.col(d), PROXIMITY[k][0]) for k, d in distances.items()}
    ranges = cells.agg(*[f(v).alias(f"{n}_{k}") for k, v in roots.items() for n, f in (("lo", F.min), ("hi", F.max))]).first()
    total = F.lit(0.0)
    for k, v in roots.items():
        lo, hi = ranges[f"lo_{k}"], ranges[f"hi_{k}"]
        total = total + (TAXONOMY[k] * (v - lo) / (hi - lo) if lo is not None and hi > lo else F.lit(0.0))
    weighed = cells.withColumn("_c", total)
    mean, spread = weighed.agg(F.avg("_c"), F.stddev_pop("_c")).first()
    out = weighed.withColumn("taxonomy_distance", F.col("_c") / F.lit((mean or 0.0) + 2.0 * (spread or 0.0))).drop("_c")
    return out.withColumn("geo_score", robust_01(out, -F.col("taxonomy_distance"), 0.02, 0.98))


def smoothed_geo_score(scored: DataFrame, rows: int, columns: int, passes: int = 2) -> DataFrame:
    """scored cells (r, c, geo_score) with geo_score_sm, the smoothed score scaled by quantiles again."""
    smoothed = materialize(smooth(scored.select("r", "c", "geo_score"), "geo_score", rows, columns, passes))
    return scored.join(smoothed.select("r", "c", robust_01(smoothed, F.col("geo_score"), 0.02, 0.98).alias("geo_score_sm")), ["r", "c"])


def halo_proximities(cells: DataFrame, distances: dict[str, str]) -> DataFrame:
    """cells with halo_<factor>: a proximity that reaches far, of the factors that have wide halos."""
    cells = materialize(cells)
    return cells.withColumns({f"halo_{k}": proximity(cells, F.col(distances[k]), *HALO) for k in WIDE})


def prospectivity(cells: DataFrame, score: str, rows: int, columns: int) -> DataFrame:
    """cells (r, c) with prospectivity, the twice smoothed score scaled by quantiles, and prognoz, its complement."""
    smoothed = materialize(smooth(cells, score, rows, columns, 2))
    out = cells.join(smoothed.select("r", "c", robust_01(smoothed, F.col(score), 0.02, 0.98).alias("prospectivity")), ["r", "c"])
    return out.withColumn("prognoz", 1.0 - F.col("prospectivity"))


def gold_zones(cells: DataFrame, score: str, magm: str, coincidence: str, columns: int, share: float = 0.98, least_cells: int = 4, most: int = 30) -> DataFrame:
    """r, c, zone and rank of the strongest zones of cells in the top share; strength favours cells where factors meet."""
    limit = quantiles(cells, F.col(score), [share])[0]
    strength = F.col(score) * (0.5 + 0.5 * F.col(magm) + 0.5 * F.col(coincidence))
    top = materialize(cells.where(F.col(score) >= limit).select("r", "c", strength.alias("strength")))
    labelled = materialize(label_zones(top, columns))
    zones = labelled.groupBy("zone").agg(F.count(F.lit(1)).alias("cells"), F.sum("strength").alias("total")).where(F.col("cells") >= least_cells)
    best = zones.orderBy(F.round("total", 6).desc(), F.col("zone").desc()).limit(most)
    ranked = best.withColumn("rank", F.row_number().over(Window.orderBy(F.round("total", 6).desc(), F.col("zone").desc())))  # most rows at most
    return labelled.join(F.broadcast(ranked.select("zone", "rank")), "zone").select("r", "c", "zone", "rank")
