"""Scores of rankings: coverage and lift of top areas, AUC, average precision, the criterial index."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridlode.functions.numeric import quantiles
from gridlode.plans.materialize import materialize


def top_area(scored: DataFrame, areas: list[float], score: str = "score", label: str = "presence", background_only: bool = False) -> DataFrame:
    """area, cells, hits, coverage and lift of the cells whose score reaches the area's threshold.

    The threshold is a quantile of all scores, or of the background's; ties at it belong to the area.
    """
    over = scored.where(F.col(label) == 0) if background_only else scored
    limits = quantiles(over, F.col(score), [1.0 - a for a in areas])
    table = F.array(*[F.struct(F.lit(a).alias("area"), F.lit(t).cast("double").alias("limit")) for a, t in zip(areas, limits, strict=True)])
    each = scored.select(F.col(score).alias("s"), F.col(label).alias("y"), F.explode(table).alias("a"))
    reached = F.coalesce(F.col("s") >= F.col("a.limit"), F.lit(False))
    hits = F.sum(F.when(reached & (F.col("y") == 1), 1).otherwise(0))
    coverage = hits / F.sum(F.when(F.col("y") == 1, 1).otherwise(0))
    found = each.groupBy(F.col("a.area").alias("area")).agg(F.sum(reached.cast("long")).alias("cells"), hits.alias("hits"), coverage.alias("coverage"))
    return found.withColumn("lift", F.col("coverage") / F.col("area"))


def by_score(scored: DataFrame, score: str, label: str) -> DataFrame:
    """Positives and negatives of each distinct score, and those of higher scores.

    Prefix sums run over distinct scores: per bucket of scores first, then within each bucket.
    """
    counted = scored.groupBy(F.col(score).alias("s")).agg(F.sum((F.col(label) == 1).cast("long")).alias("pos"), F.sum((F.col(label) == 0).cast("long")).alias("neg"))
    edges = counted.agg(F.percentile_approx("s", [i / 64 for i in range(1, 64)], 1000)).first()[0] or []
    bucket = sum((F.when(F.col("s") > e, 1).otherwise(0) for e in sorted(set(edges))), F.lit(0))
    counted = counted.withColumn("bucket", bucket)
    whole = counted.groupBy("bucket").agg(F.sum("pos").alias("bp"), F.sum("neg").alias("bn"))
    later = Window.orderBy(F.col("bucket").desc()).rowsBetween(Window.unboundedPreceding, -1)  # 64 rows at most
    whole = whole.select("bucket", F.coalesce(F.sum("bp").over(later), F.lit(0)).alias("bp"), F.coalesce(F.sum("bn").over(later), F.lit(0)).alias("bn"))
    inner = Window.partitionBy("bucket").orderBy(F.col("s").desc()).rowsBetween(Window.unboundedPreceding, -1)
    joined = counted.join(F.broadcast(whole), "bucket")
    return joined.select("s", "pos", "neg", (F.col("bp") + F.coalesce(F.sum("pos").over(inner), F.lit(0))).alias("pos_above"), (F.col("bn") + F.coalesce(F.sum("neg").over(inner), F.lit(0))).alias("neg_above"))


def binary_metrics(scored: DataFrame, score: str = "score", label: str = "presence") -> DataFrame:
    """auc (ties count half), average_precision, and the mean score of each class; null where a class is missing."""
    t = by_score(scored, score, label)
    pairs = F.sum(F.col("neg") * (F.col("pos_above") + 0.5 * F.col("pos")))
    precision = (F.col("pos_above") + F.col("pos")) / (F.col("pos_above") + F.col("pos") + F.col("neg_above") + F.col("neg"))
    means = [F.try_divide(F.sum(F.col("s") * F.col(c)), F.sum(c)) for c in ("pos", "neg")]
    return t.agg(
        F.try_divide(pairs, F.sum("pos") * F.sum("neg").cast("double")).alias("auc"),
        F.try_divide(F.sum(F.col("pos") * precision), F.sum("pos")).alias("average_precision"),
        means[0].alias("mean_positive"),
        means[1].alias("mean_negative"),
    )


def criterial(train: DataFrame, columns: list[str], label: str = "presence") -> Column:
    """Mean of standardised columns, each with the sign of its correlation with the label in the training rows; 0 where that isn't known."""
    y = F.col(label).cast("double")
    sums = [f.alias(f"{n}{i}") for i, c in enumerate(columns) for n, f in (("m", F.avg(c)), ("s", F.stddev_pop(c)), ("x", F.avg(F.col(c) * y)))]
    got = train.agg(F.avg(y).alias("y"), *sums).first()
    total = F.lit(0.0)
    for i, c in enumerate(columns):
        m, s, x = got[f"m{i}"], got[f"s{i}"], got[f"x{i}"]
        if None in (m, s, x, got["y"]):  # no rows, or only missing values
            continue
        covariance = x - m * got["y"]
        sign = 0.0 if abs(covariance) < 1e-12 else (1.0 if covariance > 0 else -1.0)
        total = total + sign * (F.col(c) - m) / (s + 1e-9)
    return total / len(columns)


def percentile_rank(scored: DataFrame, score: str, key: str) -> DataFrame:
    """scored with rank01, from 0 to 1; equal scores are ranked by key. All rows are one group of rank_within."""
    return rank_within(scored.withColumn("_all", F.lit(0)), ["_all"], score, key).drop("_all")


def grouped_quantiles(rows: DataFrame, keys: list[str], value: str, shares: list[float]) -> DataFrame:
    """keys, share and limit: linear-interpolated exact quantiles of every group, whatever its size.

    The rows are sorted in ranges; a row's rank is its place in the range plus the rows of its group in earlier ranges.
    """
    held = rows.where(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("_v"))
    ranged = materialize(held.repartitionByRange(*keys, "_v").withColumn("_part", F.spark_partition_id()))
    sizes = ranged.groupBy(*keys, "_part").agg(F.count(F.lit(1)).alias("_k"))  # one row per group and range
    group = Window.partitionBy(*keys)
    before = sizes.withColumns({"_n": F.sum("_k").over(group), "_before": F.coalesce(F.sum("_k").over(group.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))})
    at = F.row_number().over(Window.partitionBy(*keys, "_part").orderBy("_v")) - 1
    ranked = ranged.withColumn("_at", at).join(before.drop("_k"), [*keys, "_part"]).withColumn("_at", F.col("_at") + F.col("_before"))
    each = ranked.withColumn("share", F.explode(F.array(*[F.lit(float(s)) for s in shares])))
    rank = F.col("share") * (F.col("_n") - 1)
    ends = each.where((F.col("_at") == F.floor(rank)) | (F.col("_at") == F.ceil(rank)))
    lo, hi = F.min("_v"), F.max("_v")
    return ends.groupBy(*keys, "share").agg((lo + (hi - lo) * F.max(rank - F.floor(rank))).alias("limit"))


def criterial_by_fold(cells: DataFrame, columns: list[str], n: int, label: str = "presence", seed: str = "seed", fold: str = "fold") -> DataFrame:
    """cells with score: the criterial index of each row, learnt per seed from the rows of all other folds. All folds are one job."""
    y = F.col(label).cast("double")
    sums = [f.alias(f"_{k}{i}") for i, c in enumerate(columns) for k, f in (("m", F.avg(c)), ("s", F.stddev_pop(c)), ("x", F.avg(F.col(c) * y)))]
    others = cells.withColumn("_of", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).where(F.col("_of") != F.col(fold))
    learnt = others.groupBy(seed, F.col("_of").alias(fold)).agg(F.avg(y).alias("_y"), *sums)
    total = F.lit(0.0)
    for i, c in enumerate(columns):
        covariance = F.col(f"_x{i}") - F.col(f"_m{i}") * F.col("_y")
        sign = F.when(F.abs(covariance) < 1e-12, 0.0).otherwise(F.signum(covariance))
        total = total + sign * (F.col(c) - F.col(f"_m{i}")) / (F.col(f"_s{i}") + 1e-9)
    # learnt has one row per seed and fold; Spark broadcasts it if it is small
    return cells.join(learnt, [seed, fold]).select(*cells.columns, (total / len(columns)).alias("score"))


def top_area_by_group(scored: DataFrame, keys: list[str], areas: list[float], score: str = "score", label: str = "presence") -> DataFrame:
    """keys, area, coverage and lift within each group; groups without presence are left out."""
    limits = grouped_quantiles(scored, keys, score, [1.0 - a for a in areas])
    table = F.create_map(*[F.lit(v) for a in areas for v in (1.0 - a, a)])
    limits = limits.withColumn("area", table[F.col("share")])  # a row per group and area
    hit = F.sum(F.when(F.col(score) >= F.col("limit"), 1).otherwise(0))
    found = scored.where(F.col(label) == 1).join(limits, keys).groupBy(*keys, "area").agg((hit / F.count(F.lit(1))).alias("coverage"))
    return found.withColumn("lift", F.col("coverage") / F.col("area"))


def rank_within(scored: DataFrame, keys: list[str], score: str, key: str) -> DataFrame:
    """scored with rank01 from 0 to 1 within each group, equal scores ranked by key; ranges as in grouped_quantiles."""
    ranged = materialize(scored.repartitionByRange(*keys, score, key).withColumn("_part", F.spark_partition_id()))
    group = Window.partitionBy(*keys)
    sizes = ranged.groupBy(*keys, "_part").agg(F.count(F.lit(1)).alias("_k"))
    before = sizes.select(*keys, "_part", F.sum("_k").over(group).alias("_n"), F.coalesce(F.sum("_k").over(group.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    at = F.row_number().over(Window.partitionBy(*keys, "_part").orderBy(score, key)) - 1
    ranked = ranged.withColumn("_at", at).join(before, [*keys, "_part"])
    return ranked.select(*scored.columns, ((F.col("_at") + F.col("_before")) / F.greatest(F.col("_n") - 1, F.lit(1))).alias("rank01"))


def top_mask(scored: DataFrame, score: str, share: float) -> Column:
    """Whether a score reaches the quantile 1 - share of all; missing scores never do."""
    limit = quantiles(scored, F.col(score), [1.0 - share])[0]
    return F.coalesce(F.col(score) >= limit, F.lit(False)) if limit is not None else F.lit(False)


def scores_at(points: DataFrame, scored: DataFrame, keys: list[str], score: str, share: float) -> DataFrame:
    """points, all of them, with score and hit: whether the score of their cell is among the top share of all cells."""
    marked = scored.select(*keys, score, top_mask(scored, score, share).alias("hit"))
    return points.join(marked, keys, "left").withColumn("hit", F.coalesce("hit", F.lit(False)))


def point_coverage(points: DataFrame, scored: DataFrame, keys: list[str], score: str, share: float = 0.15) -> DataFrame:
    """points, hits and coverage: the share of points in the top share of all cells, null without points."""
    found = scores_at(points, scored, keys, score, share).agg(F.count(F.lit(1)).alias("points"), F.coalesce(F.sum(F.col("hit").cast("long")), F.lit(0)).alias("hits"))
    return found.withColumn("coverage", F.try_divide("hits", "points"))


def with_enough(rows: DataFrame, keys: list[str], least_rows: int = 30, least_presence: int = 5, label: str = "presence") -> DataFrame:
    """Only the groups with so many rows and so much presence; both are counted in one pass."""
    sizes = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.sum(F.col(label)).alias("_p"))
    return rows.join(sizes.where((F.col("_n") >= least_rows) & (F.col("_p") >= least_presence)).select(*keys), keys, "left_semi")
