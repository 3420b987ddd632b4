"""Honest validation: folds by the greedy rules, cross-validation of any scorer, permutations, resampled lifts, halos."""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from functools import reduce
from itertools import product

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridlode.functions.numeric import quantiles
from gridlode.operators import metrics, models, sampling
from gridlode.operators.grid import disc, scattered
from gridlode.plans.materialize import materialize

#: A scorer takes training rows and cells, and gives the cells with score.
Scorer = Callable[[DataFrame, DataFrame], DataFrame]
#: Folds are dealt by a greedy rule on the driver, one row per block, up to so many blocks.
MOST_BLOCKS = 100_000


def greedy_folds(cells: DataFrame, n: int, label: str | None = None) -> DataFrame:
    """block and fold: the largest block goes to the lightest fold, and so on.

    With a label, blocks whose classes are least even come first, and each goes where the folds' shares of the classes
    differ least. Ties go to the block with the least number and to the first fold.
    """
    positives = F.sum((F.col(label) == 1).cast("long")) if label else F.lit(0).cast("long")
    blocks = cells.groupBy("block").agg(F.count(F.lit(1)).alias("n"), positives.alias("p"))
    if blocks.count() > MOST_BLOCKS:
        raise ValueError(f"more than {MOST_BLOCKS} blocks; use larger ones")
    rows = [(r["block"], r["n"], r["p"]) for r in blocks.collect()]
    dealt = []
    if label is None:
        loads = [0] * n
        for block, size, _ in sorted(rows, key=lambda b: (-b[1], b[0])):
            k = loads.index(min(loads))
            loads[k] += size
            dealt.append((block, k))
    else:
        totals = [max(1, sum(s - p for _, s, p in rows)), max(1, sum(p for _, _, p in rows))]
        counts = [[0, 0] for _ in range(n)]

        def uneven(k: int, own: tuple[int, int]) -> float:
            """Spread of the classes' shares over the folds if the block went to fold k."""
            spread = 0.0
            for j, total in enumerate(totals):
                shares = [(c[j] + (own[j] if i == k else 0)) / total for i, c in enumerate(counts)]
                mean = sum(shares) / n
                spread += (sum((x - mean) ** 2 for x in shares) / n) ** 0.5
            return round(spread, 12)

        for block, size, p in sorted(rows, key=lambda b: (-abs(b[1] - 2 * b[2]), b[0])):
            own = (size - p, p)
            k = min(range(n), key=lambda i: (uneven(i, own), sum(counts[i]), i))
            counts[k] = [a + b for a, b in zip(counts[k], own, strict=True)]
            dealt.append((block, k))
    return cells.sparkSession.createDataFrame(dealt, f"block {cells.schema['block'].dataType.simpleString()}, fold int")


def criterial_scorer(columns: list[str]) -> Scorer:
    return lambda train, cells: cells.withColumn("score", metrics.criterial(train, columns))


def model_scorer(estimator: models.Estimator) -> Scorer:
    return lambda train, cells: models.fit_score(estimator, train, cells)


def ensemble_scorer(key: str, columns: list[str], **sizes: int) -> Scorer:
    return lambda train, cells: cells.join(models.ensemble(train, key, columns, score_on=cells, **sizes).select(key, "score"), key)


def one_fold(cells: DataFrame, fold: int, key: str, scorer: Scorer, background: int, seed: int) -> DataFrame:
    """All cells, scored by what was learnt from the other folds' presence and a background drawn from them.

    The draw depends on seed and fold alone, so two scorers of a pair learn from the same rows.
    """
    return scorer(sampling.presence_background(cells.where(F.col("fold") != fold), key, background, seed * 1000 + fold), cells)


def area_coverage(scored: DataFrame, chosen, areas: list[float], score: str = "score") -> DataFrame:
    """area, coverage and lift of the chosen rows; thresholds are over all rows. Without a chosen row, none."""
    limits = quantiles(scored, F.col(score), [1.0 - a for a in areas])
    table = F.array(*[F.struct(F.lit(a).alias("area"), F.lit(t).cast("double").alias("limit")) for a, t in zip(areas, limits, strict=True)])
    each = scored.where(chosen).select(F.col(score).alias("s"), F.explode(table).alias("a"))
    hit = F.coalesce(F.col("s") >= F.col("a.limit"), F.lit(False)).cast("int")
    return each.groupBy("a.area").agg(F.avg(hit).alias("coverage")).withColumn("lift", F.col("coverage") / F.col("area"))


def cross_validation(cells: DataFrame, key: str, scorers: dict[str, Scorer], areas: list[float], n: int, background: int = 3000, seed: int = 42, threads: int = 4) -> DataFrame:
    """model, fold, area, coverage and lift of every scorer on the held-out presence of each fold (column fold), and of chance.

    Folds without presence are left out. Fits run side by side.
    """
    cells = materialize(cells)
    held = sorted(r["fold"] for r in cells.where("presence = 1").select("fold").distinct().collect())

    def run(job: tuple[str, int]) -> DataFrame:
        name, fold = job
        scored = materialize(one_fold(cells, fold, key, scorers[name], background, seed))
        found = area_coverage(scored, (F.col("fold") == fold) & (F.col("presence") == 1), areas)
        return found.select(F.lit(name).alias("model"), F.lit(fold).alias("fold"), "area", "coverage", "lift")

    with ThreadPoolExecutor(threads) as pool:
        rows = list(pool.map(run, product(scorers, held)))
    chance = cells.sparkSession.createDataFrame([("random", k, float(a), float(a), 1.0) for k in held for a in areas], "model string, fold int, area double, coverage double, lift double")
    return reduce(DataFrame.unionByName, rows, chance)


def permutation_test(cells: DataFrame, key: str, columns: list[str], n: int, area: float, draws: int, seed: int) -> DataFrame:
    """observed, null_mean, null_95 and p_value of the criterial lift over held-out folds (column fold).

    For every draw as many random cells as there are of presence take their place, and all is learnt
    again in every fold. The draw is a key column, so all draws and folds are one job.
    """
    positives = cells.agg(F.sum("presence")).first()[0] or 0
    each = cells.withColumn("seed", F.explode(F.sequence(F.lit(0), F.lit(draws)))).withColumn("_h", sampling.random_index(seed, 1 << 32, F.col("seed"), F.col(key)))
    ranked = metrics.rank_within(each, ["seed"], "_h", key)
    total = cells.count()
    drawn = (F.col("rank01") * max(total - 1, 1) < positives - 0.5).cast("int")
    labelled = ranked.withColumn("presence", F.when(F.col("seed") == 0, F.col("presence")).otherwise(drawn)).drop("rank01", "_h")
    scored = metrics.criterial_by_fold(materialize(labelled), columns, n)
    lifts = materialize(metrics.top_area_by_group(scored, ["seed", "fold"], [area]).groupBy("seed").agg(F.avg("lift").alias("lift")))
    seen = lifts.where("seed = 0").select(F.col("lift").alias("observed"))
    null = lifts.where("seed > 0").crossJoin(F.broadcast(seen))  # one row
    return null.groupBy("observed").agg(F.avg("lift").alias("null_mean"), F.percentile("lift", 0.95).alias("null_95"), F.avg((F.col("lift") >= F.col("observed") - 1e-12).cast("int")).alias("p_value"))


def resampled_lift(scored: DataFrame, key: str, scores: list[str], area: float, draws: int, seed: int, label: str = "presence") -> DataFrame:
    """lift, low and high of the first score, or of what the first gains over the second; thresholds stay, presence is drawn with replacement."""
    hit = [(F.col(s) >= quantiles(scored, F.col(s), [1.0 - area])[0]).cast("double") for s in scores]
    flags = materialize(scored.where(F.col(label) == 1).select(key, ((hit[0] if len(hit) == 1 else hit[0] - hit[1]) / area).alias("v")))
    drawn = sampling.bootstrap_means(flags, key, "v", draws, seed)
    ends = drawn.agg(F.percentile("mean", 0.025).alias("low"), F.percentile("mean", 0.975).alias("high"))
    return flags.agg(F.avg("v").alias("lift")).crossJoin(F.broadcast(ends))  # one row each


def fit_gap(cells: DataFrame, key: str, scorer: Scorer, areas: list[float], background: int = 3000, seed: int = 42) -> DataFrame:
    """area, inside and outside: lift on the presence that was learnt from, and on that held out (fold 0), by one model."""
    scored = materialize(one_fold(cells, 0, key, scorer, background, seed))
    inside = area_coverage(scored, "fold <> 0 AND presence = 1", areas).select("area", F.col("lift").alias("inside"))
    return inside.join(area_coverage(scored, "fold = 0 AND presence = 1", areas).select("area", F.col("lift").alias("outside")), "area")


def halo(cells: DataFrame, radius: int) -> DataFrame:
    """r and c of cells within the radius of presence, those of presence left out."""
    seeds = cells.where("presence = 1").select("r", "c", F.lit(1).alias("one"))
    near = scattered(seeds, "one", disc(radius)).select("r", "c").distinct()
    return near.join(cells, ["r", "c"], "left_semi").join(seeds, ["r", "c"], "left_anti")


def halo_lifts(cells: DataFrame, key: str, scorer: Scorer, areas: list[float], radius: int, background: int = 3000, seed: int = 42) -> DataFrame:
    """fold, area, on_presence and on_halo: lifts of each fold's model on held-out presence and on the halo of it, of which nothing was learnt."""
    out = None
    for fold in sorted(r["fold"] for r in cells.where("presence = 1").select("fold").distinct().collect()):
        around = halo(cells.where(F.col("fold") == fold), radius).withColumn("near", F.lit(True))
        rows = materialize(cells.join(around, ["r", "c"], "left").withColumn("near", F.coalesce("near", F.lit(False))))
        scored = materialize(one_fold(rows, fold, key, scorer, background, seed))
        own = area_coverage(scored, (F.col("fold") == fold) & (F.col("presence") == 1), areas).select("area", F.col("lift").alias("on_presence"))
        one = own.join(area_coverage(scored, F.col("near"), areas).select("area", F.col("lift").alias("on_halo")), "area", "left").withColumn("fold", F.lit(fold))
        out = one if out is None else out.unionByName(one)
    return out


def tune(spark, choices: dict[str, list], evaluate: Callable[..., float], best: int = 3) -> DataFrame:
    """The best settings of all combinations of the choices, by what evaluate(**setting) gives. One row per setting."""
    rows = []
    for values in product(*choices.values()):
        setting = dict(zip(choices, values, strict=True))
        rows.append((", ".join(f"{k}={v}" for k, v in setting.items()), float(evaluate(**setting))))
    return spark.createDataFrame(rows, "setting string, lift double").orderBy(F.col("lift").desc(), "setting").limit(best)


def seed_average(rows: DataFrame, key: str, value: str = "score") -> DataFrame:
    """Mean score of each cell over the seeds."""
    return rows.groupBy(key).agg(F.avg(value).alias(value))


def ensemble_importances(members: list[DataFrame]) -> DataFrame:
    """feature, mean importance over the members, and kept: whether it is above the mean of all."""
    mean = reduce(DataFrame.unionByName, members).groupBy("feature").agg(F.avg("importance").alias("importance"))
    limit = materialize(mean).agg(F.avg("importance").alias("_limit"))
    return mean.crossJoin(F.broadcast(limit)).select("feature", "importance", (F.col("importance") > F.col("_limit")).alias("kept"))
