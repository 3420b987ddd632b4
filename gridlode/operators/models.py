"""Estimators of presence from cell features, on Spark ML. Every model gives score, the probability of presence."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import PolynomialExpansion, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridlode.functions.numeric import quantiles, robust_01
from gridlode.operators.grid import smooth
from gridlode.operators.sampling import first_in_group, presence_background
from gridlode.plans.materialize import materialize

Estimator = Pipeline


def _pipeline(columns: list[str], *stages) -> Estimator:
    return Pipeline(stages=[VectorAssembler(inputCols=columns, outputCol="_raw", handleInvalid="keep"), *stages])


def forest(columns: list[str], trees: int = 100, depth: int = 7, leaf: int = 12, seed: int = 42) -> Estimator:
    return _pipeline(columns, RandomForestClassifier(featuresCol="_raw", labelCol="presence", weightCol="_weight", numTrees=trees, maxDepth=depth, minInstancesPerNode=leaf, featureSubsetStrategy="sqrt", seed=seed))


def boosted(columns: list[str], rounds: int = 40, depth: int = 3, rate: float = 0.05, seed: int = 42) -> Estimator:
    return _pipeline(columns, GBTClassifier(featuresCol="_raw", labelCol="presence", weightCol="_weight", maxIter=rounds, maxDepth=depth, stepSize=rate, subsamplingRate=0.8, seed=seed))


def logistic(columns: list[str], degree: int = 1, penalty: float = 0.01) -> Estimator:
    """Degree 2 adds squares and products, which approximates a maximum-entropy model."""
    expand = [PolynomialExpansion(degree=degree, inputCol="_raw", outputCol="_poly")] if degree > 1 else []
    scale = StandardScaler(withMean=True, withStd=True, inputCol="_poly" if expand else "_raw", outputCol="_scaled")
    return _pipeline(columns, *expand, scale, LogisticRegression(featuresCol="_scaled", labelCol="presence", weightCol="_weight", regParam=penalty))


def balanced(cells: DataFrame) -> DataFrame:
    """cells with weights that make both classes count alike."""
    n, pos = cells.agg(F.count(F.lit(1)), F.sum("presence")).first()
    if not pos or pos == n:
        raise ValueError("both classes are needed")
    return cells.withColumn("_weight", F.when(F.col("presence") == 1, n / (2.0 * pos)).otherwise(n / (2.0 * (n - pos))))


def fit_score(estimator: Estimator, train: DataFrame, cells: DataFrame, name: str = "score") -> DataFrame:
    """cells with the probability of presence under the estimator fitted on train."""
    scored = estimator.fit(balanced(train)).transform(cells)
    return scored.select(*cells.columns, vector_to_array("probability")[1].alias(name))


#: Rows of training that a task of the ensemble's fits has; a fit is hundreds of short jobs, and their tasks cost more than few rows do.
FIT_ROWS = 50_000


def ensemble(cells: DataFrame, key: str, columns: list[str], rounds: int = 8, share: float = 0.7, seed: int = 42, score_on: DataFrame | None = None, threads: int = 8, **sizes: int) -> DataFrame:
    """key, score (mean of all members) and spread, of score_on or else of cells: a forest and boosted trees per round, each on its own share of the background.

    All rounds' backgrounds are drawn in one pass, and rounds run side by side. The rows of a round are written once, in as many
    partitions as they ask for, however many the input has.
    """
    cells = materialize(cells)
    background = cells.where("presence = 0")
    n, positives = cells.agg(F.count(F.lit(1)), F.sum("presence")).first()
    take = max(1, round(share * background.count()))
    parts = -(-min(n, take + (positives or 0)) // FIT_ROWS) or 1
    each = background.withColumn("_round", F.explode(F.sequence(F.lit(0), F.lit(rounds - 1))))
    order = F.md5(F.concat_ws(":", (F.col("_round") + seed).cast("string"), F.col(key).cast("string")).cast("binary"))
    drawn = materialize(first_in_group(each, ["_round"], [order, F.col(key)], take))
    presence = cells.where("presence = 1")

    def rows_of(k: int) -> DataFrame:
        return materialize(presence.unionByName(drawn.where(F.col("_round") == k).drop("_round")).coalesce(parts))

    def member(job: tuple[int, str]) -> DataFrame:
        k, kind = job
        estimator = forest(columns, trees=sizes.get("trees", 100), seed=seed + k) if kind == "forest" else boosted(columns, rounds=sizes.get("boosts", 40), seed=seed + k)
        return fit_score(estimator, trains[k], cells if score_on is None else score_on).select(key, "score")

    with ThreadPoolExecutor(threads) as pool:
        trains = list(pool.map(rows_of, range(rounds)))
        members = list(pool.map(member, [(k, kind) for k in range(rounds) for kind in ("forest", "boosted")]))
    return reduce(DataFrame.unionByName, members).groupBy(key).agg(F.avg("score").alias("score"), F.stddev_pop("score").alias("spread"))


def reliable_negatives(cells: DataFrame, score: str, share: float = 0.6) -> DataFrame:
    """Positives, and those negatives that a first model scores in the lowest share."""
    limit = quantiles(cells.where("presence = 0"), F.col(score), [share])[0]
    return cells.where((F.col("presence") == 1) | (F.col(score) <= limit))


def importances(estimator: Estimator, train: DataFrame, columns: list[str]) -> DataFrame:
    """feature and importance of a fitted tree model, and kept: whether it is above the mean. One row per feature."""
    weights = estimator.fit(balanced(train)).stages[-1].featureImportances.toArray()
    rows = [(c, float(w), bool(w > weights.mean())) for c, w in zip(columns, weights, strict=True)]
    return train.sparkSession.createDataFrame(rows, "feature string, importance double, kept boolean")


def train_score(cells: DataFrame, key: str, columns: list[str], least: int = 5, background: int = 3000, seed: int = 42, **sizes: int) -> DataFrame:
    """cells with ml_score, scaled by quantiles, and spread: the ensemble over a drawn background; one half with too few positives or no background."""
    if cells.where("presence = 1").limit(least).count() < least or cells.where("presence = 0").isEmpty():
        return cells.withColumns({"ml_score": F.lit(0.5), "spread": F.lit(0.0)})
    train = presence_background(cells, key, background, seed)
    scored = materialize(cells.join(ensemble(train, key, columns, seed=seed, score_on=cells, **sizes), key))
    return scored.withColumns({"ml_score": robust_01(scored, F.col("score"), 0.02, 0.98), "spread": robust_01(scored, F.col("spread"), 0.02, 0.98)}).drop("score")


#: Fixed value: smoothing steps of the map of a model's score.
SMOOTHING_STEPS = 4


def train_map(cells: DataFrame, key: str, columns: list[str], rows: int, across: int, **settings) -> DataFrame:
    """cells (r, c) as train_score gives them, with ml_score_sm, the score smoothed and scaled again, and uncertainty in place of spread."""
    scored = materialize(train_score(cells, key, columns, **settings))
    smoothed = materialize(smooth(scored.select("r", "c", "ml_score"), "ml_score", rows, across, SMOOTHING_STEPS))
    again = smoothed.select("r", "c", robust_01(smoothed, F.col("ml_score"), 0.02, 0.98).alias("ml_score_sm"))
    return scored.join(again, ["r", "c"]).withColumnRenamed("spread", "uncertainty")
