"""Registered queries of folds, repeated cross-validation and model comparison, and their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridlode.operators import metrics, models, sampling
from gridlode.queries import FEATS, HASH, QUERIES, _rounded, query
from gridlode.sources import tables

SEEDS = [13, 21, 42]
FOLDS = 5
AREAS = [0.1, 0.15]
CURVE = [round(0.02 + 0.48 * i / 19, 4) for i in range(20)]
COLUMNS = [f"f{i}" for i in range(13)]


def _cv_sql(columns: list[str], areas: list[float], tag: str = "") -> str:
    stats = ", ".join(f"avg({c}) AS m{c}, stddev_pop({c}) AS s{c}, avg({c} * presence) - avg({c}) * avg(presence) AS x{c}" for c in columns)
    total = " + ".join(f"CASE WHEN abs(x{c}) < 1e-12 THEN 0 WHEN x{c} > 0 THEN 1 ELSE -1 END * ({c} - m{c}) / (s{c} + 1e-9)" for c in columns)
    return f"""fo{tag} AS (SELECT block, seed, ((row_number() OVER (PARTITION BY seed ORDER BY md5(seed || ':' || block), block) - 1) % {FOLDS})::INT AS fold FROM (SELECT DISTINCT block FROM feats), (SELECT unnest({SEEDS}) AS seed)),
ce{tag} AS (SELECT * FROM feats JOIN fo{tag} USING (block)),
st{tag} AS (SELECT seed, k AS fold, {stats} FROM ce{tag}, range({FOLDS}) AS x(k) WHERE fold <> k GROUP BY seed, k),
sc{tag} AS (SELECT cell_id, presence, seed, fold, ({total}) / {len(columns)} AS score FROM ce{tag} JOIN st{tag} USING (seed, fold)),
th{tag} AS (SELECT seed, fold, unnest({areas})::DOUBLE AS area, unnest(quantile_cont(score, {[1.0 - a for a in areas]})) AS t FROM sc{tag} GROUP BY seed, fold),
cv{tag} AS (SELECT seed, fold, area, count(*) FILTER (score >= t) / count(*)::DOUBLE AS coverage FROM sc{tag} JOIN th{tag} USING (seed, fold) WHERE presence = 1 GROUP BY ALL)"""


def _scored(spark, d, columns=COLUMNS):
    g = tables.samples(spark, d)
    return metrics.criterial_by_fold(g.join(sampling.seeded_folds(g, FOLDS, SEEDS), "block"), columns, FOLDS)


def _lifts(spark, d, areas, columns=COLUMNS):
    return metrics.top_area_by_group(_scored(spark, d, columns), ["seed", "fold"], areas)


@query(f"WITH {FEATS}, {_cv_sql(COLUMNS, AREAS)} SELECT seed, fold, area, round(coverage, 6) AS coverage, round(coverage / area, 6) AS lift FROM cv")
def seeded_cross_validation(spark, d):
    return _lifts(spark, d, AREAS).select("seed", "fold", "area", _rounded("coverage").alias("coverage"), _rounded("lift").alias("lift"))


@query(
    f"WITH {FEATS}, {_cv_sql(COLUMNS, AREAS)}, s AS (SELECT seed, area, avg(coverage / area) AS lift FROM cv GROUP BY ALL) "
    "SELECT area, round(avg(lift), 6) AS mean, round(stddev_samp(lift), 6) AS std, round(min(lift), 6) AS least, round(max(lift), 6) AS most FROM s GROUP BY area"
)
def repeated_cross_validation(spark, d):
    """Mean lift per seed, and how it varies between seeds."""
    by_seed = _lifts(spark, d, AREAS).groupBy("seed", "area").agg(F.avg("lift").alias("lift"))
    return by_seed.groupBy("area").agg(*[_rounded(f("lift")).alias(n) for n, f in (("mean", F.avg), ("std", F.stddev_samp), ("least", F.min), ("most", F.max))])


@query(f"WITH {FEATS}, {_cv_sql(COLUMNS, CURVE)} SELECT area, round(avg(coverage), 6) AS coverage FROM cv GROUP BY area UNION ALL SELECT 1.0::DOUBLE, 1.0::DOUBLE")
def success_rate_curve(spark, d):
    """Mean coverage by area; all of the area covers all."""
    curve = _lifts(spark, d, CURVE).groupBy("area").agg(_rounded(F.avg("coverage")).alias("coverage"))
    return curve.unionByName(spark.range(1).select(F.lit(1.0).alias("area"), F.lit(1.0).alias("coverage")))


@query(
    f"WITH {FEATS}, {_cv_sql(COLUMNS, AREAS)} SELECT cell_id, seed, fold, round((row_number() OVER (PARTITION BY seed, fold ORDER BY score, cell_id) - 1) / greatest(count(*) OVER (PARTITION BY seed, fold) - 1, 1)::DOUBLE, 6) AS rank01 FROM sc"
)
def out_of_fold_ranks(spark, d):
    """Rank of each cell within its fold, by a score that its fold had no part in."""
    ranked = metrics.rank_within(_scored(spark, d).select("cell_id", "seed", "fold", "score"), ["seed", "fold"], "score", "cell_id")
    return ranked.select("cell_id", "seed", "fold", _rounded("rank01").alias("rank01"))


@query(
    f"""WITH {FEATS}, {_cv_sql(COLUMNS[:6], [0.1], "a")}, {_cv_sql(COLUMNS, [0.1], "b")},
pr AS (SELECT row_number() OVER (ORDER BY a.seed, a.fold) - 1 AS pos, a.coverage / 0.1 AS a, b.coverage / 0.1 AS b FROM cva a JOIN cvb b USING (seed, fold)), n AS (SELECT count(*) AS n FROM pr),
dr AS (SELECT i, {HASH.format("'3:' || i || ':' || j")} % (SELECT n FROM n) AS pos FROM range(500) AS x(i), (SELECT unnest(range((SELECT n FROM n))) AS j)),
m AS (SELECT i, avg(b - a) AS mean FROM dr JOIN pr USING (pos) GROUP BY i), e AS (SELECT quantile_cont(mean, 0.025) AS low, quantile_cont(mean, 0.975) AS high FROM m)
SELECT count(*) AS n, round(avg(a), 6) AS mean_a, round(avg(b), 6) AS mean_b, round(avg(b - a), 6) AS diff, round(avg((b - a > 1e-9)::INT), 6) AS win_rate, round(any_value(low), 6) AS low, round(any_value(high), 6) AS high, any_value(low) > 0 OR any_value(high) < 0 AS significant FROM pr, e"""
)
def paired_models(spark, d):
    """The criterial score of six features against that of thirteen, on the same folds."""
    one = _lifts(spark, d, [0.1], COLUMNS[:6]).select("seed", "fold", F.col("lift").alias("a"))
    both = one.join(_lifts(spark, d, [0.1]).select("seed", "fold", F.col("lift").alias("b")), ["seed", "fold"])
    out = sampling.paired_comparison(both, ["seed", "fold"], "a", "b", 500, 3)
    return out.select("n", *[_rounded(c).alias(c) for c in ("mean_a", "mean_b", "diff", "win_rate", "low", "high")], "significant")


def _dealt_sql(order: str) -> str:
    return f"WITH {FEATS}, b AS (SELECT block, (row_number() OVER (ORDER BY {order} count(*) DESC, block) - 1) % 10 AS t FROM (SELECT *, cell_id % 23 AS block FROM (SELECT cell_id, presence FROM feats)) GROUP BY block) SELECT block, (CASE WHEN t < 5 THEN t ELSE 9 - t END)::INT AS fold FROM b"


@query(_dealt_sql(""))
def group_folds(spark, d):
    return sampling.group_folds(tables.samples(spark, d).withColumn("block", F.col("cell_id") % 23), FOLDS)


@query(_dealt_sql("sum(presence) DESC,"))
def stratified_group_folds(spark, d):
    return sampling.group_folds(tables.samples(spark, d).withColumn("block", F.col("cell_id") % 23), FOLDS, "presence")


def _unit(axis: str) -> str:
    hashed = HASH.format(f"'42:' || i || ':{axis}'")
    return f"{hashed} / 4294967296.0"


@query(f"SELECT i AS id, round(100 + 20 * {_unit('x')}, 6) AS x, round(-40 + 30 * {_unit('y')}, 6) AS y FROM range(1000) AS t(i)")
def uniform_background(spark, d):
    return sampling.uniform_points(spark, 1000, (100.0, -40.0, 120.0, -10.0), 42).select("id", _rounded("x").alias("x"), _rounded("y").alias("y"))


# trained by Spark ML: beyond SQL


@query()
def feature_importances(spark, d):
    return models.importances(models.forest(COLUMNS, trees=20), tables.samples(spark, d), COLUMNS)


@query()
def transfer_scores(spark, d):
    """A model of the even blocks scores the odd ones; rows that miss a feature stay without a score."""
    g = tables.samples(spark, d)
    return models.fit_score(models.forest(COLUMNS, trees=20), g.where("block % 2 = 0"), g.where("block % 2 = 1").na.drop(subset=COLUMNS)).select("cell_id", "score")


@query()
def trained_scores(spark, d):
    return models.train_score(tables.samples(spark, d), "cell_id", COLUMNS).select("cell_id", "ml_score", "spread")
