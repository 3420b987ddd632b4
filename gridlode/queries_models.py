"""Registered queries of honest validation: greedy folds, cross-validation of scorers, resampled lifts, halos, the whole chain."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridlode.functions import numeric
from gridlode.functions.numeric import quantiles
from gridlode.operators import boosting, features, geometry, grid, metrics, models, one_class, terrain, validation
from gridlode.plans.materialize import materialize
from gridlode.queries import CELLS, DISTANCES, FEATS, HASH, SIDE, _criterial_sql, _rounded, query
from gridlode.sources import tables

COLUMNS = [f"f{i}" for i in range(13)]
AREAS = [0.05, 0.1, 0.15]
DRAWN = 200
_CRITERIAL = validation.criterial_scorer(COLUMNS)


def _cells(spark, d):
    return tables.samples(spark, d).withColumn("fold", (F.col("block") % 5).cast("int"))


@query(
    f"""WITH RECURSIVE {FEATS}, b AS (SELECT block, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, block) AS k FROM (SELECT cell_id % 23 AS block FROM feats) GROUP BY block),
g AS (SELECT 0::BIGINT AS k, NULL::BIGINT AS block, NULL::INT AS fold, [0, 0, 0, 0, 0]::BIGINT[] AS loads
  UNION ALL SELECT b.k, b.block, list_position(loads, list_min(loads))::INT - 1, [x + CASE WHEN i = list_position(loads, list_min(loads)) THEN b.n ELSE 0 END FOR x, i IN loads] FROM g JOIN b ON b.k = g.k + 1)
SELECT block, fold FROM g WHERE k > 0"""
)
def greedy_folds(spark, d):
    """The largest block goes to the lightest fold, and so on."""
    return validation.greedy_folds(tables.samples(spark, d).withColumn("block", F.col("cell_id") % 23), 5)


@query()
def greedy_stratified_folds(spark, d):
    return validation.greedy_folds(tables.samples(spark, d).withColumn("block", F.col("cell_id") % 23), 5, "presence")


def _folds_sql() -> str:
    """Lifts of the criterial score, learnt from the other folds' presence and a drawn background, over all cells."""
    parts, rows = [], []
    for k in range(5):
        parts.append(f"tr{k} AS (SELECT * FROM feats WHERE block % 5 <> {k} AND presence = 1 UNION ALL (SELECT * FROM feats WHERE block % 5 <> {k} AND presence = 0 ORDER BY md5('{42000 + k}:' || cell_id), cell_id LIMIT {DRAWN}))")
        parts.append(_criterial_sql("true").replace("st AS", f"st{k} AS").replace("FROM feats WHERE true", f"FROM tr{k}").replace("scored AS", f"sc{k} AS").replace("FROM feats, st)", f"FROM feats, st{k})"))
        for a in AREAS:
            rows.append(f"SELECT {k} AS fold, {a}::DOUBLE AS area, avg((score >= t)::INT) FILTER (presence = 1 AND block % 5 = {k}) AS coverage, avg((score >= t)::INT) FILTER (presence = 1 AND block % 5 <> {k}) AS inside FROM sc{k}, (SELECT quantile_cont(score, {1.0 - a!r}) AS t FROM sc{k})")
    return ", ".join(parts) + ", lifts AS (" + " UNION ALL ".join(rows) + ")"


@query(
    f"WITH {FEATS}, {_folds_sql()} SELECT 'criterial' AS model, fold, area, round(coverage, 6) AS coverage, round(coverage / area, 6) AS lift FROM lifts WHERE coverage IS NOT NULL UNION ALL SELECT 'random', fold, area, area, 1.0::DOUBLE FROM lifts WHERE coverage IS NOT NULL"
)
def scorer_cross_validation(spark, d):
    out = validation.cross_validation(_cells(spark, d), "cell_id", {"criterial": _CRITERIAL}, AREAS, 5, background=DRAWN)
    return out.select("model", "fold", "area", _rounded("coverage").alias("coverage"), _rounded("lift").alias("lift"))


@query(f"WITH {FEATS}, {_folds_sql()} SELECT area, round(inside / area, 6) AS inside, round(coverage / area, 6) AS outside FROM lifts WHERE fold = 0")
def fit_gap(spark, d):
    out = validation.fit_gap(_cells(spark, d), "cell_id", _CRITERIAL, AREAS, background=DRAWN)
    return out.select("area", _rounded("inside").alias("inside"), _rounded("outside").alias("outside"))


@query()
def model_cross_validation(spark, d):
    """Forest, boosted trees, logistic and criterial scores on the same folds, and chance."""
    scorers = {
        "forest": validation.model_scorer(models.forest(COLUMNS)),
        "boosted": validation.model_scorer(models.boosted(COLUMNS)),
        "logistic": validation.model_scorer(models.logistic(COLUMNS)),
        "criterial": _CRITERIAL,
    }
    return validation.cross_validation(_cells(spark, d), "cell_id", scorers, [0.1, 0.15], 5)


def _resampled_sql(scores: str, value: str, seed: int) -> str:
    return f"""{scores},
pr AS (SELECT row_number() OVER (ORDER BY cell_id) - 1 AS pos, {value} AS v FROM both_ WHERE presence = 1), n AS (SELECT count(*) AS n FROM pr),
dr AS (SELECT i, {HASH.format(f"'{seed}:' || i || ':' || j")} % (SELECT n FROM n) AS pos FROM range(300) AS x(i), (SELECT unnest(range((SELECT n FROM n))) AS j)),
m AS (SELECT i, avg(v) AS mean FROM dr JOIN pr USING (pos) GROUP BY i)
SELECT (SELECT round(avg(v), 6) FROM pr) AS lift, round(quantile_cont(mean, 0.025), 6) AS low, round(quantile_cont(mean, 0.975), 6) AS high FROM m"""


@query(f"WITH {FEATS}, " + _resampled_sql(f"{_criterial_sql('block % 5 <> 0')}, both_ AS (SELECT cell_id, presence, (score >= (SELECT quantile_cont(score, 0.9) FROM scored))::INT AS hit FROM scored)", "hit / 0.1", 4))
def resampled_lift(spark, d):
    g = tables.samples(spark, d)
    out = validation.resampled_lift(g.withColumn("score", metrics.criterial(g.where("block % 5 <> 0"), COLUMNS)), "cell_id", ["score"], 0.1, 300, 4)
    return out.select(*[_rounded(c).alias(c) for c in out.columns])


@query(
    f"WITH {FEATS}, "
    + _resampled_sql(f"{_criterial_sql('block % 5 <> 0')}, both_ AS (SELECT cell_id, feats.presence, (score >= (SELECT quantile_cont(score, 0.9) FROM scored))::INT - (f0 >= (SELECT quantile_cont(f0, 0.9) FROM feats))::INT AS gain FROM scored JOIN feats USING (cell_id))", "gain / 0.1", 4)
)
def resampled_gain(spark, d):
    """What the criterial score gains over its first feature alone."""
    g = tables.samples(spark, d)
    out = validation.resampled_lift(g.withColumn("score", metrics.criterial(g.where("block % 5 <> 0"), COLUMNS)), "cell_id", ["score", "f0"], 0.1, 300, 4)
    return out.select(*[_rounded(c).alias(c) for c in out.columns])


def _presence(spark, d):
    g = tables.cells(spark, d)
    return g.select((F.col("r") * SIDE + F.col("c")).alias("cell_id"), "r", "c", "q", "p", "d", "t", ((F.col("r") * 31 + F.col("c") * 17) % 29 == 0).cast("int").alias("presence"), (F.col("r") % 3).cast("int").alias("fold"))


_PRES = f"ps AS (SELECT r * {SIDE} + c AS cell_id, r, c, q, p, d, t, ((r * 31 + c * 17) % 29 = 0)::INT AS presence, r % 3 AS fold FROM cells)"
_HALO = "hl AS (SELECT DISTINCT a.r, a.c FROM ps a JOIN ps b ON b.presence = 1 AND (a.r - b.r) ** 2 + (a.c - b.c) ** 2 <= 4 WHERE a.presence = 0)"


@query(f"WITH {CELLS}, {_PRES}, {_HALO} SELECT r, c FROM hl")
def halo_cells(spark, d):
    return validation.halo(_presence(spark, d), 2)


def _small_sql(name: str, train: str) -> str:
    columns = ["q", "p", "d", "t"]
    stats = ", ".join(f"avg({c}) AS m{c}, stddev_pop({c}) AS s{c}, avg({c} * presence) - avg({c}) * avg(presence) AS x{c}" for c in columns)
    total = " + ".join(f"CASE WHEN abs(x{c}) < 1e-12 THEN 0 WHEN x{c} > 0 THEN 1 ELSE -1 END * ({c} - m{c}) / (s{c} + 1e-9)" for c in columns)
    return f"st{name} AS (SELECT {stats} FROM ({train})), sc{name} AS (SELECT ps.*, ({total}) / 4 AS score FROM ps, st{name})"


def _halo_lift_sql() -> str:
    parts, rows = [], []
    for k in range(3):
        parts.append(f"hl{k} AS (SELECT DISTINCT a.r, a.c FROM ps a JOIN ps b ON b.presence = 1 AND (a.r - b.r) ** 2 + (a.c - b.c) ** 2 <= 4 WHERE a.presence = 0 AND a.fold = {k} AND b.fold = {k})")
        parts.append(_small_sql(str(k), f"SELECT * FROM ps WHERE fold <> {k}"))
        for a in (0.1, 0.2):
            rows.append(
                f"SELECT {k} AS fold, {a}::DOUBLE AS area, round(avg((score >= t_)::INT) FILTER (presence = 1 AND fold = {k}) / {a}, 6) AS on_presence, round(avg((score >= t_)::INT) FILTER ((r, c) IN (SELECT (r, c) FROM hl{k})) / {a}, 6) AS on_halo FROM sc{k}, (SELECT quantile_cont(score, {1.0 - a!r}) AS t_ FROM sc{k})"
            )
    return ", ".join(parts) + " " + " UNION ALL ".join(rows)


@query(f"WITH {CELLS}, {_PRES}, {_halo_lift_sql()}")
def halo_lifts(spark, d):
    out = validation.halo_lifts(_presence(spark, d), "cell_id", validation.criterial_scorer(["q", "p", "d", "t"]), [0.1, 0.2], 2)
    return out.select("fold", "area", _rounded("on_presence").alias("on_presence"), _rounded("on_halo").alias("on_halo"))


@query("SELECT * FROM (VALUES ('boosted', true), ('forest', true), ('logistic', true)) AS v(model, finds)")
def models_find_planted(spark, d):
    """Whether each model's held-out AUC is above 0.9 where presence depends on two features."""
    g = tables.samples(spark, d).withColumn("presence", (F.col("f0") + F.col("f1") > 0).cast("int"))
    out = None
    for name, make in (("boosted", models.boosted), ("forest", models.forest), ("logistic", models.logistic)):
        scored = models.fit_score(make(COLUMNS), g.where("block % 5 <> 0"), g.where("block % 5 = 0"))
        one = metrics.binary_metrics(scored).select(F.lit(name).alias("model"), (F.col("auc") > 0.9).alias("finds"))
        out = one if out is None else out.unionByName(one)
    return out


@query()
def tuned_settings(spark, d):
    """The best three settings of a logistic model by the lift over held-out folds."""
    g = _cells(spark, d)

    def evaluate(penalty: float, degree: int) -> float:
        scorer = validation.model_scorer(models.logistic(COLUMNS[:6], degree=degree, penalty=penalty))
        found = validation.cross_validation(g, "cell_id", {"m": scorer}, [0.1], 5).where("model = 'm'")
        return found.agg(F.avg("lift")).first()[0] or 0.0

    return validation.tune(spark, {"penalty": [0.01, 0.1], "degree": [1, 2]}, evaluate)


@query()
def pruned_features(spark, d):
    """Mean importances over three forests, and which features stay."""
    g = tables.samples(spark, d)
    return validation.ensemble_importances([models.importances(models.forest(COLUMNS, trees=30, seed=k), g, COLUMNS) for k in (13, 21, 42)])


#: What the forecast's model learns from.
LEARNT = [*(f"prox_{k}" for k in DISTANCES), *(f"halo_{k}" for k in features.WIDE), "coincidence_score", "tect_only_penalty"]


@query()
def forecast(spark, d):
    """The whole chain: layers, grid, distances, features, presence of dear occurrences, a trained model's map, prospectivity, classes and the strongest zones."""
    lines, size = tables.segments(spark, d), 500
    cells = materialize(geometry.build_grid(geometry.box_edges(tables.boxes(spark, d)), float(size)))
    layers = {k: lines.where(F.col("geom_id") % 5 == i) for i, k in enumerate(("paleo", "struct", "magm", "tect1", "tect2"))}
    wide = geometry.distance_to_polygons(cells, geometry.box_edges(tables.boxes(spark, d)), 1000.0, ["cell_id"]).withColumnRenamed("distance", "d_facies")
    for k, layer in layers.items():
        near = geometry.nearest_distance(cells.select("cell_id", "x", "y"), layer, 1000.0, ["cell_id"], half=250.0)
        wide = wide.join(near.select("cell_id", F.col("distance").alias(f"d_{k}")), "cell_id")
    found = {k: f"d_{k}" for k in DISTANCES}
    rows, columns = terrain.shape(cells)
    g = features.interactions(features.halo_proximities(features.proximities(wide, found), found))
    g = features.smoothed_geo_score(features.taxonomy_score(g, found), rows, columns)
    corner = cells.select(F.min(F.col("x") - size / 2 - F.col("c") * size), F.min(F.col("y") - size / 2 - F.col("r") * size)).first()
    occurrences = tables.occurrences(spark, d)
    dear = quantiles(occurrences, F.col("price"), [0.99])[0]
    g = grid.presence(g, occurrences.where(F.col("price") >= dear), size, *map(int, corner))
    g = models.train_map(g, "cell_id", LEARNT, rows, columns, rounds=2, trees=50, boosts=20)
    g = features.prospectivity(g, "ml_score", rows, columns)
    zones = features.gold_zones(g, "prospectivity", "prox_magm", "coincidence_score", columns, 0.9)
    out = g.join(zones.select("r", "c", "rank"), ["r", "c"], "left")
    return out.select("cell_id", "presence", "geo_score", "geo_score_sm", "ml_score", "ml_score_sm", "uncertainty", "prospectivity", "prognoz", numeric.classes(F.col("prospectivity")).alias("class"), "rank")


@query()
def monotone_scores(spark, d):
    """Held-out scores of boosted trees that may only rise with the first feature and fall with the second."""
    g = tables.samples(spark, d)
    return boosting.fit(g.where("block % 5 <> 0"), COLUMNS, {"f0": 1, "f1": -1}).score(g.where("block % 5 = 0")).select("cell_id", "score")


@query()
def one_class_scores(spark, d):
    """How alike to presence all cells are, learnt from presence alone."""
    g = tables.samples(spark, d)
    return one_class.fit(g.where("presence = 1"), COLUMNS).score(g).select("cell_id", "score")
