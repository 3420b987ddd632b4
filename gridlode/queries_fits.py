"""Registered queries of many fits in one job: held-out scores, training modes, permutations with refits, sets of features; and their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridlode.functions.numeric import robust_01
from gridlode.operators import fits
from gridlode.plans.materialize import materialize
from gridlode.queries import CELLS, FEATS, HASH, SIDE, _robust_sql, _rounded, _scaled, query
from gridlode.queries_models import _PRES, _cells, _presence
from gridlode.sources import tables

COLUMNS = [f"f{i}" for i in range(13)]
SMALL = ["q", "p", "d", "t"]
BACKGROUND, AREAS = 150, [0.1, 0.2]


def _drawn_sql(name: str, source: str, seed: int) -> str:
    """Presence of each fit, and a background drawn in the order of a hash."""
    return f"{name} AS (SELECT * FROM {source} WHERE presence = 1 UNION ALL (SELECT * FROM {source} WHERE presence = 0 QUALIFY row_number() OVER (PARTITION BY fit ORDER BY md5('{seed}:' || fit || ':' || cell_id), cell_id) <= {BACKGROUND}))"


def _learnt_sql(name: str, train: str, cells: str, columns: list[str], used: str | None = None) -> str:
    """The cells with score, the criterial index learnt for their fit; used tells, with {c} for a column, whether a fit uses it."""
    stats = ", ".join(f"avg({c}) AS m{c}, stddev_pop({c}) AS s{c}, avg({c} * presence) - avg({c}) * avg(presence) AS x{c}" for c in columns)
    part = lambda c: f"CASE WHEN abs(x{c}) < 1e-12 THEN 0 WHEN x{c} > 0 THEN 1 ELSE -1 END * ({c} - m{c}) / (s{c} + 1e-9)"
    one = lambda c: part(c) if used is None else f"CASE WHEN {used.format(c=c[1:])} THEN {part(c)} ELSE 0 END"
    return f"{name}s AS (SELECT fit, {stats} FROM {train} GROUP BY fit), {name} AS (SELECT x.*, ({' + '.join(map(one, columns))}) / {len(columns)} AS score FROM {cells} x JOIN {name}s USING (fit))"


def _held_sql() -> str:
    """Lifts of presence by held-out ranks, out of scored rows sc (m, fit, k, fold, presence, score)."""
    return f"""rk AS (SELECT *, (row_number() OVER (PARTITION BY fit ORDER BY score, cell_id) - 1) / greatest(count(*) OVER (PARTITION BY fit) - 1, 1)::DOUBLE AS oof FROM sc),
oo AS (SELECT * FROM rk WHERE fold = k),
th AS (SELECT m AS g, unnest({AREAS})::DOUBLE AS area, unnest(quantile_cont(oof, {[1.0 - a for a in AREAS]})) AS t_ FROM oo GROUP BY 1),
lf AS (SELECT m AS g, area, round(avg((oof >= t_)::INT), 6) AS coverage, round(avg((oof >= t_)::INT) / area, 6) AS lift FROM oo JOIN th ON th.g = m WHERE presence = 1 GROUP BY m, area)"""


_HELD = f"ev AS (SELECT f.*, block % 5 AS fold, 0 AS m, k, k AS fit FROM feats f, range(5) AS x(k)), tr AS (SELECT * FROM ev WHERE fold <> k), {_drawn_sql('dr', 'tr', 42)}, {_learnt_sql('sc', 'dr', 'ev', COLUMNS)}, {_held_sql()}"


@query(f"WITH {FEATS}, {_HELD} SELECT area, coverage, lift FROM lf")
def held_out_lifts(spark, d):
    """Lifts of presence by scores of models that had no part of the cells' folds."""
    out = fits.held_lifts(fits.held_out(_cells(spark, d), "cell_id", 5, fits.Criterial(COLUMNS), BACKGROUND, 42), AREAS)
    return out.select("area", _rounded("coverage").alias("coverage"), _rounded("lift").alias("lift"))


@query()
def forest_held_out_lifts(spark, d):
    """The same of forests that are grown in the executors."""
    return fits.held_lifts(fits.held_out(_cells(spark, d), "cell_id", 5, fits.Forest(COLUMNS), 3000, 42), AREAS)


_MODES = f"""ev AS (SELECT ps.*, m, k, m * 1048576 + k AS fit FROM ps, range(4) AS x(m), range(3) AS y(k)), sd AS (SELECT fit, r, c FROM ev WHERE fold <> k AND presence = 1 AND m >= 2),
nr AS (SELECT DISTINCT e.fit, e.cell_id FROM ev e JOIN sd ON sd.fit = e.fit AND (sd.r - e.r) ** 2 + (sd.c - e.c) ** 2 <= 4),
tr AS (SELECT e.* REPLACE (greatest(presence, (nr.cell_id IS NOT NULL)::INT) AS presence) FROM ev e LEFT JOIN nr USING (fit, cell_id) WHERE fold <> k),
pu AS (SELECT * FROM tr WHERE m IN (1, 3)), ng AS (SELECT * FROM pu WHERE presence = 0), {_drawn_sql('da', 'pu', 42)}, {_learnt_sql('sa', 'da', 'ng', SMALL)},
li AS (SELECT fit, quantile_cont(score, 0.6) AS t_ FROM sa GROUP BY fit),
fn AS (SELECT * FROM tr WHERE m IN (0, 2) UNION ALL SELECT * FROM pu WHERE presence = 1 UNION ALL SELECT * EXCLUDE (score, t_) FROM sa JOIN li USING (fit) WHERE score <= t_),
{_drawn_sql('db', 'fn', 43)}, {_learnt_sql('sc', 'db', 'ev', SMALL)}, {_held_sql()}"""


@query(f"WITH {CELLS}, {_PRES}, {_MODES} SELECT ['baseline', 'reliable', 'halo', 'both'][g + 1] AS mode, area, coverage, lift FROM lf")
def training_modes(spark, d):
    """Held-out lift of the real presence, learnt from presence or its halo, with all or only with reliable negatives."""
    out = fits.mode_lifts(_presence(spark, d), "cell_id", 3, fits.Criterial(SMALL), AREAS, 2, background=BACKGROUND)
    return out.select("mode", "area", _rounded("coverage").alias("coverage"), _rounded("lift").alias("lift"))


@query()
def forest_training_modes(spark, d):
    return fits.mode_lifts(_presence(spark, d), "cell_id", 3, fits.Forest(SMALL, trees=30), AREAS, 2)


DRAWS = 20
_PERMUTED = f"""cl AS (SELECT *, block % 5 AS fold FROM feats), n AS (SELECT sum(presence) AS p FROM feats),
rd AS (SELECT cl.*, i, row_number() OVER (PARTITION BY i ORDER BY md5('42:' || i || ':' || cell_id), cell_id) AS at_ FROM cl, range({DRAWS + 1}) AS x(i)),
lb AS (SELECT * EXCLUDE (at_) REPLACE (CASE WHEN i = 0 THEN presence ELSE (at_ <= (SELECT p FROM n))::INT END AS presence) FROM rd),
ev AS (SELECT lb.*, k, i * 1048576 + k AS fit FROM lb, range(5) AS x(k)), tr AS (SELECT * FROM ev WHERE fold <> k), {_drawn_sql('dr', 'tr', 42)}, {_learnt_sql('sc', 'dr', 'ev', COLUMNS)},
th AS (SELECT fit, quantile_cont(score, 0.9) AS t_ FROM sc GROUP BY fit),
cv AS (SELECT i, k, avg((score >= t_)::INT) AS v FROM sc JOIN th USING (fit) WHERE presence = 1 AND fold = k GROUP BY ALL), lf AS (SELECT i, avg(v) / 0.1 AS lift FROM cv GROUP BY i)"""


@query(
    f"WITH {FEATS}, {_PERMUTED}, o AS (SELECT lift AS o FROM lf WHERE i = 0) SELECT round(any_value(o), 6) AS observed, round(avg(lift), 6) AS null_mean, round(quantile_cont(lift, 0.95), 6) AS null_95, round(avg((lift >= o - 1e-12)::INT), 6) AS p_value FROM lf, o WHERE i > 0"
)
def permutation_refits(spark, d):
    """The lift that is observed against that of random presence, a background drawn and the index learnt again in every draw and fold."""
    out = fits.permutation_test(_cells(spark, d), "cell_id", 5, fits.Criterial(COLUMNS), 0.1, DRAWS, BACKGROUND)
    return out.select(*[_rounded(c).alias(c) for c in out.columns])


@query()
def forest_permutations(spark, d):
    """The same with a forest grown again in every draw and fold."""
    return fits.permutation_test(_cells(spark, d), "cell_id", 5, fits.Forest(COLUMNS, trees=20), 0.1, DRAWS)


SETS = {"all": COLUMNS, "first": COLUMNS[:6], "odd": COLUMNS[1::2]}
FOLDS = {13: "fold13", 21: "fold21", 42: "fold42"}


def _seeded(spark, d):
    return tables.samples(spark, d).withColumns({c: ((F.col("block") * (7 * k + 3) + F.floor(F.col("block") / (k + 2))) % 5).cast("int") for k, c in enumerate(FOLDS.values())})


def _sets_sql() -> str:
    fold = "CASE s " + " ".join(f"WHEN {k} THEN (block * {7 * k + 3} + block // {k + 2}) % 5" for k in range(len(FOLDS))) + " END"
    uses = "list_contains(CASE u " + " ".join(f"WHEN {k} THEN {[int(c[1:]) for c in columns]}" for k, columns in enumerate(SETS.values())) + " END, {c})"
    several = lambda name, source: f"{name} AS (SELECT x.* REPLACE (fit + u * 1099511627776 AS fit), u FROM {source} x, range({len(SETS)}) AS y(u))"
    return f"""ea AS (SELECT feats.*, s, k, s * 1024 + k AS fit, {fold} AS fold FROM feats, range({len(FOLDS)}) AS x(s), range(5) AS y(k)),
tr AS (SELECT * FROM ea WHERE fold <> k), {_drawn_sql('dr', 'tr', next(iter(FOLDS)))}, {several('ds', 'dr')}, {several('es', 'ea')}, {_learnt_sql('sc', 'ds', 'es', COLUMNS, uses)},
th AS (SELECT fit, quantile_cont(score, 0.9) AS t_ FROM sc GROUP BY fit), lf AS (SELECT u, s, k, avg((score >= t_)::INT) / 0.1 AS lift FROM sc JOIN th USING (fit) WHERE presence = 1 AND fold = k GROUP BY ALL)"""


def _set_lifts(spark, d):
    return fits.feature_set_lifts(_seeded(spark, d), "cell_id", FOLDS, 5, fits.Criterial(COLUMNS), SETS, 0.1, BACKGROUND)


@query(f"WITH {FEATS}, {_sets_sql()} SELECT {list(SETS)}[u + 1] AS set, {list(FOLDS)}[s + 1] AS seed, k AS fold, round(lift, 6) AS lift FROM lf")
def feature_set_lifts(spark, d):
    """Held-out lift of sets of features on the same folds and backgrounds."""
    return _set_lifts(spark, d).select("set", "seed", "fold", _rounded("lift").alias("lift"))


@query(
    f"""WITH {FEATS}, {_sets_sql()}, pr AS (SELECT b.u, row_number() OVER (PARTITION BY b.u ORDER BY a.s, a.k) - 1 AS pos, count(*) OVER (PARTITION BY b.u) AS n, b.lift - a.lift AS g FROM lf a JOIN lf b ON a.u = 0 AND b.u > 0 AND a.s = b.s AND a.k = b.k),
n AS (SELECT DISTINCT u, n FROM pr), dw AS (SELECT u, i, {HASH.format("'42:' || i || ':' || j")} % n AS pos FROM (SELECT u, n, unnest(range(n)) AS j FROM n), range(500) AS x(i)),
m AS (SELECT u, i, avg(g) AS mean FROM dw JOIN pr USING (u, pos) GROUP BY ALL), e AS (SELECT u, quantile_cont(mean, 0.025) AS low, quantile_cont(mean, 0.975) AS high FROM m GROUP BY u)
SELECT {list(SETS)}[u + 1] AS set, count(*) AS n, round(avg(g), 6) AS gain, round(any_value(low), 6) AS low, round(any_value(high), 6) AS high, round(avg((g > 1e-9)::INT), 6) AS win_rate, any_value(low) > 0 OR any_value(high) < 0 AS significant FROM pr JOIN e USING (u) GROUP BY u"""
)
def ablation(spark, d):
    """What sets of features gain over all of them, in pairs."""
    out = fits.ablation(_set_lifts(spark, d), "all", 500)
    return out.select("set", "n", *[_rounded(c).alias(c) for c in ("gain", "low", "high", "win_rate")], "significant")


@query()
def pruned_and_checked(spark, d):
    """Features above the mean importance of forests on three seeds' folds, and what a forest of them gains over one of all, in pairs."""
    cells, forest = materialize(_seeded(spark, d)), fits.Forest(COLUMNS, trees=30)
    train = fits.with_background(fits.of_each(cells, len(FOLDS)), "cell_id", 3000, 42)
    kept = [r["feature"] for r in fits.kept_features(forest.models(train), COLUMNS).where("kept").collect()]  # a name per feature
    lifts = fits.feature_set_lifts(cells, "cell_id", FOLDS, 5, forest, {"all": COLUMNS, "kept": sorted(kept)}, 0.1)
    return fits.ablation(lifts, "all", 500).withColumn("features", F.lit(", ".join(sorted(kept))))


_MEMBERS = f"""cu AS (SELECT r * {SIDE} + c AS cell_id, r, c, q, p, d, t, (mq >= 50)::INT AS presence, r % 5 AS fold FROM cells), ev AS (SELECT cu.*, k AS fit FROM cu, range(5) AS x(k)),
tr AS (SELECT * FROM ev WHERE fold <> fit), {_learnt_sql('sc', 'tr', 'ev', SMALL)}, mb AS (SELECT r, c, avg(score) AS mean, stddev_pop(score) AS s FROM sc GROUP BY r, c)"""


@query(f"WITH {CELLS}, {_MEMBERS}, z AS {_robust_sql('s', 'mb', 0.02, 0.98)} SELECT r, c, round(mean, 6) AS mean, round({_scaled('s', 'z')}, 6) AS uncertainty FROM mb, z")
def member_uncertainty(spark, d):
    """Mean and spread, scaled by quantiles, of five members' scores, each learnt without a fifth of the rows."""
    cells = tables.cells(spark, d).select("r", "c", *SMALL, (F.col("mq") >= 50).cast("int").alias("presence"), (F.col("r") % 5).alias("fold"))
    every = fits.of_each(cells, 5)
    scored = fits.Criterial(SMALL)(every.where(F.col("fold") != F.col("fit")), every)
    spread = materialize(scored.groupBy("r", "c").agg(F.avg("score").alias("mean"), F.stddev_pop("score").alias("s")))
    return spread.select("r", "c", _rounded("mean").alias("mean"), _rounded(robust_01(spread, F.col("s"), 0.02, 0.98)).alias("uncertainty"))
