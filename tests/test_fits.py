"""Many fits in one job: nothing is learnt from what is held out, and the trees find what there is."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridlode.operators import fits, geometry, metrics, sampling, validation

COLUMNS = ["f0", "f1", "f2"]


def planted(spark, n=600, seed=1):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        x = [rng.random() for _ in COLUMNS]
        rows.append((i, i // 30, i % 30, i % 5, *x, int(x[0] + x[1] > 1.45)))
    return spark.createDataFrame(rows, "cell_id long, r long, c long, fold int, f0 double, f1 double, f2 double, presence int")


LEARNERS = [fits.Criterial(COLUMNS), fits.Forest(COLUMNS, trees=30, leaf=3)]


@pytest.mark.parametrize("learner", LEARNERS, ids=["criterial", "forest"])
def test_held_out_scores_find_presence(spark, learner):
    out = fits.held_out(planted(spark), "cell_id", 5, learner, 300, 7)
    assert out.count() == 600 and out.where("oof < 0 OR oof > 1 OR oof IS NULL").count() == 0
    assert metrics.binary_metrics(out.withColumn("score", F.col("oof"))).first()["auc"] > 0.9
    lifts = {r.area: (r.coverage, r.lift) for r in fits.held_lifts(out, [0.1, 0.3]).collect()}
    assert lifts[0.1][1] > 3 and lifts[0.3][0] > 0.8


@pytest.mark.parametrize("learner", LEARNERS, ids=["criterial", "forest"])
def test_no_model_has_seen_the_cells_it_scores(spark, learner):
    """Presence of the held-out fold may be anything: the scores of its cells stay."""
    cells = planted(spark)
    other = cells.withColumn("presence", F.when(F.col("fold") == 2, F.col("cell_id") % 2).otherwise(F.col("presence")))
    seen = []

    def spied(train, rows):
        seen.append(train.where(F.col("fold") == F.col("fit")).count())
        return learner(train, rows)

    a, b = ({r.cell_id: r.oof for r in fits.held_out(x, "cell_id", 5, spied, 10_000, 7).where("fold = 2").collect()} for x in (cells, other))
    assert a == b and len(a) == 120 and seen == [0, 0]


def test_a_fold_without_presence_elsewhere_has_no_scores(spark):
    cells = planted(spark).withColumn("presence", F.when(F.col("fold") == 0, F.col("presence")).otherwise(0))
    out = fits.held_out(cells, "cell_id", 5, fits.Forest(COLUMNS, trees=3), 300, 7)
    got = {r.fold: r.n for r in out.groupBy("fold").agg(F.count("oof").alias("n")).collect()}
    assert got == {0: 0, 1: 120, 2: 120, 3: 120, 4: 120}
    assert fits.held_lifts(out, [0.1]).count() == 0  # all presence lies where there is no score


def plain_tree(x, y, w, depth, leaf):
    """The best first cut by trying all."""
    best = (0.0, None)
    impure = lambda m: (w[m] * y[m]).sum() * (1 - (w[m] * y[m]).sum() / w[m].sum())
    whole = impure(np.ones(len(y), bool))
    for j in range(x.shape[1]):
        for t in np.unique(x[:, j])[:-1]:
            m = x[:, j] <= t
            if m.sum() >= leaf and (~m).sum() >= leaf:
                gain = whole - impure(m) - impure(~m)
                best = max(best, (gain, (j, t)), key=lambda b: b[0])
    return best[1]


def test_trees_cut_where_it_helps_most():
    rng = np.random.default_rng(3)
    x = rng.integers(0, 20, (400, 1)).astype(float)
    x = np.hstack([x, rng.integers(0, 20, (400, 1)), np.zeros((400, 1))])
    y = ((x[:, 1] > 12) & (rng.random(400) < 0.9)).astype(int)
    f, t, v, importance = fits.grow(x, y, 40, 2, 5, 1, np.array([1]))
    assert set(f[:, 0]) == {1} and np.median(t[:, 0]) == plain_tree(x[:, 1:2], y, np.where(y == 1, 1 / y.sum(), 1 / (400 - y.sum())), 1, 5)[1] == 12
    assert importance.argmax() == 1 and importance[2] == 0 and importance.sum() == pytest.approx(1)
    p = fits.predict(x, f, t, v)
    assert p[x[:, 1] > 12].min() > 0.8 > 0.3 > p[x[:, 1] <= 12].max()
    whole = fits.grow(x, y, 10, 7, 12, 1, np.arange(3))
    assert (whole[0][:, 0] >= -1).all() and ((whole[2] >= 0) & (whole[2] <= 1)).all()


def test_small_leaves_are_refused():
    x, y = np.arange(20.0)[:, None], (np.arange(20) == 19).astype(int)
    assert (fits.grow(x, y, 5, 3, 12, 1, np.array([0]))[0] == -1).all()


def test_fits_do_not_depend_on_partitions(spark):
    cells = planted(spark)
    got = []
    for n in (1, 7):
        out = fits.held_out(cells.repartition(n), "cell_id", 5, fits.Forest(COLUMNS, trees=5), 100, 7)
        got.append({r.cell_id: r.oof for r in out.collect()})
    assert got[0] == got[1]


def test_groups_of_cells_and_features_by_fit(spark, monkeypatch):
    monkeypatch.setattr(fits, "CHUNK_ROWS", 50)
    forest = fits.Forest(COLUMNS, trees=10, leaf=3)
    train = fits.of_each(planted(spark), 2).withColumn("use", F.when(F.col("fit") == 0, F.array(F.lit("f0"), F.lit("f1"))).otherwise(F.array(F.lit("f2"))))
    models = forest.models(train)
    kept = {r.fit: r.importance for r in models.collect()}
    assert kept[0][2] == 0 and kept[1][:2] == [0, 0]
    out = forest.score(fits.of_each(planted(spark), 2), models)
    assert out.count() == 1200 and out.groupBy("cell_id", "fit").count().where("count > 1").isEmpty()
    auc = {k: metrics.binary_metrics(out.where(F.col("fit") == k)).first()["auc"] for k in (0, 1)}
    assert auc[0] > 0.95 > 0.9 > auc[1]
    named = {r.feature: r.kept for r in fits.kept_features(models.where("fit = 0"), COLUMNS).collect()}
    assert named == {"f0": True, "f1": True, "f2": False}


def test_missing_features_count_as_zero(spark):
    cells = planted(spark).withColumn("f2", F.lit(None).cast("double")).withColumn("f1", F.when(F.col("cell_id") % 7 == 0, float("nan")).otherwise(F.col("f1")))
    for learner in LEARNERS:
        assert fits.held_out(cells, "cell_id", 5, learner, 300, 7).where("oof IS NULL").count() == 0


def test_the_halo_of_held_out_presence_is_not_learnt(spark):
    """Presence in one fold only: when it is held out, no mode may know of its halo."""
    seen = {}

    def spied(train, rows):
        for r in train.where("presence = 1").groupBy(F.shiftright("fit", 20).alias("mode"), (F.col("fit") % (1 << 20)).alias("of"), "fold").count().collect():
            seen.setdefault((r["mode"], r["of"]), set()).add(r["fold"])
        return fits.Criterial(COLUMNS)(train, rows)

    cells = planted(spark).withColumn("fold", (F.col("r") % 3).cast("int"))
    out = fits.mode_lifts(cells, "cell_id", 3, spied, [0.1], 2, background=100)
    assert {r.mode for r in out.collect()} == set(fits.MODES)
    assert seen and all(of not in held for (_, of), held in seen.items())


def test_permutations_tell_signal_from_noise(spark):
    cells = planted(spark, 400)
    noise = cells.withColumn("presence", (F.col("cell_id") % 11 == 0).cast("int"))
    for learner in (fits.Criterial(COLUMNS), fits.Forest(COLUMNS, trees=5, depth=4)):
        r = fits.permutation_test(cells, "cell_id", 5, learner, 0.1, 15, 200).first()
        assert r.p_value == 0 and r.observed > r.null_95 > r.null_mean
    assert fits.permutation_test(noise, "cell_id", 5, fits.Criterial(COLUMNS), 0.1, 30, 200).first()["p_value"] > 0.05
    assert fits.permutation_test(cells.withColumn("presence", F.lit(0)), "cell_id", 5, fits.Criterial(COLUMNS), 0.1, 3, 50).count() == 0


def test_ablation_finds_the_features_that_matter(spark):
    cells = planted(spark, 900).withColumn("other", ((F.col("cell_id") * 7 + F.floor(F.col("cell_id") / 11)) % 5).cast("int"))
    for learner in (fits.Criterial(COLUMNS), fits.Forest(COLUMNS, trees=10)):
        lifts = fits.feature_set_lifts(cells, "cell_id", {1: "fold", 2: "other"}, 5, learner, {"all": COLUMNS, "noise": ["f2"], "signal": ["f0", "f1"]}, 0.1, 400)
        assert lifts.count() == 30
        got = {r["set"]: r for r in fits.ablation(lifts, "all", 300).collect()}
        assert set(got) == {"noise", "signal"} and got["noise"].gain < -1 and got["noise"].significant and got["signal"].gain > got["noise"].gain
    with pytest.raises(ValueError):
        fits.ablation(lifts.where("set = 'all'"), "all")


def test_too_many_rows_of_training_are_refused(spark, monkeypatch):
    frame = fits.of_each(planted(spark), 1)
    monkeypatch.setattr(fits, "MOST_TRAINING", 100)
    forest = fits.Forest(COLUMNS, trees=1)
    with pytest.raises(Exception, match="rows of training"):
        forest.models(frame.withColumn("presence", F.col("presence"))).collect()


def test_first_of_groups(spark):
    rows = [(k, i) for k, n in (("a", 500), ("b", 3), (None, 50)) for i in range(n)]
    frame = spark.createDataFrame(rows, "k string, v long")
    got = sorted((r.k or "", r.v) for r in sampling.first_in_group(frame, ["k"], [-F.col("v")], 5).collect())
    assert got == sorted([("a", 495 + i) for i in range(5)] + [("b", i) for i in range(3)] + [("", 45 + i) for i in range(5)])


def test_nothing_to_learn_or_compare(spark):
    cells = planted(spark)
    nothing = cells.where("cell_id < 0")
    scored = cells.withColumn("score", metrics.criterial(nothing, COLUMNS))
    assert {r.score for r in scored.collect()} == {0.0}
    assert cells.withColumn("score", metrics.criterial(cells.withColumn("f1", F.lit(None).cast("double")), COLUMNS)).where("score IS NULL").count() == 0
    none = validation.resampled_lift(cells.withColumn("presence", F.lit(0)).withColumn("score", F.col("f0")), "cell_id", ["score"], 0.1, 20, 1).first()
    assert (none.lift, none.low, none.high) == (None, None, None)
    pairs = spark.createDataFrame([], "seed int, fold int, a double, b double")
    got = sampling.paired_comparison(pairs, ["seed", "fold"], "a", "b", 20, 1).first()
    assert (got.n, got["diff"], got.low, got.significant) == (0, None, None, None)


def test_segments_without_an_end_are_left_out(spark):
    seg = "geom_id long, x1 double, y1 double, x2 double, y2 double"
    points = spark.createDataFrame([(1, 0.0, 3.0), (2, 1e6, 0.0)], "k long, x double, y double")
    bad = [(2, None, 0.0, 1.0, 0.0), (3, float("nan"), 0.0, 1.0, 0.0), (4, float("inf"), 0.0, 1.0, 0.0)]
    lines = spark.createDataFrame([(1, 0.0, 0.0, 1.0, 0.0), *bad], seg)
    assert {r.k: r.distance for r in geometry.nearest_distance(points, lines, 1.0, ["k"]).collect()} == {1: 3.0, 2: 1e6 - 1}
    with pytest.raises(ValueError):
        geometry.nearest_distance(points, spark.createDataFrame(bad, seg), 1.0, ["k"])


def test_cells_are_cut_by_what_a_fit_has(spark, monkeypatch):
    monkeypatch.setattr(fits, "CHUNK_ROWS", 100)
    assert fits.chunks_of(fits.of_each(spark.range(100), 50)) == 1  # not by the cells of all fits
    assert fits.chunks_of(fits.of_each(spark.range(101), 2)) == 2 and fits.chunks_of(fits.of_each(spark.range(0), 2)) == 1


def test_permutations_score_each_cell_once(spark):
    scored = spark.sparkContext.accumulator(0)

    def learner(train, cells):
        def one(batches):
            for b in batches:
                scored.add(len(b))
                yield b.assign(score=b["f0"])

        return cells.mapInPandas(one, cells.withColumn("score", F.lit(0.0)).schema)

    fits.permutation_test(planted(spark), "cell_id", 5, learner, 0.1, 2, 300).collect()
    assert scored.value == 600 * 5 * 3


def test_leaves_of_several_depths():
    feature, threshold = np.array([[0, -1, 1, -1, -1, -1, -1]]), np.array([[0.5, 0, 0.25, 0, 0, 0, 0]])
    value = np.array([[0, 1, 0, 9, 9, 2, 4.0]])
    x = np.array([[0.5, 9], [0.6, 0.25], [0.6, 0.26], [-np.inf, 0]])
    assert fits.predict(x, feature, threshold, value).tolist() == [1, 2, 4, 1]
    assert fits.predict(np.tile(x, (3000, 1)), feature, threshold, value).tolist() == [1, 2, 4, 1] * 3000
