"""Forests that learn from all cells: counted in tasks they are the trees that a plain search grows, and thresholds are exact."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridlode.operators import fits, forests, metrics, sampling
from gridlode.plans.materialize import materialize
from tests.test_fits import COLUMNS, planted

SCHEMA = "cell_id long, fold int, presence int, f0 double, f1 double, f2 double, f3 double"
K = 4


@pytest.fixture(scope="module")
def odd(spark):
    """Presence and folds are missing or never held out here and there, features are missing, infinite or all but constant."""
    rng, rows = random.Random(5), []
    for i in range(700):
        x = [rng.gauss(0, 1), rng.choice([0.5, 1.5, 2.5]), rng.random() if i % 9 else float("nan"), 7.0 if i % 50 else None]
        rows.append((i * 3 - 40, None if i == 11 else 9 if i == 12 else i % 3, None if i % 97 == 5 else int(x[0] + rng.random() > 1.6), *x))
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


def encoded(cells, draws=2):
    number = cells.agg(F.sum("presence")).first()[0]
    labels = [F.col("presence"), *forests.random_labels(cells, "cell_id", draws, number, 42)]
    return forests.encoded(cells, "cell_id", [f"f{i}" for i in range(K)], labels, 3)


def plain_tree(block, times, label, weights, seed, fit, t, depth, leaf):
    """feature, cut and value by trying each cut of each node's rows."""
    n = 2 ** (depth + 1) - 1
    feature, cut, value, rows = np.full(n, -1), np.zeros(n, int), np.zeros(n), {0: np.repeat(np.arange(len(label)), times)}
    share = lambda r: (weights[1] * (label[r] == 1).sum()) / ((label[r] == 1) * weights[1] + (label[r] == 0) * weights[0]).sum()
    impure = lambda r: ((label[r] == 1) * weights[1] + (label[r] == 0) * weights[0]).sum() * share(r) * (1 - share(r))
    for node in range(n):
        if node not in rows:
            continue
        r, level = rows[node], (node + 1).bit_length() - 1
        value[node] = share(r)
        found = (1e-12, None)
        if level < depth:
            for f in forests.tried(seed, fit, t, level, K)[:, node + 1 - 2**level]:
                for c in range(forests.BINS):
                    left, right = r[block.x[f][r] <= c], r[block.x[f][r] > c]
                    if min(len(left), len(right)) >= leaf and (gain := impure(r) - impure(left) - impure(right)) > found[0] + 1e-9:
                        found = (gain, (f, c, left, right))
        if found[1]:
            feature[node], cut[node], rows[2 * node + 1], rows[2 * node + 2] = found[1]
    return feature, cut, value, rows


def test_trees_and_thresholds_are_those_of_a_plain_search(spark, odd):
    trees, depth, leaf, seed, every = 5, 4, 3, 42, [(d, k) for d in range(3) for k in range(3)]
    rows = encoded(odd)
    grown = forests.grow(rows, every, K, trees, depth, leaf, seed)
    assert grown.fits == every
    got = {(r.draw, r.fold): r.coverage for r in forests.coverage(rows, grown, 0.9).collect()}
    (block,) = forests.blocks(iter(rows.toArrow().to_batches()), 10**6)
    assert len(block) == 700
    for i, fit in enumerate(every):
        label, trains = block.y[fit[0]], block.trains(fit)
        assert trains.sum() == sum(f not in (-1, fit[1]) and y < 2 for f, y in zip(block.fold, label, strict=True)) > 440
        n, p = trains.sum(), (label[trains] == 1).sum()
        weights, scores = (n / (2 * (n - p)), n / (2 * p)), np.zeros(700)
        for t, times in enumerate(block.times(fit, trees, seed)):
            feature, cut, value, held = plain_tree(block, times, label, weights, seed, fit, t, depth, leaf)
            own = np.array(sorted(held))
            assert (grown.feature[i, t][own] == feature[own]).all() and (grown.cut[i, t][own] == cut[own])[feature[own] >= 0].all()
            assert grown.value[i, t][own] == pytest.approx(value[own])
            for r in range(700):
                node = 0
                while feature[node] >= 0:
                    node = 2 * node + 1 + (block.x[feature[node]][r] > cut[node])
                scores[r] += grown.value[i, t][node]
        scores /= trees
        assert (grown.scores(block, i) == scores).all() and grown.low[i] - 1e-12 <= scores.min() <= scores.max() <= grown.high[i] + 1e-12
        reached = scores >= np.quantile(scores, 0.9)
        assert got[fit] == pytest.approx(reached[block.held(fit)].mean())


def test_bins_are_between_quantiles_of_all_cells(spark, odd):
    got = {r.number: r for r in encoded(odd).collect()}
    rows = odd.withColumn("number", F.xxhash64("cell_id")).toPandas().set_index("number")
    x = np.nan_to_num(rows[["f0", "f1", "f2", "f3"]].to_numpy(float))
    for j in range(K):
        edges = np.unique(np.quantile(x[:, j], np.linspace(0, 1, forests.BINS + 1)[1:-1]))
        assert [got[n].x[j] for n in rows.index] == np.searchsorted(edges, x[:, j], "left").tolist()
    assert all(got[n].y[0] == (2 if np.isnan(p) else p) for n, p in rows["presence"].items())
    assert all(got[n].fold == (-1 if np.isnan(f) else min(f, 3)) for n, f in rows["fold"].items())


@pytest.mark.parametrize("number", [0, 1, 37, 700])
def test_labels_of_a_draw_are_the_first_by_hash(spark, odd, number):
    labels = forests.random_labels(odd, "cell_id", 3, number, 42)
    got = odd.select("cell_id", *[c.alias(f"d{i}") for i, c in enumerate(labels, 1)])
    for d in (1, 2, 3):
        first = odd.orderBy(sampling.random_order(42, F.lit(d), F.col("cell_id"))).limit(number)
        assert {r.cell_id for r in got.where(f"d{d} = 1").collect()} == {r.cell_id for r in first.collect()}


def test_cells_are_drawn_with_replacement_by_their_number():
    number = np.random.default_rng(1).integers(0, 2**63, 40_000).astype(np.uint64)
    block = lambda at: forests.Block(np.zeros((1, len(at)), np.uint8), np.zeros((2, len(at)), np.uint8), (at % 5).astype(np.int32), number[at])
    whole, some = block(np.arange(40_000)), np.arange(0, 40_000, 7)[::-1]
    drawn = {fit: list(whole.times(fit, 6, 42)) for fit in ((0, 1), (1, 1))}
    for fit, each in drawn.items():
        assert len(each) == 6 and all((a == b[some]).all() for a, b in zip(block(some).times(fit, 6, 42), each, strict=True))
        for times in each:
            assert times[1::5].max() == 0
            own = np.delete(times, np.arange(1, 40_000, 5)).astype(float)
            assert abs(own.mean() - 1) < 0.03 and abs(own.var() - 1) < 0.06 and abs((own == 0).mean() - np.exp(-1)) < 0.01
    flat = [t.astype(float) for each in drawn.values() for t in each]
    assert np.abs(np.corrcoef([np.delete(t, np.arange(1, 40_000, 5)) for t in flat]) - np.eye(12)).max() < 0.03


def test_models_of_permutations_learn_from_all_cells(spark, monkeypatch):
    """More background than the 2,000 cells that were drawn of it: none is left out, whatever the learner."""
    cells, seen = planted(spark, 3000), []

    def spied(train, every):
        seen.extend(train.groupBy("fit").count().collect())
        return fits.Criterial(COLUMNS)(train, every)

    assert fits.permutation_test(cells, "cell_id", 5, spied, 0.1, 1).count() == 1
    assert [r["count"] for r in seen] == [2400] * 10
    monkeypatch.setattr(sampling, "first_in_group", lambda *_: pytest.fail("background was drawn"))
    monkeypatch.setattr(fits, "MOST_TRAINING", 100)
    weights = []
    monkeypatch.setattr(forests, "class_weights", lambda rows, every, found=forests.class_weights: weights.append(found(rows, every)) or weights[-1])
    r = fits.permutation_test(cells, "cell_id", 5, fits.Forest(COLUMNS, trees=5, depth=4), 0.1, 7).first()
    assert r.p_value == 0 and r.observed > 5 > r.null_95 > r.null_mean > 0.3
    assert len(weights[0]) == 40 and all(1 / w + 1 / p == pytest.approx(2) for w, p in weights[0].values())


def test_permutations_do_not_depend_on_partitions(spark, monkeypatch):
    cells, got = planted(spark, 900), []
    for tasks, size, held in ((1, 100_000, 1 << 30), (7, 100, 40_000)):
        monkeypatch.setattr(forests, "TASK_ROWS", -(-900 // tasks))
        monkeypatch.setattr(forests, "BLOCK_ROWS", size)
        monkeypatch.setattr(forests, "COUNT_BYTES", held)
        monkeypatch.setattr(forests, "MOST_ROWS", size)
        got.append(fits.permutation_test(cells.repartition(tasks + 1), "cell_id", 5, fits.Forest(COLUMNS, trees=4, depth=5), 0.1, 3).collect())
    assert got[0] == got[1] and len(got[0]) == 1


def test_permutations_without_presence_background_or_cells(spark):
    cells, forest = planted(spark, 100), fits.Forest(COLUMNS, trees=2, depth=2)
    for none in (cells.withColumn("presence", F.lit(0)), cells.withColumn("presence", F.lit(1)), cells.where("cell_id < 0")):
        assert fits.permutation_test(none, "cell_id", 5, forest, 0.1, 2).count() == 0
    one = cells.withColumn("presence", (F.col("fold") == 0).cast("int"))  # what is left without it has one class
    assert fits.permutation_test(one, "cell_id", 5, forest, 0.1, 2).count() == 0


def test_trees_may_be_deep(spark):
    cells = planted(spark, 2000)
    rows = forests.encoded(cells, "cell_id", COLUMNS, [(F.col("cell_id") % 2).cast("int")], 5)
    grown = forests.grow(rows, [(0, 1)], 3, 1, 10, 1, 1)
    (block,) = forests.blocks(iter(rows.toArrow().to_batches()), 10**6)
    assert block.places(grown.feature[0, 0], grown.cut[0, 0], 10).max() > 255
    feature, cut, value, walked = grown.feature[0, 0], grown.cut[0, 0], grown.value[0, 0], []
    for r in range(2000):
        node = 0
        while feature[node] >= 0:
            node = 2 * node + 1 + (block.x[feature[node]][r] > cut[node])
        walked.append(value[node])
    assert (grown.scores(block, 0) == walked).all()


def test_common_values_are_dealt_over_tasks(spark):
    melted = spark.range(4000).select(F.col("id").alias("k"), F.lit(0).alias("feature"), F.greatest(F.col("id") - 3000, F.lit(0)).cast("double").alias("v"))
    seen = []
    ranges = metrics.materialize

    def spied(rows):
        out = ranges(rows)
        seen.extend(r["count"] for r in out.groupBy("_part").count().collect())
        return out

    coalesce = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(coalesce, "false")  # so little would be one partition
    try:
        with pytest.MonkeyPatch.context() as patch:
            patch.setattr(metrics, "materialize", spied)
            (own,) = forests.edges(melted, "k", 1, 4000)
    finally:
        spark.conf.unset(coalesce)
    assert len(seen) > 1 and max(seen) < 2000
    assert own.tolist() == np.unique(np.quantile(np.maximum(np.arange(4000) - 3000, 0.0), np.linspace(0, 1, 65)[1:-1])).tolist()


def test_forests_of_whole_cells_rank_as_well_as_those_of_one_group(spark):
    cells = planted(spark, 1500).withColumn("presence", ((F.col("f0") + F.col("f1") + F.rand(3)) > 2.2).cast("int"))
    cells = materialize(cells)
    forest = fits.Forest(COLUMNS, trees=40)
    held = metrics.top_area_by_group(fits.held_out(cells, "cell_id", 5, forest, 10_000, 42), ["fold"], [0.1], "oof").agg(F.avg("coverage")).first()[0]
    whole = forest.held_coverage(cells, "cell_id", [F.col("presence")], 5, 0.9).agg(F.avg("coverage")).first()[0]
    assert abs(held - whole) < 0.08 and whole > 0.2
