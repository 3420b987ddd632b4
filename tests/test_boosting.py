"""Boosting that keeps its signs, and one-class scores near an exact kernel's."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridlode.operators import boosting, metrics, models, one_class
from tests.test_fits import COLUMNS, planted


def noisy(spark, n=1500):
    cells = planted(spark, n, seed=3)
    return cells.withColumn("presence", F.when(F.col("cell_id") % 9 == 0, 1 - F.col("presence")).otherwise(F.col("presence")))


def test_scores_keep_the_signs_everywhere(spark):
    signs = {"f0": 1, "f2": -1}
    model = boosting.fit(noisy(spark), COLUMNS, signs, rounds=12)
    free = boosting.fit(noisy(spark), COLUMNS, rounds=12)
    steps = np.linspace(-0.2, 1.2, 29)
    grid = spark.createDataFrame([(float(a), float(b), float(c)) for a in steps for b in steps[::4] for c in steps], "f0 double, f1 double, f2 double")
    for j, (name, sign) in enumerate((("f0", 1), ("f2", -1))):
        def falls(m, name=name, sign=sign):
            got = m.score(grid).toPandas().sort_values([c for c in COLUMNS if c != name] + [name])
            s = got["score"].to_numpy().reshape(-1, len(steps))
            return int((sign * np.diff(s, axis=1) < -1e-12).sum())
        assert falls(model) == 0, name
        assert j == 0 or falls(free) > 0  # without signs the noise shows


def test_held_out_ranking_is_near_free_boosting(spark):
    cells = noisy(spark)
    train, rest = cells.where("fold <> 0"), cells.where("fold = 0")
    auc = lambda scored: metrics.binary_metrics(scored).first()["auc"]
    signed = auc(boosting.fit(train, COLUMNS, {"f0": 1, "f1": 1}, rounds=20).score(rest))
    assert signed > auc(models.fit_score(models.boosted(COLUMNS, rounds=20, rate=0.1), train, rest)) - 0.03
    members = boosting.bagged(train, "cell_id", COLUMNS, {"f0": 1, "f1": 1}, members=2, rounds=5)
    bag = boosting.mean_score(members, rest)
    assert auc(bag) > 0.7 and bag.columns == [*rest.columns, "score"]
    assert bag.where("score < 0 OR score > 1 OR score IS NULL").isEmpty()


def test_margins_of_training_are_those_of_scoring(spark):
    """The tree's column and its arrays say the same."""
    cells = noisy(spark, 300)
    model = boosting.fit(cells, COLUMNS, rounds=3)
    tree = model.trees[0]
    binned = np.random.default_rng(1).integers(0, 64, (200, 3))
    frame = spark.createDataFrame([(i, b.tolist()) for i, b in enumerate(binned)], "k int, b array<int>")
    got = {r.k: r.v for r in frame.withColumn("v", tree.column(F.col("b"))).collect()}
    assert [got[i] for i in range(200)] == tree.leaves(binned).tolist()


def test_one_class_and_odd_rows(spark):
    cells = noisy(spark, 300)
    with pytest.raises(ValueError):
        boosting.fit(cells.where("presence = 1"), COLUMNS)
    with pytest.raises(ValueError):
        boosting.fit(cells.where("cell_id < 0"), COLUMNS)
    odd = cells.withColumn("f1", F.lit(None).cast("double")).withColumn("f0", F.when(F.col("cell_id") % 5 == 0, float("inf")).otherwise(F.col("f0")))
    assert boosting.fit(odd, COLUMNS, rounds=2).score(odd).where("score IS NULL").isEmpty()
    assert boosting.fit(cells, COLUMNS, rounds=1).score(cells.where("cell_id < 0")).count() == 0
    assert boosting.signs_of(["prox_a", "pen", "geo", "x"], ("pen",), ("geo",)) == {"prox_a": 1, "pen": -1, "geo": 1}


def exact(x, q, nu, gamma):
    """The same dual over the whole kernel matrix, by many steps."""
    kernel = lambda a, b: np.exp(-gamma * ((a[:, None] - b[None]) ** 2).sum(-1))
    k, n = kernel(x, x), len(x)
    alpha = np.full(n, 1 / n)
    for _ in range(4000):
        s = k @ alpha
        order, target = np.argsort(s), np.zeros(n)
        full = int(nu * n)
        target[order[:full]] = 1 / (nu * n)
        target[order[full]] += max(0.0, 1 - target.sum())
        step = alpha - target
        size = step @ k @ step
        if size < 1e-15:
            break
        alpha = alpha - min(1.0, max(0.0, (s @ step) / size)) * step
    s = k @ alpha
    return kernel(q, x) @ alpha - np.quantile(s, nu), s


@pytest.mark.parametrize("nu", [0.1, 0.3])
def test_near_the_exact_kernel(spark, nu):
    rng = np.random.default_rng(5)
    x = np.vstack([rng.normal(0, 1, (300, 3)), rng.normal(4, 0.5, (200, 3))])
    q = rng.uniform(-4, 7, (400, 3))
    frame = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], "k int, f0 double, f1 double, f2 double")
    model = one_class.fit(frame, COLUMNS, nu, rounds=30, size=1024)
    inside = model.score(frame).toPandas()["score"].to_numpy()
    assert abs((inside < 0).mean() - nu) < 0.02
    got = model.score(spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(q)], "k int, f0 double, f1 double, f2 double")).toPandas().sort_values("k")["score"].to_numpy()
    z = lambda v: (v - x.mean(0)) / x.std(0)
    want, _ = exact(z(x), z(q), nu, 1 / 3)
    rank = lambda v: np.argsort(np.argsort(v))
    near = want > np.quantile(want, 0.3)  # far away both are flat
    assert np.corrcoef(rank(got[near]), rank(want[near]))[0, 1] > 0.95
    assert ((got > 0) == (want > 0)).mean() > 0.93


def test_one_class_without_rows(spark):
    with pytest.raises(ValueError):
        one_class.fit(planted(spark).where("cell_id < 0"), COLUMNS)
    same = spark.createDataFrame([(1.0, 2.0, None)] * 20, "f0 double, f1 double, f2 double")
    assert one_class.fit(same, COLUMNS, size=16).score(same).where("score IS NULL").isEmpty()
