"""Many small fits in one job: a fit is a key (column fit) of its training rows, and a learner learns all of them at once.

A learner takes training rows (fit, presence, columns) and cells (fit, columns) and gives the cells their score under the model
of their fit. The criterial learner aggregates; the forest grows each fit's trees in an executor, from one bounded group:
presence, which is rare, and a drawn background. Models are rows of arrays and meet the cells of their fit in groups of about
CHUNK_ROWS, so a model may score any number of cells. Labels, backgrounds and features may differ by fit.

Null, infinite and NaN features count as 0. A fit without both classes has no model, and its cells have no score.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridlode.functions.numeric import finite
from gridlode.operators import forests, metrics, sampling
from gridlode.operators.grid import disc
from gridlode.plans.materialize import materialize

Learner = Callable[[DataFrame, DataFrame], DataFrame]
#: Cells that meet a model in one group, and rows that a group of training may have.
CHUNK_ROWS, MOST_TRAINING = 100_000, 1_000_000
BINS = 64
#: Rows that walk through a tree at a time.
PREDICT_ROWS = 4096


@dataclass
class Criterial:
    """The criterial index; of a fit's features only those that its column use names, where there is one."""

    columns: list[str]

    def __call__(self, train: DataFrame, cells: DataFrame) -> DataFrame:
        y = F.col("presence").cast("double")
        sums = [f.alias(f"_{k}{i}") for i, c in enumerate(self.columns) for k, f in (("m", F.avg(c)), ("s", F.stddev_pop(c)), ("x", F.avg(F.col(c) * y)))]
        used = [F.first("use").alias("_use")] if "use" in train.columns else []
        learnt = train.groupBy("fit").agg(F.avg(y).alias("_y"), *used, *sums)
        total = F.lit(0.0)
        for i, c in enumerate(self.columns):
            covariance = F.col(f"_x{i}") - F.col(f"_m{i}") * F.col("_y")
            sign = F.when(F.abs(covariance) < 1e-12, 0.0).otherwise(F.signum(covariance))
            part = F.coalesce(sign, F.lit(0.0)) * F.coalesce((F.col(c) - F.col(f"_m{i}")) / (F.col(f"_s{i}") + 1e-9), F.lit(0.0))
            total = total + (F.when(F.array_contains("_use", c), part).otherwise(0.0) if used else part)
        number = F.size("_use") if used else F.lit(len(self.columns))
        # one row per fit on the one side: Spark broadcasts it if it is small
        return cells.join(learnt, "fit").select(*cells.columns, (total / number).alias("score"))


def grow(x: np.ndarray, y: np.ndarray, trees: int, depth: int, leaf: int, seed: int, allowed: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Features, thresholds and values of the nodes of each tree (heap order), and the features' importances.

    Features are cut into bins by quantiles once; each level of a tree is one histogram over node, feature and bin. Both
    classes weigh alike, rows are drawn with replacement, and each node chooses among the root of the number of features.
    """
    rng, (n, k) = np.random.default_rng(seed), x.shape
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(k)]
    binned = np.stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(edges)], axis=1)
    weight = np.where(y == 1, n / (2.0 * max(1, y.sum())), n / (2.0 * max(1, n - y.sum())))
    nodes, tries = 2 ** (depth + 1) - 1, max(1, int(np.sqrt(len(allowed))))
    feature, threshold, value = np.full((trees, nodes), -1), np.zeros((trees, nodes)), np.zeros((trees, nodes))
    gained = np.zeros(k)
    at_column = np.arange(k) * BINS
    for t in range(trees):
        times = np.bincount(rng.integers(0, n, n), minlength=n)
        rows = np.flatnonzero(times)
        b, count = binned[rows], times[rows].astype(float)
        w = count * weight[rows]
        positive, node = w * y[rows], np.zeros(len(rows), np.int64)
        for level in range(depth + 1):
            first, width = 2**level - 1, 2**level
            own = node - first
            held = own >= 0
            all_w, all_p = np.bincount(own[held], w[held], width), np.bincount(own[held], positive[held], width)
            value[t, first : first + width] = np.divide(all_p, all_w, out=np.zeros(width), where=all_w > 0)
            if level == depth or not held.any():
                break
            slot = ((own[held, None] * k * BINS) + at_column + b[held]).ravel()
            shape = (width, k, BINS)
            cw, cp, cn = (np.cumsum(np.bincount(slot, np.repeat(v[held], k), width * k * BINS).reshape(shape), axis=2) for v in (w, positive, count))
            tw, tp, tn = (v[:, :, -1:] for v in (cw, cp, cn))
            impure = lambda a, p: np.divide(p * (a - p), a, out=np.zeros_like(a), where=a > 0)
            gain = impure(tw, tp) - impure(cw, cp) - impure(tw - cw, tp - cp)
            gain[(cn < leaf) | (tn - cn < leaf)] = -1.0
            tried = np.zeros((width, k), bool)
            np.put_along_axis(tried, allowed[np.argsort(rng.random((width, len(allowed))), axis=1)[:, :tries]], True, axis=1)
            gain[~tried] = -1.0
            best = gain.reshape(width, -1).argmax(axis=1)
            top = gain.reshape(width, -1)[np.arange(width), best]
            split = top > 1e-12
            j, cut = best // BINS, best % BINS
            feature[t, first : first + width] = np.where(split, j, -1)
            threshold[t, first : first + width] = [edges[f][c] if s and c < len(edges[f]) else 0.0 for f, c, s in zip(j, cut, split, strict=True)]
            np.add.at(gained, j[split], top[split] / w.sum())
            goes = held & split[np.where(held, own, 0)]
            right = b[np.arange(len(rows)), j[np.where(held, own, 0)]] > cut[np.where(held, own, 0)]
            node = np.where(goes, 2 * node + 1 + right, -1)
    return feature, threshold, value, gained / max(gained.sum(), 1e-12)


def predict(x: np.ndarray, feature: np.ndarray, threshold: np.ndarray, value: np.ndarray) -> np.ndarray:
    """Mean over the trees of the value of each row's leaf; leaves lead to themselves, so that all rows take as many steps."""
    (trees, nodes), (n, k), total = feature.shape, x.shape, np.zeros(len(x))
    inner = feature >= 0
    column, limit = np.where(inner, feature, 0), np.where(inner, threshold, np.inf)
    child = np.where(inner, 2 * np.arange(nodes) + 1, np.arange(nodes))
    for lo in range(0, n, PREDICT_ROWS):
        part = np.ascontiguousarray(x[lo : lo + PREDICT_ROWS])
        cells, first = part.ravel(), np.arange(len(part)) * k
        for t in range(trees):
            node = np.zeros(len(part), np.int64)
            for _ in range(nodes.bit_length() - 1):
                node = child[t].take(node) + (cells.take(first + column[t].take(node)) > limit[t].take(node))
            total[lo : lo + PREDICT_ROWS] += value[t].take(node)
    return total / trees


@dataclass
class Forest:
    """A random forest per fit; of a fit's features only those that its column use names, where there is one."""

    columns: list[str]
    trees: int = 100
    depth: int = 7
    leaf: int = 12
    seed: int = 42

    def models(self, train: DataFrame) -> DataFrame:
        """fit, feature, threshold, value (arrays over trees and nodes) and importance (by feature)."""
        columns, use = self.columns, "use" in train.columns
        trees, depth, leaf, seed = self.trees, self.depth, self.leaf, self.seed
        rows = train.select("fit", F.col("presence").cast("int").alias("presence"), *(["use"] if use else []), *_filled(columns))

        def one(group: pd.DataFrame) -> pd.DataFrame:
            if len(group) > MOST_TRAINING:
                raise ValueError(f"{len(group)} rows of training in one fit; draw a background, or take an estimator of operators.models")
            y = group["presence"].to_numpy()
            if y.min() == y.max():
                return pd.DataFrame({"fit": pd.Series([], dtype="int64"), **{c: pd.Series([], dtype=object) for c in ("feature", "threshold", "value", "importance")}})
            fit = int(group["fit"].iloc[0])
            allowed = np.array([columns.index(c) for c in group["use"].iloc[0]]) if use else np.arange(len(columns))
            x = group[columns].to_numpy(float)
            order = np.lexsort((*x.T, y))  # the same fit in whatever order the rows come
            f, t, v, importance = grow(x[order], y[order], trees, depth, leaf, seed * 1_000_003 + fit, allowed)
            return pd.DataFrame({"fit": [fit], "feature": [f.ravel()], "threshold": [t.ravel()], "value": [v.ravel()], "importance": [importance]})

        return rows.groupBy("fit").applyInPandas(one, "fit long, feature array<int>, threshold array<double>, value array<double>, importance array<double>")

    def score(self, cells: DataFrame, models: DataFrame) -> DataFrame:
        """cells with score."""
        columns, trees = self.columns, self.trees
        chunks = chunks_of(cells)
        rows = cells.withColumn("_chunk", F.pmod(F.xxhash64(*cells.columns), F.lit(chunks)).cast("int"))
        rows = rows.select(*cells.columns, "_chunk", F.array(*_filled(columns)).alias("_x"))
        each = models.withColumn("_chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))))
        names = cells.columns

        def one(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
            if left.empty or right.empty:
                return left[names].iloc[:0].assign(score=0.0)
            x = np.stack(left["_x"].to_numpy()).astype(float)
            f, t, v = (np.asarray(right[k].iloc[0]).reshape(trees, -1) for k in ("feature", "threshold", "value"))
            return left[names].assign(score=predict(x, f, t, v))

        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in cells.schema.fields)
        return rows.groupBy("fit", "_chunk").cogroup(each.groupBy("fit", "_chunk")).applyInPandas(one, f"{schema}, score double")

    def __call__(self, train: DataFrame, cells: DataFrame) -> DataFrame:
        return self.score(cells, materialize(self.models(train)))

    def held_coverage(self, cells: DataFrame, key: str, labels: list[Column], folds: int, share: float) -> DataFrame:
        """draw (the place of a label), fold and coverage of held-out presence above the share of all scores, learnt from all cells of the other folds."""
        rows = forests.encoded(cells, key, self.columns, labels, folds)
        every = [(d, k) for d in range(len(labels)) for k in range(folds)]
        return forests.coverage(rows, forests.grow(rows, every, len(self.columns), self.trees, self.depth, self.leaf, self.seed), share)


def chunks_of(cells: DataFrame) -> int:
    """Groups that the cells of a fit are cut into, so that each has about CHUNK_ROWS; a model is copied to all of its fit's."""
    most = cells.groupBy("fit").count().agg(F.max("count")).first()[0]
    return max(1, -(-(most or 0) // CHUNK_ROWS))


def _filled(columns: list[str]) -> list[Column]:
    return [F.coalesce(finite(F.col(c)), F.lit(0.0)).alias(c) for c in columns]


def of_each(rows: DataFrame, n: int, name: str = "fit") -> DataFrame:
    """rows once for each of n fits, which are few and not a table."""
    return rows.withColumn(name, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))))


def with_background(rows: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """Of each fit's rows all presence, and n others in an order that depends on seed, fit and key alone."""
    drawn = sampling.first_in_group(rows.where("presence = 0"), ["fit"], [sampling.random_order(seed, F.col("fit"), F.col(key)), F.col(key)], n)
    return rows.where("presence = 1").unionByName(drawn)


def held_out(cells: DataFrame, key: str, folds: int, learner: Learner, background: int, seed: int) -> DataFrame:
    """key, fold, presence and oof: the rank, among the scores of all cells, that the model of the other folds gives a cell (column fold).

    All folds are one job. Cells of a fold whose others lack a class have no oof.
    """
    cells = materialize(cells)
    train = with_background(of_each(cells, folds).where(F.col("fold") != F.col("fit")), key, background, seed)
    return _ranked(learner(train, of_each(cells, folds)), cells, key, [])


def _ranked(scored: DataFrame, cells: DataFrame, key: str, by: list[str]) -> DataFrame:
    """by, key, fold, presence and oof of each cell under the fit that held out its fold."""
    ranked = metrics.rank_within(scored.select("fit", *by, key, "fold", "score", (F.col("fit") % F.lit(1 << 20)).alias("_of")), ["fit"], "score", key)
    own = ranked.where(F.col("_of") == F.col("fold")).select(*by, key, F.col("rank01").alias("oof"))
    if not by:
        return cells.select(key, "fold", "presence").join(own, key, "left")
    return own.join(cells.select(key, "fold", "presence"), key)


def held_lifts(scored: DataFrame, areas: list[float], by: list[str] | None = None) -> DataFrame:
    """by, area, coverage and lift of presence by held-out scores (oof); thresholds are over all held-out scores, cells without one left out."""
    keys = by or ["_all"]
    rows = scored.where("oof IS NOT NULL")
    rows = rows if by else rows.withColumn("_all", F.lit(0))
    return metrics.top_area_by_group(rows, keys, areas, "oof").select(*(by or []), "area", "coverage", "lift")


#: Modes of training: reliable negatives, halo as presence.
MODES = {"baseline": (False, False), "reliable": (True, False), "halo": (False, True), "both": (True, True)}


def mode_lifts(cells: DataFrame, key: str, folds: int, learner: Learner, areas: list[float], radius: int, background: int = 2000, share: float = 0.6, seed: int = 42) -> DataFrame:
    """mode, area, coverage and lift of held-out presence (cells r, c; column fold), learnt in each of MODES. All modes and folds are one job.

    The halo is that of the presence in the fold's training blocks, and only its cells in those blocks count as presence. With
    reliable negatives a first model ranks the negatives, and a new background is drawn from the lowest share.
    """
    cells = materialize(cells)
    modes = list(MODES)
    every = of_each(of_each(cells, len(modes), "_mode"), folds, "_fold").withColumn("fit", F.col("_mode") * (1 << 20) + F.col("_fold"))
    train = every.where(F.col("fold") != F.col("_fold"))
    flag = lambda i: F.col("_mode").isin([k for k, m in enumerate(modes) if MODES[m][i]])
    seeds = train.where((F.col("presence") == 1) & flag(1)).select("fit", "r", "c")
    steps = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in disc(radius)])
    near = seeds.withColumn("_o", F.explode(steps)).select("fit", (F.col("r") + F.col("_o.a")).alias("r"), (F.col("c") + F.col("_o.b")).alias("c"), F.lit(1).alias("_near")).distinct()
    train = train.join(near, ["fit", "r", "c"], "left").withColumn("presence", F.greatest("presence", F.coalesce("_near", F.lit(0)))).drop("_near")
    train = materialize(train)
    trusting = train.where(flag(0))
    first = materialize(learner(with_background(trusting, key, background, seed), trusting.where("presence = 0")))
    limits = metrics.grouped_quantiles(first, ["fit"], "score", [share])
    reliable = first.join(limits.select("fit", "limit"), "fit").where(F.col("score") <= F.col("limit")).select(train.columns)
    final = train.where(~flag(0)).unionByName(trusting.where("presence = 1")).unionByName(reliable)
    scored = learner(with_background(final, key, background, seed + 1), every)
    named = F.element_at(F.array(*[F.lit(m) for m in modes]), (F.col("_mode") + 1).cast("int"))
    return held_lifts(_ranked(scored.withColumn("mode", named), cells, key, ["mode"]), areas, ["mode"])


def permutation_test(cells: DataFrame, key: str, folds: int, learner: Learner, area: float, draws: int, background: int | None = None, seed: int = 42) -> DataFrame:
    """observed, null_mean, null_95 and p_value of the mean lift over held-out folds (column fold).

    In every draw as many random cells as there are of presence take their place, and a model is learnt again in every fold: from
    all cells of the other folds, or from their presence and so much drawn background. All fits are one job. Folds without presence
    are left out of a draw's mean.
    """
    cells = materialize(cells)
    total, positives = cells.agg(F.count(F.lit(1)), F.sum("presence")).first()
    if background is None and isinstance(learner, Forest):
        labels = [F.col("presence"), *forests.random_labels(cells, key, draws, positives or 0, seed)]
        by_fold = learner.held_coverage(cells, key, labels, folds, 1.0 - area).withColumnRenamed("draw", "_draw")
    else:
        by_fold = _refitted(cells, key, folds, learner, 1.0 - area, draws, background, seed, total, positives or 0)
    lifts = materialize(by_fold.groupBy("_draw").agg((F.avg("coverage") / area).alias("lift")))
    seen = lifts.where("_draw = 0").select(F.col("lift").alias("observed"))
    null = lifts.where("_draw > 0").crossJoin(F.broadcast(seen))  # one row
    return null.groupBy("observed").agg(F.avg("lift").alias("null_mean"), F.percentile("lift", 0.95).alias("null_95"), F.avg((F.col("lift") >= F.col("observed") - 1e-12).cast("int")).alias("p_value"))


def _refitted(cells: DataFrame, key: str, folds: int, learner: Learner, share: float, draws: int, background: int | None, seed: int, total: int, positives: int) -> DataFrame:
    """_draw, _fold and coverage by any learner; draw and fold are one key."""
    each = of_each(cells, draws + 1, "_draw").withColumn("_h", sampling.random_order(seed, F.col("_draw"), F.col(key)))
    ranked = metrics.rank_within(each, ["_draw"], "_h", key)
    drawn = (F.col("rank01") * max(total - 1, 1) < positives - 0.5).cast("int")
    labelled = materialize(ranked.withColumn("presence", F.when(F.col("_draw") == 0, F.col("presence")).otherwise(drawn)).drop("rank01", "_h"))
    every = of_each(labelled, folds, "_fold").withColumn("fit", F.col("_draw") * (1 << 20) + F.col("_fold"))
    train = every.where(F.col("fold") != F.col("_fold"))
    train = train if background is None else with_background(train, key, background, seed)
    scored = materialize(learner(train, every).select("_draw", "_fold", "fold", "presence", "score"))
    limits = metrics.grouped_quantiles(scored, ["_draw", "_fold"], "score", [share])
    hits = scored.where("presence = 1 AND fold = _fold").join(limits, ["_draw", "_fold"])
    return hits.groupBy("_draw", "_fold").agg(F.avg((F.col("score") >= F.col("limit")).cast("int")).alias("coverage"))


def feature_set_lifts(cells: DataFrame, key: str, folds: dict[int, str], n: int, learner: Learner, sets: dict[str, list[str]], area: float, background: int = 2000) -> DataFrame:
    """set, seed, fold and lift on held-out presence of a model of each set of features.

    folds gives the column of folds of every seed. Sets of a seed share folds and backgrounds, so they can be compared in
    pairs. All sets, seeds and folds are one job.
    """
    cells, names = materialize(cells), list(sets)
    seeds = list(folds)
    own = reduce(lambda out, k: F.when(F.col("_seed") == k, F.col(folds[seeds[k]])).otherwise(out), range(len(seeds)), F.lit(None))
    each = of_each(of_each(cells, len(seeds), "_seed"), n, "_fold").withColumn("fold", own).withColumn("fit", F.col("_seed") * (1 << 10) + F.col("_fold"))
    train = materialize(with_background(each.where(F.col("fold") != F.col("_fold")), key, background, seeds[0]))
    uses = F.element_at(F.array(*[F.array(*[F.lit(c) for c in sets[s]]) for s in names]), (F.col("_set") + 1).cast("int"))
    several = lambda rows: of_each(rows, len(names), "_set").withColumn("fit", F.col("fit") + F.col("_set") * (1 << 40))
    scored = materialize(learner(several(train).withColumn("use", uses), several(each)))
    limits = metrics.grouped_quantiles(scored, ["fit"], "score", [1.0 - area])
    hit = F.avg((F.col("score") >= F.col("limit")).cast("int")) / area
    found = scored.where("presence = 1 AND fold = _fold").join(limits, "fit").groupBy("_set", "_seed", "_fold").agg(hit.alias("lift"))
    name = lambda values, c: F.element_at(F.array(*[F.lit(v) for v in values]), (F.col(c) + 1).cast("int"))
    return found.select(name(names, "_set").alias("set"), name(seeds, "_seed").alias("seed"), F.col("_fold").cast("int").alias("fold"), "lift")


def ablation(lifts: DataFrame, base: str, draws: int = 2000, seed: int = 42) -> DataFrame:
    """set, n, gain over the base set with its interval (low, high), win_rate and significant: one row per set, pairs by seed and fold."""
    lifts = materialize(lifts)
    others = sorted(r["set"] for r in lifts.select("set").distinct().collect() if r["set"] != base)  # one per set
    first = lifts.where(F.col("set") == base).select("seed", "fold", F.col("lift").alias("a"))
    out = []
    for name in others:
        pairs = first.join(lifts.where(F.col("set") == name).select("seed", "fold", F.col("lift").alias("b")), ["seed", "fold"])
        compared = sampling.paired_comparison(pairs, ["seed", "fold"], "a", "b", draws, seed)
        out.append(compared.select(F.lit(name).alias("set"), "n", F.col("diff").alias("gain"), "low", "high", "win_rate", "significant"))
    if not out:
        raise ValueError(f"no set besides {base}")
    return reduce(DataFrame.unionByName, out)


def kept_features(models: DataFrame, columns: list[str]) -> DataFrame:
    """feature, mean importance over the models, and kept: whether it is above the mean of all."""
    each = models.select(F.posexplode("importance").alias("at", "v")).groupBy("at").agg(F.avg("v").alias("importance"))
    named = each.select(F.element_at(F.array(*[F.lit(c) for c in columns]), F.col("at") + 1).alias("feature"), "importance")
    return named.withColumn("kept", F.col("importance") > 1.0 / len(columns))  # importances add up to 1
