"""Gradient boosting of presence whose score may not fall, or not rise, with chosen features.

Values are put into bins once; each level of a tree is one aggregate by node, feature and bin, so only histograms of a
size that the model sets (nodes x features x bins) come to the driver, which chooses the cuts. A cut of a signed feature is refused
where its two values would be in the wrong order, and both halves are kept on their side of the middle from then on, which makes
the whole model monotone. The rows keep their margins, checkpointed every few rounds.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridlode.functions.numeric import finite
from gridlode.operators.models import balanced
from gridlode.plans.materialize import materialize

BINS = 64
#: Rounds between two checkpoints of the rows.
CHECKPOINT_ROUNDS = 8


@dataclass
class Tree:
    """Nodes in heap order: the feature that is cut (-1: a leaf), the last bin of the left half, and the value."""

    feature: np.ndarray
    cut: np.ndarray
    value: np.ndarray

    def leaves(self, binned: np.ndarray) -> np.ndarray:
        node, rows = np.zeros(len(binned), np.int64), np.arange(len(binned))
        while (inner := self.feature[node] >= 0).any():
            right = binned[rows, np.maximum(self.feature[node], 0)] > self.cut[node]
            node = np.where(inner, 2 * node + 1 + right, node)
        return self.value[node]

    def column(self, binned: Column, node: int = 0) -> Column:
        """The value of each row's leaf."""
        if self.feature[node] < 0:
            return F.lit(float(self.value[node]))
        left = binned[int(self.feature[node])] <= int(self.cut[node])
        return F.when(left, self.column(binned, 2 * node + 1)).otherwise(self.column(binned, 2 * node + 2))

    def node(self, binned: Column, at: int = 0) -> Column:
        """The number of the node that a row has come to."""
        if self.feature[at] < 0:
            return F.lit(at)
        left = binned[int(self.feature[at])] <= int(self.cut[at])
        return F.when(left, self.node(binned, 2 * at + 1)).otherwise(self.node(binned, 2 * at + 2))


@dataclass
class Boosted:
    """A fitted model."""

    columns: list[str]
    edges: list[np.ndarray]
    base: float
    rate: float
    trees: list[Tree] = field(default_factory=list)

    def score(self, cells: DataFrame, name: str = "score") -> DataFrame:
        """cells with the probability of presence."""
        edges, trees, base, rate = self.edges, self.trees, self.base, self.rate

        def margins(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            for rows in batches:
                binned = _binned(rows, edges)
                yield pa.array(1 / (1 + np.exp(-(base + rate * sum((t.leaves(binned) for t in trees), np.zeros(len(binned)))))))

        return cells.withColumn(name, F.arrow_udf(margins, "double")(_features(self.columns)))


def _features(columns: list[str]) -> Column:
    return F.array(*[F.coalesce(finite(F.col(c)), F.lit(0.0)) for c in columns])


def _binned(rows: pa.Array, edges: list[np.ndarray]) -> np.ndarray:
    x = rows.flatten().to_numpy(zero_copy_only=False).reshape(len(rows), len(edges))
    return np.stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(edges)], axis=1) if len(rows) else np.zeros((0, len(edges)), np.int64)


def fit(train: DataFrame, columns: list[str], signs: dict[str, int] | None = None, rounds: int = 40, depth: int = 3, rate: float = 0.1, penalty: float = 1.0, leaf: int = 5) -> Boosted:
    """A model of presence in which the score rises (1) or falls (-1) with the features of signs; both classes weigh alike.

    Null, infinite and NaN features count as 0. Training rows without both classes are a ValueError.
    """
    sign = np.array([(signs or {}).get(c, 0) for c in columns])
    filled = train.select(F.col("presence").cast("double").alias("presence"), *[F.coalesce(finite(F.col(c)), F.lit(0.0)).alias(c) for c in columns])
    shares = [i / BINS for i in range(1, BINS)]
    cuts = filled.agg(*[F.percentile_approx(c, shares, 10_000).alias(c) for c in columns]).first()  # BINS numbers a feature
    edges = [np.unique(np.array(cuts[c] or [], float)) for c in columns]

    def bins(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for rows in batches:
            b = _binned(rows, edges)
            yield pa.ListArray.from_arrays(pa.array(np.arange(len(b) + 1, dtype=np.int32) * len(columns)), pa.array(b.ravel().astype(np.int32))).cast(pa.list_(pa.int32()))

    weighed = balanced(filled).withColumn("b", F.arrow_udf(bins, "array<int>")(_features(columns)))
    rows = materialize(weighed.select("b", F.col("presence").alias("y"), F.col("_weight").alias("w"), F.lit(0.0).alias("margin")))
    model = Boosted(columns, edges, 0.0, rate)  # both classes weigh alike: even odds to begin with
    for k in range(rounds):
        tree = _tree(rows, sign, depth, penalty, leaf)
        model.trees.append(tree)
        rows = rows.withColumn("margin", F.col("margin") + rate * tree.column(F.col("b")))
        if (k + 1) % CHECKPOINT_ROUNDS == 0:
            rows = materialize(rows)
    return model


def _tree(rows: DataFrame, sign: np.ndarray, depth: int, penalty: float, leaf: int) -> Tree:
    nodes, k = 2 ** (depth + 1) - 1, len(sign)
    tree = Tree(np.full(nodes, -1), np.zeros(nodes, np.int64), np.zeros(nodes))
    low, high = np.full(nodes, -np.inf), np.full(nodes, np.inf)
    p = 1 / (1 + F.exp(-F.col("margin")))
    sloped = rows.select("b", (F.col("w") * (F.col("y") - p)).alias("g"), (F.col("w") * p * (1 - p)).alias("h"))
    open_ = {0}
    for level in range(depth):
        placed = sloped.withColumn("node", tree.node(F.col("b"))).where(F.col("node").isin(sorted(open_)))
        each = placed.select("node", "g", "h", F.posexplode("b").alias("feature", "bin"))
        found = each.groupBy("node", "feature", "bin").agg(F.sum("g").alias("g"), F.sum("h").alias("h"), F.count(F.lit(1)).alias("n")).collect()  # of the model's size
        sums = {n: np.zeros((3, k, BINS)) for n in open_}
        for r in found:
            sums[r["node"]][:, r["feature"], r["bin"]] = r["g"], r["h"], r["n"]
        split = set()
        for node in sorted(open_):
            if level == 0:
                g, h, _ = sums[node][:, 0].sum(axis=1)
                tree.value[node] = g / (h + penalty)
            if _cut(tree, node, sums[node], sign, low, high, penalty, leaf):
                split |= {2 * node + 1, 2 * node + 2}
        open_ = split
        if not open_:
            break
    return tree


def _cut(tree: Tree, node: int, sums: np.ndarray, sign: np.ndarray, low: np.ndarray, high: np.ndarray, penalty: float, leaf: int) -> bool:
    """Cut a node where the loss falls most among the cuts that keep the order; False without any."""
    left = np.cumsum(sums, axis=2)
    right = left[:, :, -1:] - left
    lo, hi = low[node], high[node]
    values = [np.clip(g / (h + penalty), lo, hi) for g, h, _ in (left, right)]
    # what the loss falls by with these values, which may be held back by the bounds
    gain = sum(2 * v * s[0] - v * v * (s[1] + penalty) for v, s in zip(values, (left, right), strict=True))
    whole = left[:, :1, -1:]
    own = np.clip(whole[0] / (whole[1] + penalty), lo, hi)
    gain = gain - (2 * own * whole[0] - own * own * (whole[1] + penalty))
    refused = (left[2] < leaf) | (right[2] < leaf) | (sign[:, None] * (values[1] - values[0]) < 0)
    gain = np.where(refused, -np.inf, gain)
    j, cut = np.unravel_index(gain.argmax(), gain.shape)
    if not gain[j, cut] > 1e-9:
        return False
    a, b = values[0][j, cut], values[1][j, cut]
    tree.feature[node], tree.cut[node] = j, cut
    for child, v in ((2 * node + 1, a), (2 * node + 2, b)):
        tree.value[child], low[child], high[child] = v, lo, hi
    if sign[j]:
        middle = (a + b) / 2
        upper, lower = (2 * node + 2, 2 * node + 1) if sign[j] > 0 else (2 * node + 1, 2 * node + 2)
        low[upper], high[lower] = middle, middle
    return True


def signs_of(columns: list[str], falling: tuple[str, ...] = (), rising: tuple[str, ...] = (), prefix: str = "prox_") -> dict[str, int]:
    """1 for features of that prefix and the rising ones, -1 for the falling ones; others are free."""
    return {c: -1 if c in falling else 1 for c in columns if c in falling or c in rising or c.startswith(prefix)}


def bagged(train: DataFrame, key: str, columns: list[str], signs: dict[str, int] | None = None, members: int = 6, share: float = 0.7, seed: int = 42, **settings) -> list[Boosted]:
    """Models of all presence and of that share of the background each, drawn by hash."""
    from gridlode.operators.sampling import random_index

    return [fit(train.where((F.col("presence") == 1) | (random_index(seed + k, 1000, F.col(key)) < int(1000 * share))), columns, signs, **settings) for k in range(members)]


def mean_score(models: list[Boosted], cells: DataFrame, name: str = "score") -> DataFrame:
    """cells with the mean score of several models."""
    names = [f"_m{i}" for i in range(len(models))]
    for n, m in zip(names, models, strict=True):
        cells = m.score(cells, n)
    return cells.withColumn(name, sum((F.col(n) for n in names), F.lit(0.0)) / len(names)).drop(*names)
