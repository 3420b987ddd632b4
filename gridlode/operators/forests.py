"""Forests that learn from all cells, however many there are, under many labels (draws) and held-out folds of the same cells.

A cell is one row: a byte a feature (its bin), a byte a draw (its label), its fold and a number that its draws with replacement come
from. A level of all trees is one job. Tasks count rows and presence by node, tried feature and bin, the counts are added by tree,
and the best cuts come to the driver, so nothing but sums and models of a size that fits, trees and depth set leaves a task. More
rows make more of the same counts: no group, task or model holds them, and none are left out.

Scores aren't kept. The threshold of a fit is found by counts over equal parts of the range that its model's scores may have, and
then among the scores in the part that holds its rank; both passes go over all cells, and the threshold is exact.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridlode.functions.numeric import finite
from gridlode.operators import metrics, sampling
from gridlode.plans.materialize import materialize

BINS = 64
#: Rows that a task works on at a time, and rows to a task: at most so many, and no fewer for the sake of more tasks.
BLOCK_ROWS, TASK_ROWS, LEAST_ROWS = 65_536, 1_000_000, 4096
#: Bytes of counts that a task holds; beyond, the fits of a level are dealt over more tasks.
COUNT_BYTES = 48 << 20
#: Parts of a model's range of scores that are counted.
PARTS = 4096
#: A count and its share of presence are added up as one double, exact for so many rows; a task sends its counts before it has seen as many.
PACK, MOST_ROWS = float(1 << 26), 1 << 23
#: A 16-bit number reaches as many of these as a Poisson number of mean 1 is.
TIMES = np.array([24109, 48218, 60273, 64291, 65296, 65497, 65531, 65535], np.uint16)
#: What a row adds to a count, by twice its number and its label.
WEIGHTS = np.array([n * (1 + y * PACK) for n in range(len(TIMES) + 1) for y in (0, 1)])

Fit = tuple[int, int]


@dataclass
class Block:
    """Cells of a task: bins by feature, which of them lie beyond each bin (packed bits), labels by draw, fold and number to draw by."""

    x: np.ndarray
    y: np.ndarray
    fold: np.ndarray
    number: np.ndarray

    def __post_init__(self) -> None:
        cuts = np.arange(BINS - 1, dtype=np.uint8)[:, None]
        self.beyond = [list(np.packbits(column > cuts, axis=1)) for column in self.x]
        self.flat = self.x.ravel()

    def __len__(self) -> int:
        return len(self.fold)

    def held(self, fit: Fit) -> np.ndarray:
        """Whether a cell is presence of the fold that the fit holds out."""
        return (self.y[fit[0]] == 1) & (self.fold == fit[1])

    def trains(self, fit: Fit) -> np.ndarray:
        return (self.fold != fit[1]) & (self.fold >= 0) & (self.y[fit[0]] <= 1)

    def times(self, fit: Fit, trees: int, seed: int) -> Iterator[np.ndarray]:
        """How often each tree draws each cell: with replacement, by the cell's number alone, so whatever task has it."""
        trains = self.trains(fit).astype(np.uint8)
        for first in range(0, trees, 4):
            z = self.number + np.uint64((0x9E3779B97F4A7C15 * (1 + first + (trees + 4) * ((fit[0] << 20) + fit[1]) + (seed << 44))) % (1 << 64))
            z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
            lanes = np.ascontiguousarray((z ^ (z >> np.uint64(31))).view(np.uint16).reshape(-1, 4).T)
            for lane in lanes[: trees - first]:
                drawn = np.zeros(len(self), np.uint8)
                for limit in TIMES:
                    drawn += (lane >= limit).view(np.uint8)
                drawn *= trains
                yield drawn

    def places(self, feature: np.ndarray, cut: np.ndarray, depth: int) -> np.ndarray:
        """The node of that depth that each cell comes to; those of a leaf further up stay at its leftmost place."""
        place, masks = np.zeros(len(self), np.uint8 if depth <= 8 else np.uint32), [np.full_like(self.beyond[0][0], 255)]
        feature, cut = feature.tolist(), cut.tolist()
        for level in range(depth):
            right, below = np.zeros_like(self.beyond[0][0]), []
            for node, mask in enumerate(masks, 2**level - 1):
                if mask is None or feature[node] < 0:
                    below += [None, None]
                    continue
                go = self.beyond[feature[node]][cut[node]] & mask
                right |= go
                if level < depth - 1:
                    below += [mask ^ go, go]
            place += place
            place += np.unpackbits(right, count=len(self))
            masks = below
        return place


def blocks(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[Block]:
    held, size = [], 0
    for batch in batches:
        held, size = [*held, batch], size + batch.num_rows
        if size >= rows:
            yield _block(held)
            held, size = [], 0
    if size:
        yield _block(held)


def _block(batches: list[pa.RecordBatch]) -> Block:
    table = pa.Table.from_batches(batches).combine_chunks()
    x, y = (_bytes(table.column(c).chunk(0)) for c in ("x", "y"))
    return Block(x, y, table.column("fold").to_numpy(), table.column("number").to_numpy().view(np.uint64))


def _bytes(values: pa.Array) -> np.ndarray:
    """Strings of bytes of one length as columns."""
    at = np.frombuffer(values.buffers()[1], np.int32)[values.offset : values.offset + len(values) + 1]
    return np.ascontiguousarray(np.frombuffer(values.buffers()[2], np.uint8)[at[0] : at[-1]].reshape(len(values), -1).T)


def tried(seed: int, fit: Fit, tree: int, level: int, k: int) -> np.ndarray:
    """Features that each node of a level may be cut by: the root of their number."""
    order = np.random.default_rng([seed, *fit, tree, level]).random((2**level, k)).argsort(axis=1)
    return np.ascontiguousarray(order[:, : max(1, int(np.sqrt(k)))].T)


def count(block: Block, times: np.ndarray, label: np.ndarray, place: np.ndarray, features: np.ndarray, counts: np.ndarray) -> None:
    """Add rows, and presence times PACK, by tried feature, node and bin to counts."""
    rows = np.flatnonzero(times > 0)
    weight = WEIGHTS.take((times * 2 + label).take(rows))
    node = place.take(rows).astype(np.int64)
    slot, size = node * BINS, counts.shape[1]
    for s, own in enumerate(features * len(block)):
        at = own.take(node)
        at += rows
        counts[s] += np.bincount(slot + block.flat.take(at), weight, size)


def cuts(counts: np.ndarray, features: np.ndarray, weights: tuple[float, float], leaf: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Feature (-1: none helps) and bin that each node is cut by, the values of both halves and of the whole, from rows and presence by tried feature, node and bin."""
    rows, presence = counts.astype(float)
    positive = weights[1] * presence
    cw, cp, cn = (np.cumsum(v, axis=2) for v in (weights[0] * (rows - presence) + positive, positive, rows))
    tw, tp, tn = (v[:, :, -1:] for v in (cw, cp, cn))
    share = lambda p, a: np.divide(p, a, out=np.zeros_like(a), where=a > 0)
    gain = tp * share(tw - tp, tw) - cp * share(cw - cp, cw) - (tp - cp) * share(tw - cw - tp + cp, tw - cw)
    gain[(cn < leaf) | (tn - cn < leaf)] = -1.0
    nodes = np.arange(features.shape[1])
    best = gain.transpose(1, 0, 2).reshape(len(nodes), -1).argmax(axis=1)
    s, cut = best // BINS, best % BINS
    at = (s, nodes, cut)
    left, right = share(cp[at], cw[at]), share((tp - cp)[at], (tw - cw)[at])
    return np.where(gain[at] > 1e-12, features[s, nodes], -1), cut, np.stack([left, right], axis=1).ravel(), share(tp[0, :, 0], tw[0, :, 0])


@dataclass
class Grown:
    """Trees of all fits: feature (-1: a leaf), last bin of the left half and value, by fit, tree and node in heap order."""

    fits: list[Fit]
    depth: int
    feature: np.ndarray
    cut: np.ndarray
    value: np.ndarray

    def __post_init__(self) -> None:
        self.leaves = np.zeros((*self.feature.shape[:2], 2**self.depth))
        for node in reversed(range(2 ** (self.depth + 1) - 1)):
            level = (node + 1).bit_length() - 1
            place, inner = (node + 1 - 2**level) << (self.depth - level), self.feature[:, :, node] >= 0
            self.leaves[:, :, place] = np.where(inner, self.leaves[:, :, place], self.value[:, :, node])
        reached = self._reached()
        self.low, self.high = (f(np.where(reached, self.leaves, n), axis=2).mean(axis=1) for f, n in ((np.min, np.inf), (np.max, -np.inf)))

    def _reached(self) -> np.ndarray:
        """Places at the bottom that cells may come to."""
        out = np.zeros(self.leaves.shape, bool)
        alive = np.ones((*self.feature.shape[:2], 1), bool)
        for level in range(self.depth):
            inner = alive & (self.feature[:, :, 2**level - 1 : 2 ** (level + 1) - 1] >= 0)
            out[:, :, :: 2 ** (self.depth - level)] |= alive & ~inner
            alive = np.repeat(inner, 2, axis=2)
        return out | alive

    def scores(self, block: Block, i: int) -> np.ndarray:
        total, trees = np.zeros(len(block)), self.feature.shape[1]
        for t in range(trees):
            total += self.leaves[i, t].take(block.places(self.feature[i, t], self.cut[i, t], self.depth))
        return total / trees

    def parts(self, scores: np.ndarray, i: int) -> np.ndarray:
        """The part of the model's range that a score lies in; it never falls with the score."""
        width = self.high[i] - self.low[i]
        return np.clip((scores - self.low[i]) * (PARTS / width if width > 0 else 0.0), 0, PARTS - 1).astype(np.int64)


def random_labels(cells: DataFrame, key: str, draws: int, number: int, seed: int) -> list[Column]:
    """For each draw whether a cell is among the first, so many as number, in the order of a hash of seed, draw and key.

    The hash of the last one is found by counts of the hashes' beginnings and then in the order of those that share its own.
    """
    orders = {d: sampling.random_order(seed, F.lit(d), F.col(key)) for d in range(1, draws + 1)}
    if not number or not draws:
        return [F.lit(0) for _ in orders]
    each = cells.select(F.explode(F.array(*[F.struct(F.lit(d).alias("d"), o.alias("h")) for d, o in orders.items()])).alias("e")).select("e.d", "e.h")
    beginnings = each.groupBy("d", F.substring("h", 1, 3).alias("b")).count()
    upto = beginnings.withColumn("upto", F.sum("count").over(Window.partitionBy("d").orderBy("b")))  # 4,096 of a draw
    own = {r["d"]: r for r in upto.where(F.col("upto") >= number).groupBy("d").agg(F.min_by(F.struct("b", (F.lit(number) - F.col("upto") + F.col("count")).alias("at")), "b").alias("own")).select("d", "own.*").collect()}
    last = F.create_map(*[F.lit(v) for d in own for v in (d, own[d]["b"])])[F.col("d")]
    at = F.create_map(*[F.lit(v) for d in own for v in (d, own[d]["at"])])[F.col("d")]
    shared = each.where(F.substring("h", 1, 3) == last).withColumn("at", F.row_number().over(Window.partitionBy("d").orderBy("h")))
    limits = {r["d"]: r["h"] for r in shared.where(F.col("at") == at).collect()}  # one of a draw
    return [(o <= limits[d]).cast("int") for d, o in orders.items()]


def edges(melted: DataFrame, key: str, k: int, n: int) -> list[np.ndarray]:
    """Quantiles between the bins of each feature (linear-interpolated, exact, without repeats) of n rows of feature and v a feature.

    Equal values are ranked by key, so that a common one is dealt over tasks.
    """
    wanted = np.linspace(0, 1, BINS + 1)[1:-1] * max(n - 1, 0)
    lo, hi = np.floor(wanted).astype(int), np.ceil(wanted).astype(int)
    ranked = metrics.rank_within(melted, ["feature"], "v", key).withColumn("rank", F.round(F.col("rank01") * (n - 1)).cast("long"))
    value = {(r["feature"], r["rank"]): r["v"] for r in ranked.where(F.col("rank").isin({*lo.tolist(), *hi.tolist()})).collect()}  # two of a bin
    if not n:
        return [np.array([]) for _ in range(k)]
    ends = [[np.array([value[j, r] for r in at.tolist()]) for at in (lo, hi)] for j in range(k)]
    return [np.unique(a + (b - a) * (wanted - lo)) for a, b in ends]


def encoded(cells: DataFrame, key: str, columns: list[str], labels: list[Column], folds: int) -> DataFrame:
    """x, y, fold and number of each cell, in as many partitions as there is work for. Null, infinite and NaN features are 0.

    Bins are between quantiles of all cells. A cell without a label, or without a fold, is scored only.
    """
    filled = [F.coalesce(finite(F.col(c)), F.lit(0.0)) for c in columns]
    n = cells.count()
    cuts_of = edges(cells.select(F.col(key), F.posexplode(F.array(*filled)).alias("feature", "v")), key, len(columns), n)

    def one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            x = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(n, len(cuts_of))
            x = np.stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(cuts_of)], axis=1).astype(np.uint8)
            y = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(n, -1).astype(np.uint8)
            strings = [pa.array([row.tobytes() for row in m], pa.binary()) for m in (x, y)]
            yield pa.RecordBatch.from_arrays([*strings, batch.column(2), batch.column(3)], ["x", "y", "fold", "number"])

    fold = F.when(F.col("fold").isNull(), -1).when(F.col("fold").between(0, folds - 1), F.col("fold")).otherwise(folds).cast("int")
    y = F.array(*[F.coalesce(c.cast("tinyint"), F.lit(2).cast("tinyint")) for c in labels])
    rows = cells.select(F.array(*filled).alias("x"), y.alias("y"), fold.alias("fold"), F.xxhash64(key).alias("number"))
    tasks = max(-(-n // TASK_ROWS), min(cells.sparkSession.sparkContext.defaultParallelism, -(-n // LEAST_ROWS)), 1)
    return materialize(rows.mapInArrow(one, "x binary, y binary, fold int, number long").repartition(tasks))


def _over(rows: DataFrame, one: Callable[[Iterator[Block]], Iterator[dict]], schema: str) -> DataFrame:
    """What one makes of the blocks of each task."""
    names, size = [c.split()[0] for c in schema.split(", ")], BLOCK_ROWS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for made in one(blocks(batches, size)):
            yield pa.RecordBatch.from_arrays([pa.array(made[c]) for c in names], names)

    return rows.mapInArrow(run, schema)


def class_weights(rows: DataFrame, fits: list[Fit]) -> dict[int, tuple[float, float]]:
    """Weights of both classes, which weigh alike in all, of each fit (by its place) whose training cells have both."""

    def one(of: Iterator[Block]) -> Iterator[dict]:
        n = np.zeros((2, len(fits)), np.int64)
        for block in of:
            for i, fit in enumerate(fits):
                trains = block.trains(fit)
                n[:, i] += trains.sum(), (trains & (block.y[fit[0]] == 1)).sum()
        yield {"fit": np.arange(len(fits)), "n": n[0], "p": n[1]}

    sums = _over(rows, one, "fit long, n long, p long").groupBy("fit").agg(F.sum("n").alias("n"), F.sum("p").alias("p")).collect()  # one of a fit
    return {r["fit"]: (r["n"] / (2.0 * (r["n"] - r["p"])), r["n"] / (2.0 * r["p"])) for r in sums if 0 < r["p"] < r["n"]}


def grow(rows: DataFrame, fits: list[Fit], k: int, trees: int, depth: int, leaf: int, seed: int) -> Grown:
    """Trees of each fit (draw and held-out fold) that has both classes, from all cells of the other folds."""
    weights = class_weights(rows, fits)
    fits = [fit for i, fit in enumerate(fits) if i in weights]
    both, nodes, tries = list(dict(sorted(weights.items())).values()), 2 ** (depth + 1) - 1, max(1, int(np.sqrt(k)))
    feature, cut, value = np.full((len(fits), trees, nodes), -1, np.int16), np.zeros((len(fits), trees, nodes), np.uint8), np.zeros((len(fits), trees, nodes))
    for level in range(depth):
        first, width = 2**level - 1, 2**level
        alive = np.ones((len(fits), trees, 1), bool) if not level else np.repeat(feature[:, :, first // 2 : first] >= 0, 2, axis=2)
        todo = np.flatnonzero(alive.any(axis=(1, 2)))
        if not len(todo):
            break
        many = max(1, COUNT_BYTES // (trees * tries * width * BINS * 8))
        counted = [_level(rows, fits, todo[i : i + many], feature, cut, level, k, trees, seed) for i in range(0, len(todo), many)]
        whole = counted[0]
        for other in counted[1:]:
            whole = whole.unionByName(other)
        for r in _best(whole, fits, both, level, k, trees, leaf, seed).collect():  # a row of a tree
            i, t = divmod(r["tree"], trees)
            there = alive[i, t]
            feature[i, t, first : first + width] = np.where(there, r["feature"], -1)
            cut[i, t, first : first + width] = r["cut"]
            value[i, t, 2 * first + 1 : 2 * first + 1 + 2 * width] = r["halves"]
            if not level:
                value[i, t, 0] = r["own"][0]
    return Grown(fits, depth, feature, cut, value)


def _level(rows: DataFrame, fits: list[Fit], of: np.ndarray, feature: np.ndarray, cut: np.ndarray, level: int, k: int, trees: int, seed: int) -> DataFrame:
    """tree and counts of a level of some fits, once or more for each task."""
    width, tries, mine, most = 2**level, max(1, int(np.sqrt(k))), [fits[i] for i in of], MOST_ROWS
    feature, cut = feature[of, :, : width - 1], cut[of, :, : width - 1]

    def one(held: Iterator[Block]) -> Iterator[dict]:
        features = [[tried(seed, fit, t, level, k) for t in range(trees)] for fit in mine]
        counts, seen = np.zeros((len(mine), trees, tries, width * BINS)), 0
        for block in held:
            if seen and seen + len(block) > most:
                yield from _sent(of, counts)
                counts[:], seen = 0, 0
            seen += len(block)
            for i, fit in enumerate(mine):
                label = block.y[fit[0]]
                for t, times in enumerate(block.times(fit, trees, seed)):
                    count(block, times, label, block.places(feature[i, t], cut[i, t], level), features[i][t], counts[i, t])
        if seen:
            yield from _sent(of, counts)

    return _over(rows, one, "tree long, counts binary")


def _best(counted: DataFrame, fits: list[Fit], both: list[tuple[float, float]], level: int, k: int, trees: int, leaf: int, seed: int) -> DataFrame:
    """The cuts of each tree's nodes at a level, from the counts of all tasks."""

    def one(group: pa.Table) -> pa.Table:
        at = group.column("tree")[0].as_py()
        i, t = divmod(at, trees)
        features = tried(seed, fits[i], t, level, k)
        found = cuts(sum(_unpacked(b.as_py(), *features.shape) for b in group.column("counts")), features, both[i], leaf)
        kinds = {"feature": pa.int32(), "cut": pa.int32(), "halves": pa.float64(), "own": pa.float64()}
        return pa.table({"tree": pa.array([at], pa.int64())} | {c: pa.array([v.tolist()], pa.list_(kind)) for (c, kind), v in zip(kinds.items(), found, strict=True)})

    return counted.groupBy("tree").applyInArrow(one, "tree long, feature array<int>, cut array<int>, halves array<double>, own array<double>")


def _sent(of: np.ndarray, counts: np.ndarray) -> Iterator[dict]:
    """A row of a tree, in the fewest bytes that its counts fit in."""
    for i, own in zip(of, counts, strict=True):
        whole = own.astype(np.int64)
        split = np.stack([whole % int(PACK), whole // int(PACK)], axis=1)
        yield {"tree": i * len(own) + np.arange(len(own)), "counts": [c.astype(np.min_scalar_type(int(c.max()))).tobytes() for c in split]}


def _unpacked(sent: bytes, tries: int, width: int) -> np.ndarray:
    size = 2 * tries * width * BINS
    return np.frombuffer(sent, np.dtype(f"u{len(sent) // size}")).reshape(2, tries, width, BINS).astype(np.int64)


def coverage(rows: DataFrame, grown: Grown, share: float) -> DataFrame:
    """draw, fold and coverage: the share of a held-out fold's presence whose score reaches the fit's exact quantile of all cells' scores.

    Folds without presence of a draw are left out.
    """

    def counted(held: Iterator[Block]) -> Iterator[dict]:
        n = np.zeros((2, len(grown.fits), PARTS), np.int64)
        for block in held:
            for i, fit in enumerate(grown.fits):
                parts = grown.parts(grown.scores(block, i), i)
                n[:, i] += np.bincount(parts, minlength=PARTS), np.bincount(parts[block.held(fit)], minlength=PARTS)
        fit, part = np.nonzero(n[0])
        yield {"fit": fit, "part": part, "n": n[0, fit, part], "held": n[1, fit, part]}

    parts = _over(rows, counted, "fit long, part long, n long, held long").groupBy("fit", "part").agg(F.sum("n").alias("n"), F.sum("held").alias("held"))
    fit = Window.partitionBy("fit")  # PARTS of a fit
    placed = parts.withColumns({"upto": F.sum("n").over(fit.orderBy("part")), "rank": F.lit(share) * (F.sum("n").over(fit) - 1), "positives": F.sum("held").over(fit)})
    low, high = (F.min(F.when(F.col("upto") > f("rank"), F.col("part"))).over(fit) for f in (F.floor, F.ceil))
    placed = placed.withColumns({"low": low, "high": high})
    sums = [F.sum(F.when(c, F.col(v)).otherwise(0)).alias(name) for name, v, c in (("below", "n", F.col("part") < F.col("low")), ("above", "held", F.col("part") > F.col("high")))]
    found = {r["fit"]: r for r in placed.where("positives > 0").groupBy("fit", "low", "high", "rank", "positives").agg(*sums).collect()}  # one of a fit

    def inside(held: Iterator[Block]) -> Iterator[dict]:
        for block in held:
            for i, r in ends.items():
                scores = grown.scores(block, i)
                parts = grown.parts(scores, i)
                within = (parts >= r[0]) & (parts <= r[1])
                value, at, n = np.unique(scores[within], return_inverse=True, return_counts=True)
                yield {"fit": np.full(len(value), i), "score": value, "n": n, "held": np.bincount(at, block.held(grown.fits[i])[within], len(value)).astype(np.int64)}

    ends = {i: (r["low"], r["high"]) for i, r in found.items()}
    scores = _over(rows, inside, "fit long, score double, n long, held long").groupBy("fit", "score").agg(F.sum("n").alias("n"), F.sum("held").alias("held"))
    known = [(i, *grown.fits[i], r["rank"], r["below"], r["above"], r["positives"]) for i, r in found.items()]
    each = scores.join(rows.sparkSession.createDataFrame(known, "fit long, draw long, fold long, rank double, below long, above long, positives long"), "fit")
    each = materialize(each.withColumn("upto", F.col("below") + F.sum("n").over(Window.partitionBy("fit").orderBy("score"))))
    lo, hi = (F.min(F.when(F.col("upto") > f("rank"), F.col("score"))) for f in (F.floor, F.ceil))
    limits = each.groupBy("fit").agg((lo + (hi - lo) * F.max(F.col("rank") - F.floor("rank"))).alias("limit"))
    hits = F.sum(F.when(F.col("score") >= F.col("limit"), F.col("held")).otherwise(0))
    return each.join(limits, "fit").groupBy("draw", "fold", "above", "positives").agg(hits.alias("hits")).select("draw", "fold", ((F.col("above") + F.col("hits")) / F.col("positives")).alias("coverage"))
