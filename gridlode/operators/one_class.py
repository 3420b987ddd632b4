"""One-class support vectors of presence alone: which cells are unlike it.

The radial kernel is replaced by random Fourier features, so the model is one vector. Its dual is solved by Frank-Wolfe
steps with exact line search: each round scores all rows, finds the score below which the share nu lies, and adds up the
features of the rows below, one aggregate of the model's size. Scores are positive inside; about the share nu of the rows that were
learnt from lies outside. Null, infinite and NaN features count as 0.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridlode.functions.numeric import quantiles
from gridlode.operators.boosting import _features
from gridlode.plans.materialize import materialize


@dataclass
class OneClass:
    """A model: standardisation, random features and their weights."""

    columns: list[str]
    mean: np.ndarray
    std: np.ndarray
    turns: np.ndarray
    shifts: np.ndarray
    weights: np.ndarray
    rho: float = 0.0

    def features(self, rows: pa.Array) -> np.ndarray:
        x = (rows.flatten().to_numpy(zero_copy_only=False).reshape(len(rows), len(self.columns)) - self.mean) / self.std
        return np.sqrt(2.0 / len(self.shifts)) * np.cos(x @ self.turns + self.shifts)

    def score(self, cells: DataFrame, name: str = "score") -> DataFrame:
        """cells with the distance from the border of presence."""

        def scores(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            for rows in batches:
                yield pa.array(self.features(rows) @ self.weights - self.rho)

        return cells.withColumn(name, F.arrow_udf(scores, "double")(_features(self.columns)))


def fit(presence: DataFrame, columns: list[str], nu: float = 0.3, gamma: float | None = None, size: int = 512, rounds: int = 40, tolerance: float = 1e-3, seed: int = 42) -> OneClass:
    """A model of the presence rows; gamma is 1 / the number of features if not given. No rows are a ValueError."""
    rows = materialize(presence.select(_features(columns).alias("x")))
    at = lambda i: F.col("x")[i]
    got = rows.agg(F.count(F.lit(1)), *[f(at(i)) for i in range(len(columns)) for f in (F.avg, F.stddev_pop)]).first()
    n = got[0]
    if not n:
        raise ValueError("there is no presence to learn from")
    moments = np.array(got[1:], float).reshape(-1, 2)
    rng = np.random.default_rng(seed)
    turns = rng.normal(0.0, np.sqrt(2.0 * (gamma or 1.0 / len(columns))), (len(columns), size))
    model = OneClass(columns, moments[:, 0], np.where(moments[:, 1] > 0, moments[:, 1], 1.0), turns, rng.uniform(0, 2 * np.pi, size), np.zeros(size))
    model.weights = _total(rows, model, F.lit(1.0 / n))
    mass = 1.0 / (nu * n)
    for _ in range(rounds):
        scored = materialize(_scored(rows, model))
        limit = quantiles(scored, F.col("s"), [nu])[0]
        below, ties = scored.agg(F.count(F.when(F.col("s") < limit, 1)), F.count(F.when(F.col("s") == limit, 1))).first()
        # the lowest rows take all they may; what is left goes to those at the limit, or to those above if there are none
        left = max(0.0, 1.0 - below * mass)
        rest = scored.where(F.col("s") >= limit).agg(F.min("s")).first()[0] if not ties else limit
        ties = ties or scored.where(F.col("s") == rest).count()
        share = F.when(F.col("s") < limit, mass).when(F.col("s") == rest, min(mass, left / max(ties, 1)))
        target = _total(scored.where(F.col("s") <= rest), model, share)
        step = model.weights - target
        gap, length = float(model.weights @ step), float(step @ step)
        if gap <= tolerance * float(model.weights @ model.weights) or length == 0:
            break
        model.weights = model.weights - min(1.0, gap / length) * step
    model.rho = quantiles(_scored(rows, model), F.col("s"), [nu])[0]
    return model


def _scored(rows: DataFrame, model: OneClass) -> DataFrame:
    weights = model.weights.copy()

    def scores(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for x in batches:
            yield pa.array(model.features(x) @ weights)

    return rows.select("x", F.arrow_udf(scores, "double")("x").alias("s"))


def _total(rows: DataFrame, model: OneClass, share) -> np.ndarray:
    """Sum of the rows' features by their shares; each task gives one vector of the model's size."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(model.shifts))
        for b in batches:
            total += b.column(1).to_numpy(zero_copy_only=False) @ model.features(b.column(0))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], names=["at", "v"])

    summed = rows.select("x", share.alias("share")).mapInArrow(add, "at long, v double").groupBy("at").agg(F.sum("v").alias("v")).collect()
    out = np.zeros(len(model.shifts))
    for r in summed:
        out[r["at"]] = r["v"]
    return out
