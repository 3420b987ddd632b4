"""Toxicity scores by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

A document's features are the distinct hashes of its words, word pairs and pairs with one
word between. The model is fitted on a sample of at most about MAX_LABELLED labelled rows (the
documented bound); that sample's features are made by all tasks and written, then one task
runs the per-coordinate updates over them. L1 leaves few weights, which are broadcast as one
array of 2**BITS numbers whatever the corpus is. Scoring reads every whole text once,
without a shuffle.

Defined cases: a null or empty text has the score of the intercept; ids without a label
and labels without a document are left out of the fit; where an id has several labels the
highest counts; with no labelled row, or with one class only, the score is that class's
smoothed share; a score of exactly one half is predicted as 1; rows that repeat have equal scores; a
very long text is scored whole; an empty table gives an empty result; further columns pass through
whatever their names, and those named like a result are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridlode.llm.columns import Held
from gridlode.llm.textcols import ALNUM, Words, column_of, hash_words, mix, pieces
from gridlode.plans.materialize import materialize

BITS = 20
MAX_LABELLED = 16_000
EPOCHS, ALPHA, BETA, L1, L2 = 6, 2.0, 1.0, 6.0, 0.01
FOLDS, HELD_OUT = 5, 0


def fold(doc_id: Column) -> Column:
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(FOLDS))


def features(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Feature index and row of every word, pair and skip pair of the texts."""
    h, row = words.hash, words.row
    found, rows = [h], [row]
    for gap, salt in ((1, 0x2545F4914F6CDD1D), (2, 0x9FB21C651E98DF25)):
        same = np.flatnonzero(row[:-gap] == row[gap:]) if len(h) > gap else np.zeros(0, np.int64)
        found.append(mix(h[same] * np.uint64(salt) + h[same + gap]))
        rows.append(row[same])
    index = (np.concatenate(found) >> np.uint64(64 - BITS)).astype(np.int32)
    return index, np.concatenate(rows)


def distinct(index: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    key = np.unique((row.astype(np.int64) << BITS) | index)
    return (key & ((1 << BITS) - 1)).astype(np.int32), (key >> BITS).astype(np.int32)


def _featurise(text_col: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, text_col):
                index, row = distinct(*features(hash_words(column_of(piece, text_col), ALNUM)))
                cut = np.searchsorted(row, np.arange(piece.num_rows + 1))
                rows = pa.array([index[a:b].tobytes() for a, b in zip(cut[:-1], cut[1:], strict=True)], pa.binary())
                yield pa.RecordBatch.from_arrays([column_of(piece, "order"), column_of(piece, "label"), rows], names=["order", "label", "features"])

    return run


def fit_ftrl(rows: list[tuple[int, np.ndarray]]) -> tuple[np.ndarray, float]:
    """Weights and intercept after EPOCHS passes over (label, feature indexes)."""
    size = 1 << BITS
    z, n, bias, bias_n = np.zeros(size), np.zeros(size), 0.0, 0.0
    weight = lambda z, n: np.where(np.abs(z) <= L1, 0.0, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2))
    for _ in range(EPOCHS):
        for label, index in rows:
            zi, ni = z[index], n[index]
            w = weight(zi, ni)
            g = 1.0 / (1.0 + np.exp(-np.clip(w.sum() + bias, -35, 35))) - label
            sigma = (np.sqrt(ni + g * g) - np.sqrt(ni)) / ALPHA
            z[index], n[index] = zi + g - sigma * w, ni + g * g
            bias_n += g * g
            bias -= ALPHA / (BETA + np.sqrt(bias_n)) * g
    return weight(z, n), bias


def _fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows = []
    for batch in batches:
        rows += zip(*(column_of(batch, c).to_pylist() for c in ("order", "label", "features")), strict=True)
    rows = [(y, np.frombuffer(f, np.int32)) for _, y, f in sorted(rows)]
    share = (sum(y for y, _ in rows) + 0.5) / (len(rows) + 1.0)
    if len({y for y, _ in rows}) < 2:
        w, bias = np.zeros(1 << BITS), float(np.log(share / (1 - share)))
    else:
        w, bias = fit_ftrl(rows)
    at = np.flatnonzero(w)
    yield pa.RecordBatch.from_arrays([pa.array([at.astype(np.int32).tobytes()]), pa.array([w[at].astype(np.float32).tobytes()]), pa.array([bias])], names=["index", "weight", "bias"])


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> tuple[np.ndarray, np.ndarray, float]:
    """Indexes and values of the weights that are not 0, and the intercept."""
    of_train = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & (fold(F.col(id_col)) != HELD_OUT))
    chosen = of_train.groupBy(F.col(id_col).alias("_id")).agg(F.max(F.col(label_col)).cast("int").alias("label"))
    chosen = materialize(chosen)
    total = chosen.count()
    order = F.xxhash64("_id", F.lit(7))
    if total > MAX_LABELLED:
        chosen = chosen.where(F.pmod(order, F.lit(1 << 30)) < int((1 << 30) * MAX_LABELLED / total))
    # at most about MAX_LABELLED rows of two numbers
    sample = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("text")).join(F.broadcast(chosen), "_id")
    made = materialize(sample.select(order.alias("order"), "label", "text").mapInArrow(_featurise("text"), "order long, label int, features binary"))
    row = made.coalesce(1).mapInArrow(_fit, "index binary, weight binary, bias double").first()
    return np.frombuffer(row["index"], np.int32), np.frombuffer(row["weight"], np.float32), row["bias"]


Weights = tuple[np.ndarray, np.ndarray, float]


def scored(held: Held, model: Weights) -> DataFrame:
    """The held rows with score."""
    weights = held.rows.sparkSession.sparkContext.broadcast(model)
    own, text_col = held.columns, held["text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, value, bias = weights.value
        weight = np.zeros(1 << BITS, np.float32)
        weight[at] = value
        for batch in batches:
            for piece in pieces(batch, text_col):
                index, row = features(hash_words(column_of(piece, text_col), ALNUM))
                has = weight[index] != 0
                index, row = distinct(index[has], row[has])
                margin = bias + np.bincount(row, weight[index].astype(np.float64), minlength=piece.num_rows)
                p = 1.0 / (1.0 + np.exp(-np.clip(margin, -35, 35)))
                yield pa.RecordBatch.from_arrays([*(column_of(piece, c) for c in own), pa.array(p)], names=[*own, "score"])

    return held.rows.mapInArrow(run, held.fields(T.StructField("score", T.DoubleType())))


def score(docs: DataFrame, model: Weights, text_col: str = "text") -> DataFrame:
    """The rows of docs with score, the probability of the label 1."""
    held = Held(docs, text=text_col)
    return held.given(scored(held, model), "score")


def op5_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    held_out = F.coalesce(fold(F.col("doc_id")) == HELD_OUT, F.lit(False))
    return score(docs, model).select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents scored as toxic go.

    All columns stay as they are, whatever their names; null, empty, repeated and very long texts
    and an empty table are treated as by the operator.
    """
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    held = Held(docs, text="text")
    return held.given(scored(held, model).where("score < 0.5"))
