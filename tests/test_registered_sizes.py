from pyspark.sql import functions as F

import __spark_entry__
from gridlode.operators import models
from gridlode.sources import tables


def test_models_run_at_the_operators_sizes(spark, monkeypatch):
    cells = spark.range(4).select(F.col("id").alias("cell_id"), (F.col("id") % 2).alias("presence"), F.col("id").alias("block"), *[F.lit(0.0).alias(c) for c in ("score", "first", "ml_score", "spread")])
    last, sizes = [], []
    monkeypatch.setattr(tables, "samples", lambda *_: cells)
    monkeypatch.setattr(models, "reliable_negatives", lambda c, *_: c)
    monkeypatch.setattr(models, "fit_score", lambda e, _, c, *__: last.append(e.getStages()[-1]) or c)
    for name in ("train_score", "ensemble"):
        monkeypatch.setattr(models, name, lambda c, *_, **own: sizes.append(own) or c)
    run = lambda name: __spark_entry__.queries()[name](spark, "")
    run("trained_scores"), run("ensemble_scores")
    assert sizes == [{}, {}]
    run("forest_scores"), run("reliable_negative_scores")
    assert last[0].getNumTrees() == last[-1].getNumTrees() == 100
    run("boosted_scores")
    assert last[-1].getMaxIter() == 40
