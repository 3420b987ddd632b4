"""Masks, points under a score, zones, gates and standardisation on rows with gaps."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridlode.functions import numeric
from gridlode.operators import components, grid, metrics
from gridlode.sources import shapes


def cells(spark):
    return spark.createDataFrame([(i // 10, i % 10, None if i % 9 == 0 else float(i)) for i in range(100)], "r long, c long, v double")


def test_masks_and_points(spark):
    g = cells(spark)
    gold = g.withColumn("gold", metrics.top_mask(g, "v", 0.15)).where("gold").collect()
    values = [i for i in range(100) if i % 9]
    assert {r.v for r in gold} == {float(v) for v in values if v >= np.quantile(values, 0.85)}
    points = spark.createDataFrame([(1, 9, 8), (2, 9, 0), (3, 0, 1), (4, 50, 50)], "id int, r long, c long")
    got = {r.id: (r.v, r.hit) for r in metrics.scores_at(points, g, ["r", "c"], "v", 0.15).collect()}
    assert got == {1: (98.0, True), 2: (None, False), 3: (1.0, False), 4: (None, False)}
    r = metrics.point_coverage(points, g, ["r", "c"], "v").first()
    assert (r.points, r.hits, r.coverage) == (4, 1, 0.25)
    none = metrics.point_coverage(points.where("id > 9"), g, ["r", "c"], "v").first()
    assert (none.points, none.hits, none.coverage) == (0, 0, None)
    assert g.where(metrics.top_mask(g.where("v < 0"), "v", 0.15)).count() == 0


def test_zones_by_size(spark):
    rows = [(0, 0), (0, 1), (1, 2), (5, 5), (5, 6), (9, 9)]
    marked = spark.createDataFrame(rows, "r long, c long")
    kept = components.keep_large(marked, 10, 2).collect()
    assert sorted((r.r, r.c, r.zone, r["cells"]) for r in kept) == [(0, 0, 0, 3), (0, 1, 0, 3), (1, 2, 0, 3), (5, 5, 55, 2), (5, 6, 55, 2)]
    assert tuple(components.zone_count(marked, 10).first()) == (3, 6)
    assert tuple(components.zone_count(marked.where("r > 90"), 10).first()) == (0, 0)


def test_gates(spark):
    rows = [("a", int(i < 5)) for i in range(30)] + [("b", int(i < 4)) for i in range(40)] + [("c", 1)] * 29 + [(None, 1)] * 40
    kept = metrics.with_enough(spark.createDataFrame(rows, "g string, presence int"), ["g"])
    assert {r.g: r["count"] for r in kept.groupBy("g").count().collect()} == {"a": 30}


def test_standardised(spark):
    g = spark.createDataFrame([(1.0, 5.0, None), (3.0, 5.0, None), (float("nan"), 5.0, None)], "a double, b double, c double")
    got = g.select(*[v.alias(k) for k, v in numeric.standardised(g, ["a", "b", "c"]).items()]).collect()
    assert [r.a for r in got] == [-1.0, 1.0, None] and {r.b for r in got} == {0.0} and {r.c for r in got} == {None}


def test_joined_layers_and_coarse_support(spark):
    rows = spark.createDataFrame([("t1", 1), ("x", 2), ("t2", 3)], "layer string, id int")
    assert sorted((r.layer, r.id) for r in shapes.joined(rows, ["t1", "t2"], "t").collect()) == [("t", 1), ("t", 3), ("x", 2)]
    g = grid.blocks(cells(spark), F.col("c"), F.col("r"), 5).withColumn("presence", (F.col("v") == 99).cast("int"))
    got = {r.block: (r.v, r.presence, r.x, r.y) for r in grid.coarse_support(g, ["v"], "presence", F.col("c"), F.col("r")).collect()}
    assert len(got) == 4 and got[0][2:] == (2.0, 2.0) and got[0][0] == pytest.approx(sum(v for i in range(100) if i // 10 < 5 and i % 10 < 5 and i % 9 for v in [i]) / sum(1 for i in range(100) if i // 10 < 5 and i % 10 < 5 and i % 9))
