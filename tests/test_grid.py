import math

import pytest
from pyspark.sql import functions as F

from gridlode.functions import numeric
from gridlode.operators import components, features, geometry, grid, metrics, sampling


def column(spark, values):
    return spark.createDataFrame([(i, None if v is None else float(v)) for i, v in enumerate(values)], "i int, v double")


def scaled(df, c):
    return [r[0] for r in df.orderBy("i").select(c).collect()]


def test_scaling(spark):
    df = column(spark, [0, 5, 10])
    assert scaled(df, numeric.minmax_01(df, F.col("v"))) == [0.0, 0.5, 1.0]
    df = column(spark, [3, 3, 3])
    assert scaled(df, numeric.minmax_01(df, F.col("v"))) == [0.5] * 3
    df = column(spark, [1, float("nan"), 2])
    assert scaled(df, numeric.minmax_01(df, F.col("v"))) == [0.0, None, 1.0]
    df = column(spark, [0, 1, 2, 3, 1000])
    got = scaled(df, numeric.robust_01(df, F.col("v"), 0.1, 0.9))
    assert got[0] == 0.0 and got[-1] == 1.0 and got == sorted(got)


def test_bracketed_quantiles_are_exact(spark, monkeypatch):
    df = spark.range(20_000).select((F.hash("id") % 5000).cast("double").alias("v"))
    shares = [0.0, 0.02, 0.5, 0.777, 1.0]
    want = numeric.quantiles(df, F.col("v"), shares)
    monkeypatch.setattr(numeric, "EXACT_VALUES", 10)
    assert numeric.quantiles(df, F.col("v"), shares) == pytest.approx(want)


def test_proximity_falls(spark):
    df = column(spark, [0, 100, 1000])
    got = scaled(df, numeric.proximity(df, F.col("v"), "sqrt", 0.75))
    assert got[0] == 1.0 and got[0] > got[1] > got[2] >= 0.0


def test_sampling_repeats(spark):
    cells = spark.range(200).select("id", (F.col("id").isin(1, 2, 3)).cast("int").alias("presence"))
    draw = lambda seed: sorted(r.id for r in sampling.presence_background(cells, "id", 50, seed).collect())
    assert draw(42) == draw(42) != draw(43)
    assert len(draw(42)) == 53 and {1, 2, 3} <= set(draw(42))


def test_perfect_ranking(spark):
    df = spark.range(100).select(F.col("id").cast("double").alias("score"), (F.col("id") >= 97).cast("int").alias("presence"))
    assert metrics.top_area(df, [0.1]).first()["coverage"] == 1.0
    assert metrics.binary_metrics(df).first()["auc"] == 1.0


def test_taxonomy_prefers_the_least(spark):
    rows = [(i, *[float(i * (k + 1)) for k in range(6)]) for i in range(50)]
    names = ["q", "p", "d", "t", "mq", "mp"]
    df = spark.createDataFrame(rows, ["i", *names])
    got = [r.geo_score for r in features.taxonomy_score(df, dict(zip(features.PROXIMITY, names, strict=True))).orderBy("i").collect()]
    assert got == sorted(got, reverse=True) and got[0] == 1.0 and got[-1] == 0.0


def board(spark, n, f):
    return spark.createDataFrame([(r, c, float(f(r, c))) for r in range(n) for c in range(n)], "r long, c long, v double")


def test_resampling(spark):
    checks = grid.coarsen(board(spark, 8, lambda r, c: (r + c) % 2), "v", 2).collect()
    assert len(checks) == 16 and all(r.v == 0.5 for r in checks)
    points = spark.createDataFrame([(i, 1 + i * 0.3, 2 + i * 0.7) for i in range(8)], "id int, y double, x double")
    got = grid.bilinear(board(spark, 10, lambda r, c: 7), "v", points, F.col("y"), F.col("x")).collect()
    assert all(abs(r.v - 7) < 1e-12 for r in got)


def test_smoothing_spreads_its_support(spark):
    one = spark.createDataFrame([(2, 2, 5.0), (0, 0, None), (4, 4, None)], "r long, c long, v double")
    got = {(r.r, r.c): r.v for r in grid.smooth(one, "v", 5, 5, 2).collect()}
    assert got[2, 2] == pytest.approx(5.0) and got[0, 0] == pytest.approx(5.0)


def test_lines(spark):
    points = spark.createDataFrame([(c, c + 0.5, 0.5) for c in range(10)], "c long, x double, y double")
    line = spark.createDataFrame([(1, 0.5, 0.0, 0.5, 8.0)], "geom_id int, x1 double, y1 double, x2 double, y2 double")
    got = {r.c: r.distance for r in geometry.nearest_distance(points, line, 1.0, ["c"]).collect()}
    assert got[0] == 0.0 and got[3] == 3.0
    middle = spark.createDataFrame([(0, 5.0, 3.5)], "c long, x double, y double")
    across = spark.createDataFrame([(1, 0.0, 3.5, 10.0, 3.5)], "geom_id int, x1 double, y1 double, x2 double, y2 double")
    assert geometry.line_density(middle, across, 2.0, ["c"]).first()["density"] == pytest.approx(4.0)
    with pytest.raises(ValueError):
        geometry.nearest_distance(points, line.limit(0), 1.0, ["c"])


def test_zones(spark):
    snake = [(0, c) for c in range(30)] + [(r, 29) for r in range(1, 20)] + [(10, 3), (11, 4)]
    got = components.label_zones(spark.createDataFrame(snake, "r long, c long"), 40).groupBy("zone").count().collect()
    assert sorted((r.zone, r["count"]) for r in got) == [(0, 49), (403, 2)]


def test_gradients_match_a_plane(spark):
    got = grid.gradients(board(spark, 6, lambda r, c: 3 * r + 2 * c), "v", 6, 6).collect()
    assert len(got) == 36 and all(math.isclose(r.gx, 2) and math.isclose(r.gy, 3) for r in got)
