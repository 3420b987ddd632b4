import math

import pytest
from pyspark.sql import functions as F

from gridlode.operators import geometry, grid, metrics, models, sampling

SEGMENT = "geom_id int, x1 double, y1 double, x2 double, y2 double"


def edges(spark, *boxes):
    return geometry.box_edges(spark.createDataFrame([(i, *map(float, b)) for i, b in enumerate(boxes)], "geom_id int, x0 double, y0 double, x1 double, y1 double"))


def centres(spark, columns, rows):
    return spark.createDataFrame([(r, c, c + 0.5, r + 0.5) for r in range(rows) for c in range(columns)], "r long, c long, x double, y double")


def test_inside_a_polygon_the_distance_is_zero(spark):
    got = geometry.distance_to_polygons(centres(spark, 10, 8), edges(spark, (0, 0, 5, 8)), 1.0, ["r", "c"]).collect()
    assert len(got) == 80 and all((r.distance == 0) == (r.c < 5) for r in got)
    assert all(math.isclose(r.distance, r.c + 0.5 - 5) for r in got if r.c >= 5)


def test_a_hole_is_outside(spark):
    ring = edges(spark, (0, 0, 8, 8)).unionByName(edges(spark, (2, 2, 6, 6)))
    inside = {(r.r, r.c) for r in geometry.points_in_polygons(centres(spark, 8, 8), ring.withColumn("geom_id", F.lit(1)), 2.0, ["r", "c"]).collect()}
    assert inside == {(r, c) for r in range(8) for c in range(8) if not (2 <= r < 6 and 2 <= c < 6)}


def test_density_of_a_covering_polygon_is_the_circle(spark):
    point = spark.createDataFrame([(0, 5.0, 4.0), (1, 100.0, 100.0), (2, -5.0, 4.0)], "k int, x double, y double")
    got = {r.k: r.density for r in geometry.density(point, edges(spark, (-5, -20, 30, 30)), 1.5, ["k"], "area").collect()}
    circle = math.pi * 1.5**2
    assert got[0] == pytest.approx(circle) and got[1] == 0.0 and got[2] == pytest.approx(circle / 2)
    with pytest.raises(ValueError):
        geometry.density(point, edges(spark, (0, 0, 1, 1)), 1.0, ["k"], "volume")


def test_cells_and_lines(spark):
    line = spark.createDataFrame([(1, 0.5, 0.5, 3.0, 0.5), (2, 9.5, 9.5, 9.5, 9.5)], SEGMENT)
    touched = {(r.r, r.c) for r in geometry.cells_touched(centres(spark, 10, 10), line, 0.5, ["r", "c"]).collect()}
    assert touched == {(0, 0), (0, 1), (0, 2), (0, 3), (9, 9)}
    far = {(r.r, r.c): r.distance for r in geometry.nearest_distance(centres(spark, 10, 10), line, 1.0, ["r", "c"], half=0.5).collect()}
    assert far[0, 0] == 0.0 and far[1, 1] == pytest.approx(0.5) and far[0, 5] == pytest.approx(2.0) and len(far) == 100


def test_without_crossings_the_fallback_counts(spark):
    a, b = spark.createDataFrame([(1, 0.0, 0.0, 1.0, 0.0)], SEGMENT), spark.createDataFrame([(1, 0.0, 5.0, 1.0, 5.0)], SEGMENT)
    assert {r.distance for r in geometry.node_distance(centres(spark, 2, 2), a, b, 1.0, ["r", "c"], 7.0).collect()} == {7.0}


def test_grid_over_a_mask(spark):
    got = geometry.build_grid(edges(spark, (0, 0, 1000, 1000)), 100.0).orderBy("cell_id").collect()
    assert [r.cell_id for r in got] == list(range(100)) and (got[11].r, got[11].c, got[11].x, got[11].y) == (1, 1, 150.0, 150.0)
    assert geometry.build_grid(edges(spark, (0, 0, 1, 1)).limit(0), 1.0).isEmpty()


def test_resampling(spark):
    rows = [(r, c, float((r + c) % 2), 179.0 if (r + c) % 2 else -179.0) for r in range(8) for c in range(8)]
    board = spark.createDataFrame(rows, "r long, c long, v double, a double")
    assert {r.v for r in grid.resample_area(board, "v", 1.0, 2.0).collect()} == {0.5}
    assert all(abs(r.v - 7) < 1e-12 for r in grid.resample_area(board.withColumn("v", F.lit(7.0)), "v", 1.0, 1.7, 0.3, 0.4).collect())
    points = spark.createDataFrame([(i, i + 0.5, 2.5, None) for i in range(6)] + [(9, None, 1.0, None)], "id int, y double, x double, note string")
    got = {r.id: r.a for r in grid.bilinear_angle(board, "a", points, F.col("y"), F.col("x")).collect()}
    assert got.pop(9) is None and len(got) == 6 and all(abs(abs(v) - 180) < 1.5 for v in got.values())


def test_grouped_quantiles(spark):
    rows = spark.range(3000).select((F.col("id") % 3).alias("k"), F.pmod(F.hash("id"), F.lit(40)).cast("double").alias("v"))
    want = {r.k: r.q for r in rows.groupBy("k").agg(F.percentile("v", [0.1, 0.85]).alias("q")).collect()}
    got = metrics.grouped_quantiles(rows, ["k"], "v", [0.1, 0.85]).collect()
    assert len(got) == 6 and all(r.limit == pytest.approx(want[r.k][0 if r.share < 0.5 else 1]) for r in got)


def test_folds_hold_blocks_together(spark):
    cells = spark.range(500).select((F.col("id") % 31).alias("block"), (F.col("id") % 7 == 0).cast("int").alias("presence"))
    for label in (None, "presence"):
        got = sampling.group_folds(cells, 5, label).collect()
        assert len(got) == 31 and {r.fold for r in got} == {0, 1, 2, 3, 4}
    seeded = sampling.seeded_folds(cells, 5, [1, 2]).collect()
    assert len(seeded) == 62 and len({(r.seed, r.block) for r in seeded}) == 62


def test_comparison_of_equal_models_is_not_significant(spark):
    pairs = spark.createDataFrame([(s, f, 1.0 + f, 1.0 + f + d) for s in range(2) for f in range(5) for d in [0.0]], "seed int, fold int, a double, b double")
    same = sampling.paired_comparison(pairs, ["seed", "fold"], "a", "b", 50, 1).first()
    better = sampling.paired_comparison(pairs.withColumn("b", F.col("b") + 1), ["seed", "fold"], "a", "b", 50, 1).first()
    assert not same.significant and same.n == 10 and better.significant and better.win_rate == 1.0


def test_training_needs_positives(spark):
    cells = spark.range(60).select(F.col("id").alias("cell_id"), (F.col("id") / 60).alias("f0"), (F.col("id") > 30).cast("int").alias("presence"))
    few = models.train_score(cells.withColumn("presence", (F.col("cell_id") == 1).cast("int")), "cell_id", ["f0"]).select("ml_score", "spread").distinct().collect()
    assert [tuple(r) for r in few] == [(0.5, 0.0)]
    got = models.train_score(cells, "cell_id", ["f0"], rounds=1, trees=5, boosts=3).collect()
    assert len(got) == 60 and all(0 <= r.ml_score <= 1 for r in got)
    assert models.importances(models.forest(["f0"], trees=3), cells, ["f0"]).first()["importance"] == pytest.approx(1.0)


def test_training_without_background_is_even(spark):
    """On a grid that occurrences fill there is nothing to tell presence from; a single cell of background is enough to learn."""
    cells = spark.range(40).select(F.col("id").alias("cell_id"), (F.col("id") / 40).alias("f0"), F.lit(1).alias("presence"))
    full = models.train_score(cells, "cell_id", ["f0"]).collect()
    assert len(full) == 40 and {(r.ml_score, r.spread) for r in full} == {(0.5, 0.0)}
    one = cells.withColumn("presence", (F.col("cell_id") > 0).cast("int"))
    got = models.train_score(one, "cell_id", ["f0"], rounds=1, share=0.3, trees=3, boosts=2).collect()
    assert len(got) == 40 and all(0 <= r.ml_score <= 1 for r in got)
