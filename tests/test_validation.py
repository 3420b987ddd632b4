"""Greedy folds and quantiles against plain Python, geometry with odd places, sources on any file system, the whole chain."""

import random
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridlode.functions import numeric
from gridlode.operators import geometry, points, terrain, validation
from gridlode.plans import materialize
from gridlode.sources import bands, shapes
from tests.test_entry import SMALL, needs_data
from tests.test_sources import write_shapes


def test_narrowed_quantiles(spark, monkeypatch):
    rng = random.Random(3)
    tied = [1.0] * 3000 + [2.0] * 3000 + [rng.random() for _ in range(200)]
    for values in ([rng.gauss(0, 1) for _ in range(5000)], tied, [5.0] * 2000, [0.0, 1.0] * 1000, [float(i % 7) for i in range(3000)]):
        rng.shuffle(values)
        frame = spark.createDataFrame([(v,) for v in values], "v double")
        shares = [0.0, 0.02, 0.5, 0.5001, 0.97, 1.0]
        monkeypatch.setattr(numeric, "EXACT_VALUES", 20)
        got = numeric.quantiles(frame, F.col("v"), shares)
        assert got == pytest.approx(np.quantile(values, shares).tolist(), abs=1e-9)


def test_stratified_folds_balance_both_classes(spark):
    rng = random.Random(4)
    rows = [(i, b, int(rng.random() < (0.5 if b % 7 == 0 else 0.02))) for i in range(4000) for b in [rng.randrange(40)]]
    cells = spark.createDataFrame(rows, "cell_id long, block long, presence int")
    folds = validation.greedy_folds(cells, 5, "presence")
    assert folds.count() == 40 and folds.select("block").distinct().count() == 40
    found = cells.join(folds, "block").groupBy("fold").agg(F.count("*").alias("n"), F.sum("presence").alias("p")).collect()
    assert len(found) == 5 and max(r.n for r in found) < 1.5 * min(r.n for r in found) and max(r.p for r in found) < 2 * min(r.p for r in found)


def test_polylines_cross_twice_and_lie_on_each_other(spark):
    seg = "geom_id long, x1 double, y1 double, x2 double, y2 double"
    a = spark.createDataFrame([(1, 0.0, 0.0, 2.0, 2.0), (1, 2.0, 2.0, 4.0, 0.0), (2, 0.0, 10.0, 10.0, 10.0)], seg)
    b = spark.createDataFrame([(9, 0.0, 1.0, 4.0, 1.0), (8, 4.0, 10.0, 20.0, 10.0)], seg)
    for size in (0.7, 3.0, 50.0):
        got = sorted((r.a_id, r.b_id, r.x, r.y, r.x2, r.y2) for r in geometry.crossings(a, b, size).collect())
        assert got == [(1, 9, 1.0, 1.0, 1.0, 1.0), (1, 9, 3.0, 1.0, 3.0, 1.0), (2, 8, 4.0, 10.0, 10.0, 10.0)]


def test_points_without_a_place_have_no_distance(spark):
    rows = [(1, 0.0, 3.0), (2, None, 1.0), (3, float("nan"), 1.0), (None, 0.0, 0.0), (5, 0.0, float("inf"))]
    line = spark.createDataFrame([(1, 0.0, 0.0, 1.0, 0.0)], "geom_id long, x1 double, y1 double, x2 double, y2 double")
    got = geometry.nearest_distance(spark.createDataFrame(rows, "k long, x double, y double"), line, 1.0, ["k"]).collect()
    assert sorted(((r.k, r.distance) for r in got), key=str) == [(1, 3.0), (2, None), (3, None), (5, None), (None, None)]


def test_sources_on_any_file_system(spark, tmp_path):
    write_shapes(tmp_path / "мины", [struct.pack("<i2d", 1, 1, 2), struct.pack("<i", 0), struct.pack("<i2d", 1, 3, 4)], ["Au", "x", "U"])
    spark.dataSource.register(shapes.Shapes)
    local = spark.read.format("shapes").option("encoding", "cp1251").load(str(tmp_path / "мины.shp"))
    anywhere = shapes.read_shapes(spark, f"file://{tmp_path}/мины.shp", "cp1251")
    assert sorted(map(str, anywhere.collect())) == sorted(map(str, local.collect())) and anywhere.count() == 2
    layers = anywhere.withColumn("layer", F.lit("mines")).unionByName(anywhere.withColumn("layer", F.lit("mask")))
    assert {r.source_layer for r in shapes.point_layers(layers, ["mask"]).collect()} == {"mines"}
    assert shapes.same_projection({"a": "+proj=x +k=1", "b": "+k=1 +proj=x", "c": None, "d": "+proj=y"}) == ["c: no projection", "d: differs from a"]
    prop = lambda n, k, s: f"<Prop><Name>{n}</Name><DataType>{k}</DataType>{s}</Prop>"
    known = "<Stat><StatExists>True</StatExists><Min>0</Min><Max>3</Max><Average>1,5</Average></Stat>"
    head = f"<?xml version='1.0' encoding='windows-1251'?><Grid><Pic>2</Pic><Prf>2</Prf><Dx>500</Dx><Dy>500</Dy><X0>1</X0><Name>сетка</Name>{prop('val', 'dtSingle', known)}{prop('bits', 'dtBitmask', '')}{prop('gone', 'dtByte', '')}</Grid>"
    (tmp_path / "g.pgrid").write_bytes(head.encode("cp1251"))
    (tmp_path / "g.val.property").write_bytes(struct.pack("<4f", 0, 1, float("nan"), 3))
    (tmp_path / "g.bits.property").write_bytes(bytes([0b0101]))
    header, rows = bands.read_bands(spark, f"file://{tmp_path}/g.pgrid")
    assert (header.columns, header.rows, header.dx, header.x0, header.y0, header.cells) == (2, 2, 500.0, 1.0, None, None)
    assert header.statistics == {"val": {"min": 0.0, "max": 3.0, "average": 1.5, "stdev": None}}
    got = {(r.band, r.r, r.c): r.value for r in rows.collect()}
    assert got == {("val", 0, 0): 0, ("val", 0, 1): 1, ("val", 1, 0): None, ("val", 1, 1): 3, ("bits", 0, 0): 1, ("bits", 0, 1): 0, ("bits", 1, 0): 1, ("bits", 1, 1): 0}
    only = bands.read_bands(spark, str(tmp_path / "g.pgrid"), ["bits"])[1]
    assert {r.band for r in only.collect()} == {"bits"}
    with pytest.raises(KeyError, match="val, bits, gone"):
        bands.read_bands(spark, str(tmp_path / "g.pgrid"), ["other"])
    with pytest.raises(KeyError, match="there are bits, val"):
        terrain.to_common_grid(rows, 1.0, 0.0, 0.0, rows.select("r", "c").distinct(), 1.0, include=["other"])


def test_occurrence_tables(spark, tmp_path):
    (tmp_path / "o.csv").write_bytes("id,name,lon,unused\n1,Münze,3.5,x\n2,,4,x\n".encode("latin-1"))
    got = points.read_occurrences(spark, str(tmp_path / "o.csv"), ["id", "name"])
    assert got.columns == ["id", "name"] and [r.name for r in got.orderBy("id").collect()] == ["Münze", None]
    assert got.where(points.mentions(["name"], "MÜNZE")).count() == 1
    assert got.select(points.first_column(got, ["absent", "id"])).columns == ["id"]
    with pytest.raises(KeyError):
        points.first_column(got, ["absent"])
    for form in ("parquet", "csv"):
        points.write_table(got, str(tmp_path / form), form)
    assert spark.read.parquet(str(tmp_path / "parquet")).count() == spark.read.option("header", True).csv(str(tmp_path / "csv")).count() == 2
    zeros, warned = terrain.with_samples(spark.createDataFrame([(0, 0)], "r long, c long"), None, ["dem"])
    assert zeros.first()["dem"] == 0.0 and warned


def test_a_cluster_needs_a_shared_folder():
    class Context:
        master = "spark://host"

        def getCheckpointDir(self):  # noqa: N802
            return None

    class Session:
        sparkContext = Context()  # noqa: N815
        conf = {}  # noqa: RUF012

    with pytest.raises(ValueError, match="checkpoint"):
        materialize.ensure_checkpoint_dir(Session())


@needs_data
def test_the_whole_chain(spark):
    import __spark_entry__

    rows = __spark_entry__.queries()["forecast"](spark, SMALL).collect()
    assert rows and all(0 <= r.prospectivity <= 1 and 0 <= r["class"] <= 19 for r in rows) and any(r.rank for r in rows)
    assert all(0 <= r[c] <= 1 for r in rows for c in ("ml_score", "ml_score_sm", "uncertainty")) and sum(r.presence for r in rows) >= 5
    mean = lambda k: sum(r.ml_score for r in rows if r.presence == k) / sum(r.presence == k for r in rows)
    assert mean(1) > mean(0)


def test_a_map_of_planted_presence(spark):
    """Presence along one line: the model's map is high there, whatever else there is; with too few points it is even."""
    from gridlode.operators import features, models

    cells = spark.range(900).select(F.col("id").alias("cell_id"), F.floor(F.col("id") / 30).alias("r"), (F.col("id") % 30).alias("c"))
    cells = cells.withColumns({"near": F.exp(-F.abs(F.col("c") - 9.0) / 2), "noise": F.pmod(F.hash("cell_id"), F.lit(100)) / 100.0, "presence": ((F.col("c") == 9) & (F.col("r") % 2 == 0)).cast("int")})
    out = models.train_map(cells, "cell_id", ["near", "noise"], 30, 30, background=300, rounds=1, trees=10, boosts=5)
    out = features.prospectivity(out, "ml_score", 30, 30).toPandas()
    assert len(out) == 900 and out[["ml_score", "ml_score_sm", "uncertainty", "prospectivity"]].apply(lambda s: s.between(0, 1).all()).all()
    by = out.groupby("c")["prospectivity"].mean()
    assert by.idxmax() in (8, 9, 10) and by[9] > by[20] + 0.5
    even = models.train_map(cells.withColumn("presence", (F.col("cell_id") < 3).cast("int")), "cell_id", ["near"], 30, 30)
    assert {(r.ml_score, r.ml_score_sm, r.uncertainty) for r in even.collect()} == {(0.5, 0.5, 0.0)}
