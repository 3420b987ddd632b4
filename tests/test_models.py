import struct

from pyspark.sql import functions as F

from gridlode.operators import metrics, models
from gridlode.sources.bands import BandGrid


def planted(spark):
    g = spark.range(400).select(F.col("id").alias("cell_id"), *[(F.pmod(F.hash("id", F.lit(k)), F.lit(1000)) / 1000.0).alias(f"f{k}") for k in range(3)])
    return g.withColumn("presence", (F.col("f0") + F.col("f1") > 1.3).cast("int"))


def test_models_find_planted_presence(spark):
    g, columns = planted(spark), ["f0", "f1", "f2"]
    for estimator in (models.forest(columns, trees=15, leaf=2), models.boosted(columns, rounds=8), models.logistic(columns)):
        scored = models.fit_score(estimator, g.where("cell_id % 2 = 0"), g.where("cell_id % 2 = 1"))
        assert metrics.binary_metrics(scored).first()["auc"] > 0.9
        assert scored.where("score < 0 OR score > 1").isEmpty()


def test_reliable_negatives(spark):
    g = planted(spark).withColumn("s", F.col("f0"))
    kept = models.reliable_negatives(g, "s", 0.6)
    assert kept.where("presence = 1").count() == g.where("presence = 1").count()
    share = kept.where("presence = 0").count() / g.where("presence = 0").count()
    assert abs(share - 0.6) < 0.02


def test_band_grid(spark, tmp_path):
    header = """<?xml version="1.0" encoding="windows-1251"?><grid><Pic>4</Pic><Prf>4</Prf><dx>500</dx><dy>500</dy><x0>0</x0><y0>0</y0>
<Properties><Property><Name>val</Name><Caption>высота</Caption><DataType>dtSingle</DataType></Property>
<Property><Name>bits</Name><DataType>dtBitmask</DataType></Property><Property><Name>gone</Name><DataType>dtByte</DataType></Property></Properties></grid>"""
    (tmp_path / "g.pgrid").write_bytes(header.encode("cp1251"))
    (tmp_path / "g.val.property").write_bytes(struct.pack("<16f", *([10.0] * 15), float("nan")))
    (tmp_path / "g.bits.property").write_bytes(bytes([0b00000101, 0b10000000]))
    spark.dataSource.register(BandGrid)
    got = {(r.band, r.r, r.c): r.value for r in spark.read.format("band_grid").load(str(tmp_path / "g.pgrid")).collect()}
    assert len(got) == 32 and got["val", 0, 0] == 10.0 and got["val", 3, 3] is None
    assert [k[1] * 4 + k[2] for k, v in sorted(got.items()) if k[0] == "bits" and v] == [0, 2, 15]


def test_ensemble_fits_have_partitions_by_rows(spark, monkeypatch):
    g, seen = planted(spark).repartition(12), []

    def scored(estimator, train, cells, name="score"):
        seen.append((train.rdd.getNumPartitions(), train.where("presence = 1").count(), train.where("presence = 0").count()))
        return cells.withColumn(name, F.lit(float(len(seen) % 2)))

    monkeypatch.setattr(models, "fit_score", scored)
    got = models.ensemble(g, "cell_id", ["f0"], rounds=2, threads=1)
    positives = g.where("presence = 1").count()
    assert seen == [(1, positives, round(0.7 * (400 - positives)))] * 4
    assert got.count() == 400 and got.where("score = 0.5 AND spread = 0.5").count() == 400
    seen.clear()
    monkeypatch.setattr(models, "FIT_ROWS", 100)
    models.ensemble(g, "cell_id", ["f0"], rounds=1, threads=1)
    assert [n for n, _, _ in seen] == [-(-(positives + seen[0][2]) // 100)] * 2
