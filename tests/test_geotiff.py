"""Images written and read back, and files made by hand."""

import math
import os
import random
import struct
import zlib

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from gridlode.operators import tiles
from gridlode.operators.tiles import Grid
from gridlode.sources import geotiff


def pack(rows, columns, blocks, *, order="<", bits=32, form=3, compression=1, predictor=1, samples=1, planar=1, tile=None, strip_rows=None, nodata=None, keys=None, tie=(0, 0, 0, 100.0, 900.0, 0), scale=(10.0, 20.0, 0), big=False):
    """An image of ready blocks, its directory at the end."""
    body, offsets = b"", []
    for b in blocks:
        offsets.append(16 + len(body) if b else 0)
        body += b
    tags = [(256, 4, [columns]), (257, 4, [rows]), (258, 3, [bits] * samples), (259, 3, [compression]), (277, 3, [samples]), (284, 3, [planar]), (317, 3, [predictor]), (339, 3, [form] * samples), (33550, 12, scale), (33922, 12, tie)]
    if tile:
        tags += [(322, 3, [tile[1]]), (323, 3, [tile[0]]), (324, 4, offsets), (325, 4, [len(b) for b in blocks])]
    else:
        tags += [(273, 4, offsets), (278, 4, [strip_rows]), (279, 4, [len(b) for b in blocks])]
    if nodata is not None:
        tags.append((42113, 2, nodata.encode() + b"\0"))
    if keys:
        tags.append((34735, 3, keys))
    tags = [t for t in sorted(tags, key=lambda t: t[0]) if t[2] is not None]
    at = 16 + len(body)
    wide, inline, entry = ("Q", 8, 20) if big else ("I", 4, 12)
    after, entries = b"", b""
    start = at + (8 if big else 2) + entry * len(tags) + inline
    for tag, kind, values in tags:
        code = {2: "c", 3: "H", 4: "I", 12: "d"}[kind]
        content = values if kind == 2 else struct.pack(f"{order}{len(values)}{code}", *values)
        n = len(content) // struct.calcsize(code)
        if len(content) > inline:
            held, after = struct.pack(f"{order}{wide}", start + len(after)), after + content
        else:
            held = content.ljust(inline, b"\0")
        entries += struct.pack(f"{order}2H{wide}", tag, kind, n) + held
    mark = b"II" if order == "<" else b"MM"
    head = struct.pack(f"{order}2s3HQ", mark, 43, 8, 0, at) if big else struct.pack(f"{order}2sHI", mark, 42, at).ljust(16, b"\0")
    return head + body + struct.pack(f"{order}{'Q' if big else 'H'}", len(tags)) + entries + bytes(inline) + after


def read(spark, path, **options):
    spark.dataSource.register(geotiff.GeoTiff)
    return spark.read.format("geotiff").options(**options).load(str(path))


def values(df):
    """(band, r, c) to value."""
    out = {}
    for b in df.collect():
        for i, v in enumerate(b["values"]):
            out[b.band, b.r0 + i // b.columns, b.c0 + i % b.columns] = v
    return out


def strips(a, rows, compress=False):
    cut = [a[i : i + rows].tobytes() for i in range(0, len(a), rows)]
    return [zlib.compress(c) for c in cut] if compress else cut


def expected(a):
    return {(1, r, c): (None if np.isnan(v) else float(v)) for (r, c), v in np.ndenumerate(a.astype(float))}


@pytest.mark.parametrize("order", ["<", ">"])
@pytest.mark.parametrize("big", [False, True])
@pytest.mark.parametrize("kind,bits,form", [("f4", 32, 3), ("f8", 64, 3), ("u1", 8, 1), ("i2", 16, 2)])
def test_strips(spark, tmp_path, order, big, kind, bits, form):
    a = (np.arange(7 * 5).reshape(7, 5) * 3 % 101).astype(order + kind)
    (tmp_path / "a.tif").write_bytes(pack(7, 5, strips(a, 3, compress=big), order=order, big=big, bits=bits, form=form, compression=8 if big else 1, strip_rows=3))
    df = read(spark, tmp_path / "a.tif")
    assert values(df) == expected(a)
    first = df.where("r0 = 3").first()
    assert (first.x0, first.top, first.dx, first.dy, first.rows, first.columns) == (100.0, 900.0 - 60.0, 10.0, 20.0, 3, 5)


def test_only_wanted_blocks_are_read(spark, tmp_path):
    a = np.arange(40 * 64, dtype="<f4").reshape(40, 64)
    padded = np.pad(a, ((0, 8), (0, 0)))
    blocks = [zlib.compress(padded[i : i + 16, j : j + 16].tobytes()) for i in range(0, 48, 16) for j in range(0, 64, 16)]
    broken = [b if k in (5, 6) else b"xx" for k, b in enumerate(blocks)]  # only the middle row's inner tiles can be read
    (tmp_path / "t.tif").write_bytes(pack(40, 64, broken, compression=8, tile=(16, 16)))
    got = values(read(spark, tmp_path / "t.tif", window="20,32,18,46"))
    assert got == {k: v for k, v in expected(a).items() if 20 <= k[1] < 32 and 18 <= k[2] < 46}
    box = values(read(spark, tmp_path / "t.tif", box=f"{100 + 180},{900 - 32 * 20},{100 + 460},{900 - 400}"))
    assert box == got
    assert read(spark, tmp_path / "t.tif", window="50,60,0,5").count() == 0
    with pytest.raises(PySparkException):
        read(spark, tmp_path / "t.tif").collect()
    (tmp_path / "t.tif").write_bytes(pack(40, 64, blocks, compression=8, tile=(16, 16)))
    whole = read(spark, tmp_path / "t.tif", bytes="1")
    assert whole.rdd.getNumPartitions() == 12 and values(whole) == expected(a)


def test_nodata_place_and_codes(spark, tmp_path):
    a = np.array([[1, -9999, 3], [float("nan"), 1e31, 6]], "<f4")
    keys = [1, 1, 0, 2, 1024, 0, 1, 1, 3072, 0, 1, 32648]
    (tmp_path / "n.tif").write_bytes(pack(2, 3, strips(a, 2), strip_rows=2, nodata="-9999", keys=keys, tie=(1, 1, 0, 110.0, 880.0, 0)))
    assert [v for _, v in sorted(values(read(spark, tmp_path / "n.tif")).items())] == [1.0, None, 3.0, None, None, 6.0]
    h = geotiff.header(str(tmp_path / "n.tif"))
    assert (h.x0, h.top, h.epsg, h.nodata, h.box) == (100.0, 900.0, 32648, -9999.0, (100.0, 860.0, 130.0, 900.0))
    assert geotiff.header(f"file://{tmp_path}/n.tif").epsg == 32648


def test_predictors_and_bands(spark, tmp_path):
    a = (np.arange(6 * 8).reshape(6, 8) * 7 % 251).astype("<i2")
    diff = np.diff(a, axis=1, prepend=np.zeros((6, 1), "<i2")).astype("<i2")
    (tmp_path / "p.tif").write_bytes(pack(6, 8, strips(diff, 4, True), bits=16, form=2, compression=8, predictor=2, strip_rows=4))
    assert values(read(spark, tmp_path / "p.tif")) == expected(a)
    f = np.linspace(-3, 900, 48).reshape(6, 8).astype("<f4")
    planes = f.astype(">f4").view(np.uint8).reshape(6, 8, 4).transpose(0, 2, 1).reshape(6, 32)
    planes = np.diff(planes, axis=1, prepend=np.zeros((6, 1), np.uint8)).astype(np.uint8)
    (tmp_path / "q.tif").write_bytes(pack(6, 8, strips(planes, 6, True), compression=8, predictor=3, strip_rows=6))
    assert values(read(spark, tmp_path / "q.tif")) == expected(f)
    both = np.stack([a, a + 1], axis=2).astype("<i2")
    (tmp_path / "m.tif").write_bytes(pack(6, 8, strips(both, 2), bits=16, form=2, samples=2, strip_rows=2))
    (tmp_path / "s.tif").write_bytes(pack(6, 8, [*strips(a, 2), *strips((a + 1).astype("<i2"), 2)], bits=16, form=2, samples=2, planar=2, strip_rows=2))
    want = expected(a) | {(2, r, c): v + 1 for (_, r, c), v in expected(a).items()}
    assert values(read(spark, tmp_path / "m.tif")) == want == values(read(spark, tmp_path / "s.tif"))


def test_what_is_not_read(spark, tmp_path):
    a = np.zeros((2, 2), "<f4")
    for content in (b"no image at all", pack(2, 2, strips(a, 2), strip_rows=2, compression=5), pack(2, 2, strips(a, 2), strip_rows=2, scale=None), pack(2, 2, strips(a, 2), strip_rows=2, bits=1, form=1)):
        (tmp_path / "x.tif").write_bytes(content)
        with pytest.raises(ValueError):
            geotiff.header(str(tmp_path / "x.tif"))


def some_tiles(spark, grid, holes=0.2):
    rng = random.Random(5)
    rows = [(r, c, None if rng.random() < holes else float(rng.randrange(1, 200))) for r in range(grid.rows) for c in range(grid.columns)]
    return tiles.tiled(spark.createDataFrame(rows, "r long, c long, v double"), "v", grid)


def write(spark, df, path, grid, **options):
    spark.dataSource.register(geotiff.GeoTiff)
    place = {"rows": grid.rows, "columns": grid.columns, "x0": grid.x0, "top": grid.top, "dx": grid.dx, "dy": grid.dy, "side": grid.side}
    df.write.format("geotiff").options(**{k: str(v) for k, v in {**place, **options}.items()}).mode("overwrite").save(str(path))


@pytest.mark.parametrize("options", [{}, {"dtype": "uint8", "nodata": "0"}, {"dtype": "int16", "nodata": "-1", "epsg": "32648"}, {"dtype": "float64", "projection": "+proj=tmerc +lon_0=105 +ellps=krass"}])
def test_written_and_read_back(spark, tmp_path, options):
    grid = Grid(40, 55, 1000.0, 5000.0, 25.0, 50.0, 16)
    t = some_tiles(spark, grid).where("NOT (tr = 1 AND tc = 2)").repartition(5)
    path = tmp_path / "out.tif"
    write(spark, t, path, grid, **options)
    got = {k[1:]: v for k, v in values(read(spark, path)).items()}
    want = {(r.r, r.c): r["values"] for r in tiles.pixels(t, grid, ["values"]).collect()}
    assert len(got) == 40 * 55 and all(v == want.get(k) for k, v in got.items())
    assert os.listdir(tmp_path) == ["out.tif"]
    h = geotiff.header(str(path))
    assert (h.box, h.epsg, h.citation) == ((1000.0, 3000.0, 2375.0, 5000.0), int(options["epsg"]) if "epsg" in options else None, options.get("projection"))
    mosaic = tiles.pixels(tiles.mosaic(read(spark, path), grid), grid, ["values"])
    assert {(r.r, r.c): r["values"] for r in mosaic.where("values IS NOT NULL").collect()} == {k: v for k, v in want.items() if v is not None}


def test_a_failed_job_leaves_nothing(spark, tmp_path):
    grid = Grid(40, 55, side=16)
    t = some_tiles(spark, grid)
    write(spark, t, tmp_path / "old.tif", grid)
    before = (tmp_path / "old.tif").read_bytes()
    bad = [(t, {"dtype": "uint8"}), (t.unionByName(t.where("tr = 0")), {}), (t.withColumn("tr", F.col("tr") + 9), {})]
    for df, options in bad:
        with pytest.raises(PySparkException):
            write(spark, df, tmp_path / "old.tif", grid, **options)
        assert os.listdir(tmp_path) == ["old.tif"] and (tmp_path / "old.tif").read_bytes() == before
    with pytest.raises(PySparkException):
        t.write.format("geotiff").options(rows="40", columns="55", side="16").mode("append").save(str(tmp_path / "old.tif"))
    write(spark, t.where("tr > 99"), tmp_path / "none.tif", grid)
    assert set(values(read(spark, tmp_path / "none.tif")).values()) == {None}


def test_several_images_make_one(spark, tmp_path):
    left, right = Grid(16, 20, 0.0, 16.0, side=16), Grid(16, 20, 15.0, 16.0, side=16)
    for name, grid, v in (("a.tif", left, 1.0), ("b.tif", right, 2.0)):
        t = tiles.tiled(spark.range(16 * 20).select(F.floor(F.col("id") / 20).alias("r"), (F.col("id") % 20).alias("c"), F.lit(v).alias("v")), "v", grid)
        write(spark, t, tmp_path / name, grid)
    parts = geotiff.read_images(spark, [str(tmp_path / "b.tif"), str(tmp_path / "a.tif")])
    grid = Grid.over(tiles.place_of(parts), 1.0, 1.0, side=16)
    got = tiles.pixels(tiles.mosaic(parts, grid), grid, ["values"]).groupBy("values").count().collect()
    assert {r["values"]: r["count"] for r in got} == {1.0: 16 * 15, 2.0: 16 * 20} and not math.isnan(grid.x0)
