import struct

from pyspark.sql import functions as F

import pytest

from gridlode.operators import geometry
from gridlode.sources import bands, files, shapes


def poly(kind, *parts):
    points = [p for part in parts for p in part]
    starts = [sum(len(q) for q in parts[:i]) for i in range(len(parts))]
    return struct.pack("<i4d2i", kind, 0, 0, 0, 0, len(parts), len(points)) + struct.pack(f"<{len(parts)}i", *starts) + b"".join(struct.pack("<2d", *p) for p in points)


def write_shapes(stem, records, rows=None):
    shp, shx = bytearray(100), bytearray(100)
    for i, content in enumerate(records):
        shx += struct.pack(">2i", len(shp) // 2, len(content) // 2)
        shp += struct.pack(">2i", i + 1, len(content) // 2) + content
    (stem.parent / (stem.name + ".shp")).write_bytes(shp)
    (stem.parent / (stem.name + ".shx")).write_bytes(shx)
    if rows is not None:
        field = b"label".ljust(11, b"\0") + b"C" + bytes(4) + bytes([8]) + bytes(15)
        head = struct.pack("<4BI2H", 3, 0, 0, 0, len(rows), 65, 9) + bytes(20)
        body = b"".join(b" " + r.encode("cp1251").ljust(8) for r in rows)
        (stem.parent / (stem.name + ".dbf")).write_bytes(head + field + b"\r" + body)


def test_shapes(spark, tmp_path):
    square, hole = [(0, 0), (0, 8), (8, 8), (8, 0), (0, 0)], [(2, 2), (6, 2), (6, 6), (2, 6), (2, 2)]
    records = [poly(5, square, hole), struct.pack("<i", 0), poly(3, [(0, 0), (1, 1), (2, 0)]), struct.pack("<i2d", 1, 3.5, 4.5), struct.pack("<i4di4d", 8, 0, 0, 0, 0, 2, 1, 2, 3, 4), poly(3)]
    write_shapes(tmp_path / "слой", records, ["Au", "none", "разлом", "", "U", "x"])
    spark.dataSource.register(shapes.Shapes)
    read = lambda n: spark.read.format("shapes").option("encoding", "cp1251").option("records", n).load(str(tmp_path / "слой.shp"))
    got = read(2)
    assert got.rdd.getNumPartitions() == 3
    assert sorted(map(str, got.collect())) == sorted(map(str, read(100).collect()))
    counts = {(r.geom_id, r.kind, r.label): r["count"] for r in got.groupBy("geom_id", "kind", F.col("attributes")["label"].alias("label")).count().collect()}
    assert counts == {(0, "polygon", "Au"): 8, (2, "line", "разлом"): 2, (3, "point", None): 1, (4, "point", "U"): 2}
    point = spark.createDataFrame([(1, 1.0, 1.0), (2, 4.0, 4.0), (3, 9.0, 1.0)], "k int, x double, y double")
    inside = geometry.points_in_polygons(point, got.where("kind = 'polygon'").select("geom_id", "x1", "y1", "x2", "y2"), 3.0, ["k"]).collect()
    assert [(r.k, r.geom_id) for r in inside] == [(1, 0)]


def test_layers_and_projection(spark, tmp_path):
    write_shapes(tmp_path / "a", [struct.pack("<i2d", 1, 1, 2)])
    write_shapes(tmp_path / "b", [struct.pack("<i2d", 1, 3, 4)] * 2)
    got = shapes.layers(spark, {"mines": str(tmp_path / "a.shp"), "wells": str(tmp_path / "b.shp")}).groupBy("layer").count().collect()
    assert {r.layer: r["count"] for r in got} == {"mines": 1, "wells": 2}
    (tmp_path / "a.pj4").write_text("[x]\npj4=+proj=tmerc +lat_0=0\n")
    assert shapes.projection(spark, str(tmp_path / "a.pj4")) == "+proj=tmerc +lat_0=0" and shapes.projection(spark, str(tmp_path / "none.pj4")) is None


GAUSS = "+proj=tmerc +lon_0=105 +lat_0=0 +x_0=500000 +ellps=krass +towgs84=23.57,-140.95,-79.8,0,0.35,0.79,-0.22"


def test_layers_in_one_projection(spark, tmp_path):
    for name, point, line in (("mask", (500000.0, 7900000.0), GAUSS), ("wells", (105.0, 71.0), "+proj=longlat +datum=WGS84"), ("old", (1.0, 2.0), None)):
        write_shapes(tmp_path / name, [struct.pack("<i2d", 1, *point), poly(3, [point, (point[0] + 1, point[1] + 1)])])
        if line:
            (tmp_path / f"{name}.pj4").write_text(f"[projection]\n\npj4={line}\n")
    paths = {n: f"file://{tmp_path}/{n}.shp" for n in ("mask", "wells", "old")}
    got = {(r.layer, r.geom_id): r for r in shapes.layers(spark, paths, base="mask").collect()}
    assert (got["mask", 0].x1, got["mask", 0].y1) == (500000.0, 7900000.0) and (got["old", 0].x1, got["old", 1].x2) == (1.0, 2.0)
    well = got["wells", 0]
    assert abs(well.x1 - 500000) < 300 and well.x1 == well.x2 and 7.87e6 < well.y1 < 7.89e6
    back = shapes.to_projection(shapes.layers(spark, paths, base="mask").where("layer = 'wells'"), GAUSS, 4326).where("geom_id = 1").first()
    assert (back.x1, back.y1, back.x2, back.y2) == pytest.approx((105, 71, 106, 72), abs=1e-7)


def test_partitions_of_an_address_give_the_same_rows(spark, tmp_path):
    write_shapes(tmp_path / "r", [struct.pack("<i2d", 1, i, -i) for i in range(9)], [f"n{i}" for i in range(9)])
    spark.dataSource.register(shapes.Shapes)
    got = spark.read.format("shapes").option("records", "5").load(f"file://{tmp_path}/r.shp")
    assert got.rdd.getNumPartitions() == 2
    assert sorted(map(str, got.collect())) == sorted(map(str, shapes.read_shapes(spark, str(tmp_path / "r.shp")).collect()))
    write_shapes(tmp_path / "none", [])
    assert spark.read.format("shapes").load(str(tmp_path / "none.shp")).count() == 0


def test_the_folder_that_has_the_file(tmp_path):
    (tmp_path / "b").mkdir()
    (tmp_path / "b" / "mask.shp").touch()
    assert files.first_with([str(tmp_path / "a"), str(tmp_path / "b")], "mask.shp") == str(tmp_path / "b")
    with pytest.raises(FileNotFoundError):
        files.first_with([str(tmp_path / "a")], "mask.shp")


def test_band_names_are_not_patterns(spark, tmp_path):
    names = ["a,b", "x{1}", "p[2]", "s*r", "sr", "a"]
    listed = "".join(f"<Property><Name>{n}</Name><DataType>dtByte</DataType></Property>" for n in names)
    (tmp_path / "g,1.pgrid").write_text(f"<grid><Pic>2</Pic><Prf>1</Prf><dx>1</dx><dy>1</dy><x0>0</x0><y0>0</y0>{listed}</grid>")
    for i, n in enumerate(names):
        (tmp_path / f"g,1.{n}.property").write_bytes(bytes([i, i]))
    read = lambda include: {r.band: r.value for r in bands.read_bands(spark, str(tmp_path / "g,1.pgrid"), include)[1].collect()}
    assert read(None) == {n: float(i) for i, n in enumerate(names)}
    for n in names:
        assert set(read([n])) == {n}
    assert read([]) == {}
