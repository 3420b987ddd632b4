"""A data source for shapefiles: their geometries as segments, which the geometry operators take.

Files lie wherever Arrow's file systems reach (see sources.files); read_shapes takes those of any other one that Spark opens.
Options: path (the .shp; .shx and, if there is one, .dbf lie beside it), encoding of the attributes
(utf-8), records per input partition (10,000). The index gives every partition its own range of the
file. Rows: geom_id, part, seq, x1, y1, x2, y2, kind (point, line or polygon) and attributes. A point
is a segment of no length; null and empty geometries have no rows.
"""

from __future__ import annotations

import io
import posixpath
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from gridlode.functions import projections
from gridlode.sources.files import exists, opened, size

#: Kinds of shapes by their codes; those with heights or measures begin alike.
KINDS = {1: "point", 3: "line", 5: "polygon", 8: "points"}
HEADER = 100


def parts_of(content: bytes) -> tuple[str | None, list[list[tuple[float, float]]]]:
    """Kind and parts of one record; a point is a part of its own."""
    kind = KINDS.get(struct.unpack_from("<i", content)[0] % 10)
    if kind == "point":
        return kind, [[struct.unpack_from("<2d", content, 4)]]
    if kind == "points":
        n = struct.unpack_from("<i", content, 36)[0]
        return "point", [[struct.unpack_from("<2d", content, 40 + 16 * i)] for i in range(n)]
    if kind is None:
        return None, []
    n_parts, n_points = struct.unpack_from("<2i", content, 36)
    starts = [*struct.unpack_from(f"<{n_parts}i", content, 44), n_points]
    at = 44 + 4 * n_parts
    return kind, [[struct.unpack_from("<2d", content, at + 16 * i) for i in range(a, b)] for a, b in zip(starts, starts[1:], strict=False)]


class Attributes:
    """Fields of the table beside the shapes, given by its path or its bytes."""

    def __init__(self, path: str | bytes, encoding: str) -> None:
        self.path, self.encoding, self.fields = path, encoding, []
        with self.open() as f:
            head = f.read(32)
            self.first, self.size = struct.unpack_from("<2H", head, 8)
            while (field := f.read(32)) and field[0] != 0x0D:
                self.fields.append((field[:11].split(b"\0")[0].decode(encoding), field[16]))

    def open(self) -> io.BufferedIOBase:
        return io.BytesIO(self.path) if isinstance(self.path, bytes) else opened(self.path)

    def read(self, record: int, n: int) -> Iterator[dict[str, str]]:
        with self.open() as f:
            f.seek(self.first + record * self.size)
            for _ in range(n):
                row, at, out = f.read(self.size), 1, {}
                for name, length in self.fields:
                    value = row[at : at + length].decode(self.encoding).strip(" \0")
                    at += length
                    if value:
                        out[name] = value
                yield out


class Records(InputPartition):
    def __init__(self, first: int, n: int) -> None:
        super().__init__(first)
        self.first, self.n = first, n


class ShapeReader(DataSourceReader):
    def __init__(self, path: str, encoding: str, records: int) -> None:
        self.stem, self.encoding, self.records = posixpath.splitext(path)[0], encoding, records

    def partitions(self) -> list[Records]:
        n = (size(self.stem + ".shx") - HEADER) // 8
        return [Records(i, min(self.records, n - i)) for i in range(0, n, self.records)]

    def read(self, at: Records | None) -> Iterator[tuple]:
        if at is None:  # no records
            return
        table = self.stem + ".dbf"
        attributes = Attributes(table, self.encoding).read(at.first, at.n) if exists(table) else ({} for _ in range(at.n))
        with opened(self.stem + ".shx") as index, opened(self.stem + ".shp") as shapes:
            index.seek(HEADER + 8 * at.first)
            for i, own in zip(range(at.n), attributes, strict=True):
                offset, length = struct.unpack(">2i", index.read(8))  # both in words of two bytes
                shapes.seek(2 * offset + 8)
                kind, parts = parts_of(shapes.read(2 * length))
                for p, part in enumerate(parts):
                    for s, (a, b) in enumerate(zip(part, part if kind == "point" else part[1:], strict=False)):
                        yield at.first + i, p, s, *a, *b, kind, own


class Shapes(DataSource):
    """spark.dataSource.register(Shapes); spark.read.format("shapes").load(path)"""

    @classmethod
    def name(cls) -> str:
        return "shapes"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> ShapeReader:
        return ShapeReader(self.options["path"], self.options.get("encoding", "utf-8"), int(self.options.get("records", "10000")))


def read_shapes(spark: SparkSession, path: str, encoding: str = "utf-8") -> DataFrame:
    """The rows of the data source, from any file system that Spark can open; a file (of 2 GB at most, by its format) is one task."""
    stem = path.rpartition(".")[0]
    folder, _, name = stem.rpartition("/")
    files = spark.read.format("binaryFile").option("pathGlobFilter", f"{name}.{{shp,dbf}}").load(folder or ".")
    whole = files.select(F.regexp_extract("path", r"([^.]+)$", 1).alias("kind"), "content").groupBy(F.lit(1).alias("one")).pivot("kind", ["shp", "dbf"]).agg(F.first("content"))

    def read(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in found:
            for shp, dbf in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                table, at, rows = Attributes(dbf, encoding) if dbf else None, HEADER, []
                record = 0
                while at + 8 <= len(shp):
                    size = 2 * struct.unpack_from(">i", shp, at + 4)[0]
                    kind, parts = parts_of(shp[at + 8 : at + 8 + size])
                    own = next(table.read(record, 1)) if table and parts else {}
                    rows += [(record, p, s, *a, *b, kind, list(own.items())) for p, part in enumerate(parts) for s, (a, b) in enumerate(zip(part, part if kind == "point" else part[1:], strict=False))]
                    at, record = at + 8 + size, record + 1
                    if len(rows) >= BATCH:
                        yield _batch(rows)
                        rows = []
                yield _batch(rows)

    return whole.select("shp", "dbf").mapInArrow(read, SCHEMA)


#: Rows of one Arrow batch, and their columns.
BATCH = 1 << 15
SCHEMA = "geom_id long, part int, seq int, x1 double, y1 double, x2 double, y2 double, kind string, attributes map<string,string>"


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int32(), pa.int32(), *[pa.float64()] * 4, pa.string(), pa.map_(pa.string(), pa.string())]
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)], names=names)


def projection(spark: SparkSession, path: str) -> str | None:
    """The projection that a sidecar names in a line pj4=..., None without one."""
    folder, _, name = path.rpartition("/")
    found = spark.read.option("pathGlobFilter", name).text(folder or ".").select(F.regexp_extract("value", r"pj4=(.+)", 1).alias("p")).where("p <> ''").first()
    return found["p"].strip() if found else None


def same_projection(named: dict[str, str | None]) -> list[str]:
    """What to warn of: layers without a projection, and those that differ from the first one."""
    known = {k: v.split() for k, v in named.items() if v}
    first = next(iter(known.values()), None)
    none = [f"{k}: no projection" for k, v in named.items() if not v]
    return none + [f"{k}: differs from {next(iter(known))}" for k, v in known.items() if sorted(v) != sorted(first)]


def joined(rows: DataFrame, names: list[str], name: str) -> DataFrame:
    """The rows of several layers as one layer of that name, after all others."""
    return rows.where(~F.col("layer").isin(names)).unionByName(rows.where(F.col("layer").isin(names)).withColumn("layer", F.lit(name)))


def point_layers(rows: DataFrame, base: list[str]) -> DataFrame:
    """Points of all layers but the base ones; source_layer tells where each is from."""
    return rows.where((F.col("kind") == "point") & ~F.col("layer").isin(base)).withColumnRenamed("layer", "source_layer")


def to_projection(rows: DataFrame, source: str | int | None, target: str | int | None) -> DataFrame:
    """Segments taken from one projection to another; those of no known projection are taken to be in the target's."""
    return projections.reproject(rows, [("x1", "y1"), ("x2", "y2")], source, target)


def layers(spark: SparkSession, paths: dict[str, str], encoding: str = "utf-8", base: str | None = None) -> DataFrame:
    """All layers in one table, each row with the layer's name, in the projection of the layer base where that is given.

    A layer's projection is what its sidecar <stem>.pj4 says.
    """
    spark.dataSource.register(Shapes)
    sidecar = lambda path: projection(spark, posixpath.splitext(path)[0] + ".pj4")
    target = sidecar(paths[base]) if base else None
    out = None
    for name, path in paths.items():
        one = spark.read.format("shapes").option("encoding", encoding).load(path).withColumn("layer", F.lit(name))
        one = to_projection(one, sidecar(path), target) if base else one
        out = one if out is None else out.unionByName(one)
    return out
