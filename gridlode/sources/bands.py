"""Binary band grids: one XML header and one flat file per band.

read_bands reads them from any file system that Spark can open, each band's file in a task of its
own and as Arrow batches. The data source band_grid does the same for local files. Every
band whose file lies beside the header, as <stem>.<band>.property, is read; missing files are
skipped. Rows: band, r, c (row 0 is the north) and value.
"""

from __future__ import annotations

import os
import re
import xml.etree.ElementTree as ET
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

#: Kinds of bands.
SINGLE, BYTE, BITMASK = "dtSingle", "dtByte", "dtBitmask"
#: Values of one Arrow batch.
BATCH = 1 << 16
SCHEMA = "band string, r long, c long, value double"


@dataclass
class Header:
    """Shape, place and bands of a grid; numbers that the header doesn't give are None."""

    columns: int | None
    rows: int | None
    dx: float | None
    dy: float | None
    x0: float | None
    y0: float | None
    cells: int | None = None
    bands: dict[str, str] = field(default_factory=dict)
    statistics: dict[str, dict[str, float | None]] = field(default_factory=dict)

    @property
    def top(self) -> float:
        return self.y0 + self.rows * self.dy

    def band(self, name: str) -> str:
        """Kind of a band; a KeyError names those that there are."""
        if name not in self.bands:
            raise KeyError(f"no band {name}; there are {', '.join(self.bands)}")
        return self.bands[name]


def _number(text: str | None, kind: type) -> float | None:
    try:
        return kind(float((text or "").strip().replace(",", ".")))
    except ValueError:
        return None


def parse_header(content: bytes) -> Header:
    """The grid's shape, its bands' kinds and their statistics; the header may be in a single-byte Cyrillic encoding."""
    root = ET.fromstring(re.sub(r"^\s*<\?xml[^>]*\?>", "", content.decode("cp1251")))
    find = lambda tag: next((e.text for e in root.iter() if e.tag.lower() == tag and e.text), None)
    out = Header(*[_number(find(k), int) for k in ("pic", "prf")], *[_number(find(k), float) for k in ("dx", "dy", "x0", "y0")], _number(find("objcount"), int))
    for e in root.iter():
        names = {c.tag.lower(): c.text for c in e}
        if "name" in names and "datatype" in names:
            out.bands[names["name"]] = names["datatype"]
            known = {c.tag.lower(): c.text for c in e.iter()}
            if (known.get("statexists") or "").strip() == "True":
                out.statistics[names["name"]] = {k: _number(known.get(k), float) for k in ("min", "max", "average", "stdev")}
    return out


def read_header(path: str) -> Header:
    with open(path, "rb") as f:
        return parse_header(f.read())


def decode(data: bytes, kind: str, n: int) -> np.ndarray:
    """The first n values of a band; bits are numbered from the lowest of each byte."""
    if kind == SINGLE:
        return np.frombuffer(data, "<f4", n).astype(np.float64)
    if kind == BYTE:
        return np.frombuffer(data, np.uint8, n).astype(np.float64)
    if kind == BITMASK:
        return np.unpackbits(np.frombuffer(data, np.uint8, -(-n // 8)), bitorder="little")[:n].astype(np.float64)
    raise ValueError(f"unknown kind of band: {kind}")


def batches(name: str, values: np.ndarray, columns: int) -> Iterator[pa.RecordBatch]:
    for lo in range(0, len(values), BATCH):
        v = values[lo : lo + BATCH]
        at = np.arange(lo, lo + len(v))
        cells = [pa.array([name] * len(v), pa.string()), pa.array(at // columns), pa.array(at % columns), pa.array(v, mask=np.isnan(v))]
        yield pa.RecordBatch.from_arrays(cells, names=["band", "r", "c", "value"])


def header_of(spark: SparkSession, path: str) -> Header:
    return parse_header(bytes(spark.read.format("binaryFile").load(path).first()["content"]))


def read_bands(spark: SparkSession, path: str, include: list[str] | None = None) -> tuple[Header, DataFrame]:
    """The header and the rows of its bands, of those in include only, so that no other file is opened; an unknown name is a KeyError."""
    header = header_of(spark, path)
    wanted = {n: header.band(n) for n in (header.bands if include is None else include)}
    folder, _, file = path.rpartition("/")
    stem = os.path.splitext(file)[0]
    quoted = lambda text: re.sub(r"([\\\\*?\[\]{},^!])", r"\\\1", text)  # noqa: E731  as they stand, not as a pattern
    if not wanted:
        return header, spark.createDataFrame([], SCHEMA)
    names = ",".join(map(quoted, wanted))
    files = spark.read.format("binaryFile").option("pathGlobFilter", f"{quoted(stem)}.{{{names}}}.property").load(folder or ".")
    columns, n = header.columns, header.columns * header.rows

    def read(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in found:
            for file, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                name = file.rpartition("/")[2][len(stem) + 1 : -len(".property")]
                yield from batches(name, decode(content, wanted[name], n), columns)

    return header, files.select("path", "content").mapInArrow(read, SCHEMA)


@dataclass
class Band(InputPartition):
    path: str
    name: str
    kind: str
    columns: int
    rows: int

    def __init__(self, path: str, name: str, kind: str, columns: int, rows: int) -> None:
        super().__init__(name)
        self.path, self.name, self.kind, self.columns, self.rows = path, name, kind, columns, rows


class BandReader(DataSourceReader):
    def __init__(self, path: str) -> None:
        self.path = path

    def partitions(self) -> list[Band]:
        header, stem = read_header(self.path), os.path.splitext(self.path)[0]
        files = {name: f"{stem}.{name}.property" for name in header.bands}
        return [Band(files[n], n, kind, header.columns, header.rows) for n, kind in header.bands.items() if os.path.exists(files[n])]

    def read(self, band: Band) -> Iterator[pa.RecordBatch]:
        with open(band.path, "rb") as f:
            yield from batches(band.name, decode(f.read(), band.kind, band.columns * band.rows), band.columns)


class BandGrid(DataSource):
    """spark.dataSource.register(BandGrid); spark.read.format("band_grid").load(path)"""

    @classmethod
    def name(cls) -> str:
        return "band_grid"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> BandReader:
        return BandReader(self.options["path"])
