"""GeoTIFF images, read and written by their blocks.

    spark.dataSource.register(GeoTiff)
    spark.read.format("geotiff").option("box", "100,60,110,65").load(path)
    tiles.write.format("geotiff").options(rows=..., columns=..., x0=..., top=..., dx=..., dy=...).mode("overwrite").save(path)

Reading: strips or tiles of the file are dealt over the input partitions, and only those that meet the window are read
(options: window "r0,r1,c0,c1" in pixels, ends left out, or box "x0,y0,x1,y1" in the image's coordinates; bytes of a partition; priority).
Rows are blocks (see SCHEMA), which operators.tiles.mosaic takes. Values that equal the nodata tag, are not finite or
beyond 1e30 are missing. Uncompressed and deflated images of integers and floats, with or without predictors, in either
byte order, classic or big, north up, are read; others, and those without scale and tie point, are a ValueError.

Writing: rows are tiles (tr, tc, values) as operators.tiles has them. Every task compresses its tiles into a part of its own
beside the target; the commit writes the directory of tiles and appends the parts, so only offsets pass through the driver's memory. A
failed job takes its parts away and leaves the target as it was. Options: rows, columns, x0, top, dx, dy, side (a multiple of 16, 256), dtype
(float32), nodata (NaN for floats; integers need one if pixels are missing), epsg or projection (a line, kept as citation).
Tiles without a row are stored as absent, which readers take as missing; a tile that comes twice is an error.
"""

from __future__ import annotations

import math
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from gridlode.operators.terrain import LARGEST
from gridlode.operators.tiles import BLOCKS, Grid, arrays, lists
from gridlode.sources.files import exists, located, opened

SCHEMA = f"{BLOCKS}, band int, r0 long, c0 long"
#: Struct codes of the kinds of fields by their numbers, and the tags that are used.
FIELDS = {1: "B", 2: "c", 3: "H", 4: "I", 6: "b", 8: "h", 9: "i", 11: "f", 12: "d", 16: "Q", 17: "q"}
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC, STRIP_OFFSETS, SAMPLES, STRIP_ROWS, STRIP_BYTES, PLANAR, PREDICTOR = 256, 257, 258, 259, 262, 273, 277, 278, 279, 284, 317
TILE_WIDTH, TILE_HEIGHT, TILE_OFFSETS, TILE_BYTES, FORMAT, SCALE, TIE, KEYS, TEXTS, NODATA = 322, 323, 324, 325, 339, 33550, 33922, 34735, 34737, 42113
FORMATS = {1: "u", 2: "i", 3: "f"}
PLAIN, DEFLATE, OLD_DEFLATE = 1, 8, 32946
#: Bytes of the file's blocks in one input partition, and of one copy at commit.
PARTITION_BYTES, COPY_BYTES = 16 << 20, 8 << 20


@dataclass
class Image:
    """Shape, place and blocks of an image."""

    rows: int
    columns: int
    samples: int
    dtype: np.dtype
    compression: int
    predictor: int
    apart: bool
    tiled: bool
    block_rows: int
    block_columns: int
    offsets: np.ndarray
    sizes: np.ndarray
    x0: float
    top: float
    dx: float
    dy: float
    nodata: float | None
    epsg: int | None
    citation: str | None

    @property
    def box(self) -> tuple[float, float, float, float]:
        return self.x0, self.top - self.rows * self.dy, self.x0 + self.columns * self.dx, self.top

    @property
    def across(self) -> int:
        return -(-self.columns // self.block_columns)

    @property
    def down(self) -> int:
        return -(-self.rows // self.block_rows)


def parse(file: pa.NativeFile) -> Image:
    """What the first directory of a file says."""
    head = file.read_at(16, 0)
    order = {b"II": "<", b"MM": ">"}.get(head[:2])
    version = struct.unpack(order + "H", head[2:4])[0] if order else None
    if version not in (42, 43):
        raise ValueError("not a TIFF file")
    big = version == 43
    at = struct.unpack(order + ("Q" if big else "I"), head[8:16] if big else head[4:8])[0]
    n = struct.unpack(order + ("Q" if big else "H"), file.read_at(8 if big else 2, at))[0]
    entry, inline = (20, 8) if big else (12, 4)
    entries = file.read_at(n * entry, at + (8 if big else 2))
    tags = {}
    for i in range(n):
        e = entries[i * entry : (i + 1) * entry]
        tag, kind = struct.unpack(order + "2H", e[:4])
        count = struct.unpack(order + ("Q" if big else "I"), e[4 : entry - inline])[0]
        if kind not in FIELDS:
            continue
        size = count * struct.calcsize(FIELDS[kind])
        content = e[entry - inline :][:size] if size <= inline else file.read_at(size, struct.unpack(order + ("Q" if big else "I"), e[entry - inline :])[0])
        tags[tag] = content if kind == 2 else np.frombuffer(content, order + {"B": "u1", "H": "u2", "I": "u4", "Q": "u8", "b": "i1", "h": "i2", "i": "i4", "q": "i8", "f": "f4", "d": "f8"}[FIELDS[kind]])
    one = lambda tag, default=None: int(tags[tag][0]) if tag in tags else default
    if SCALE not in tags or TIE not in tags:
        raise ValueError("no pixel scale or tie point")
    compression, predictor = one(COMPRESSION, PLAIN), one(PREDICTOR, 1)
    if compression not in (PLAIN, DEFLATE, OLD_DEFLATE) or predictor not in (1, 2, 3):
        raise ValueError(f"compression {compression} with predictor {predictor} is not read")
    bits, form = {*map(int, tags.get(BITS, [1]))}, {*map(int, tags.get(FORMAT, [1]))}
    if len(bits) != 1 or len(form) != 1 or min(form) not in FORMATS or min(bits) not in (8, 16, 32, 64):
        raise ValueError(f"samples of {sorted(bits)} bits and format {sorted(form)} are not read")
    dtype = np.dtype(f"{order}{FORMATS[min(form)]}{min(bits) // 8}")
    tiled = TILE_OFFSETS in tags
    dx, dy = map(float, tags[SCALE][:2])
    i, j, _, x, y, _ = map(float, tags[TIE][:6])
    nodata = tags.get(NODATA, b"").split(b"\0")[0].strip().decode("ascii")
    epsg, citation = _keys(tags.get(KEYS), tags.get(TEXTS, b""))
    rows, columns = one(HEIGHT), one(WIDTH)
    return Image(
        rows, columns, one(SAMPLES, 1), dtype, compression, predictor, one(PLANAR, 1) == 2, tiled,
        one(TILE_HEIGHT) if tiled else min(rows, one(STRIP_ROWS, rows)), one(TILE_WIDTH) if tiled else columns,
        *(tags[t].astype(np.int64) for t in ((TILE_OFFSETS, TILE_BYTES) if tiled else (STRIP_OFFSETS, STRIP_BYTES))),
        x - i * dx, y + j * dy, dx, dy, float(nodata) if nodata else None, epsg, citation,
    )


def _keys(keys: np.ndarray | None, texts: bytes) -> tuple[int | None, str | None]:
    """Code of the coordinate system, and its citation."""
    epsg = citation = None
    for key, where, count, value in (keys[4 : 4 + 4 * int(keys[3])].reshape(-1, 4).tolist() if keys is not None else []):
        if key in (2048, 3072) and where == 0 and value != 32767:
            epsg = value
        if key == 1026 and where == TEXTS:
            citation = texts[value : value + count].rstrip(b"|\0").decode("utf-8")
    return epsg, citation


def header(path: str) -> Image:
    with opened(path) as f:
        return parse(f)


def decode(image: Image, data: bytes, rows: int) -> np.ndarray:
    """Values (row, column, sample) of a block of so many rows."""
    samples, columns, width = 1 if image.apart else image.samples, image.block_columns, image.dtype.itemsize
    if image.compression != PLAIN:
        data = zlib.decompress(data)
    if image.predictor == 3:
        planes = np.cumsum(np.frombuffer(data, np.uint8, rows * columns * samples * width).reshape(rows, -1, samples), axis=1, dtype=np.uint8)
        values = planes.reshape(rows, width, columns * samples).transpose(0, 2, 1).copy().view(f">{image.dtype.kind}{width}")
        return values.reshape(rows, columns, samples)
    values = np.frombuffer(data, image.dtype, rows * columns * samples).reshape(rows, columns, samples)
    return np.cumsum(values, axis=1, dtype=image.dtype.newbyteorder("=")) if image.predictor == 2 else values


class Blocks(InputPartition):
    """Numbers of the blocks that a task reads, with their places in the file."""

    def __init__(self, numbers: np.ndarray, offsets: np.ndarray, sizes: np.ndarray) -> None:
        super().__init__(int(numbers[0]))
        self.numbers, self.offsets, self.sizes = numbers, offsets, sizes


class ImageReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.path, self.priority, self.bytes = options["path"], int(options.get("priority", "0")), int(options.get("bytes", PARTITION_BYTES))
        self.image = image = header(self.path)
        self.window = 0, image.rows, 0, image.columns
        if "window" in options:
            self.window = tuple(int(x) for x in options["window"].split(","))
        elif "box" in options:
            x0, y0, x1, y1 = (float(x) for x in options["box"].split(","))
            self.window = math.floor((image.top - y1) / image.dy), math.ceil((image.top - y0) / image.dy), math.floor((x0 - image.x0) / image.dx), math.ceil((x1 - image.x0) / image.dx)
        self.offsets, self.sizes = image.offsets, image.sizes
        image.offsets = image.sizes = np.zeros(0, np.int64)  # tasks get their own

    def partitions(self) -> list[Blocks]:
        image, (r0, r1, c0, c1) = self.image, self.window
        r0, r1, c0, c1 = max(0, r0), min(image.rows, r1), max(0, c0), min(image.columns, c1)
        if r0 >= r1 or c0 >= c1:
            return []
        down, across = np.arange(r0 // image.block_rows, -(-r1 // image.block_rows)), np.arange(c0 // image.block_columns, -(-c1 // image.block_columns))
        planes = np.arange(image.samples if image.apart else 1)
        numbers = (planes[:, None, None] * (image.down * image.across) + down[None, :, None] * image.across + across[None, None, :]).ravel()
        parts = np.cumsum(self.sizes[numbers]) // self.bytes
        cuts = np.flatnonzero(np.diff(parts)) + 1
        return [Blocks(n, self.offsets[n], self.sizes[n]) for n in np.split(numbers, cuts)]

    def read(self, part: Blocks | None) -> Iterator[pa.RecordBatch]:
        if part is None:  # nothing meets the window
            return
        image, (w0, w1, z0, z1) = self.image, self.window
        with opened(self.path) as file:
            for number, offset, size in zip(part.numbers.tolist(), part.offsets.tolist(), part.sizes.tolist(), strict=True):
                plane, at = divmod(number, image.down * image.across)
                r0, c0 = at // image.across * image.block_rows, at % image.across * image.block_columns
                held = image.block_rows if image.tiled else min(image.block_rows, image.rows - r0)  # a last strip may be short
                r1, c1 = min(image.rows, r0 + image.block_rows, w1), min(image.columns, c0 + image.block_columns, z1)
                top, left = max(r0, w0), max(c0, z0)
                if size:
                    values = decode(image, file.read_at(size, offset), held)[top - r0 : r1 - r0, left - c0 : c1 - c0].astype(np.float64)
                    values[~np.isfinite(values) | (np.abs(values) > LARGEST)] = np.nan
                    if image.nodata is not None:
                        values[values == image.nodata] = np.nan
                else:
                    values = np.full((r1 - top, c1 - left, 1 if image.apart else image.samples), np.nan)
                bands = [plane] if image.apart else range(image.samples)
                for k, band in enumerate(bands):
                    yield self._batch(values[:, :, k], band + 1, top, left)

    def _batch(self, values: np.ndarray, band: int, r0: int, c0: int) -> pa.RecordBatch:
        image = self.image
        place = [image.x0 + c0 * image.dx, image.top - r0 * image.dy, image.dx, image.dy]
        columns = [pa.array([self.path]), pa.array([self.priority], pa.int32()), *(pa.array([float(v)]) for v in place), *(pa.array([n], pa.int32()) for n in values.shape), lists([values]), pa.array([band], pa.int32()), pa.array([r0], pa.int64()), pa.array([c0], pa.int64())]
        return pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in SCHEMA.split(", ")])


@dataclass
class Part(WriterCommitMessage):
    """A task's part: its path, and number and size of the tiles in it, in their order."""

    path: str
    tiles: np.ndarray
    sizes: np.ndarray


class ImageWriter(DataSourceArrowWriter):
    def __init__(self, options: dict[str, str], overwrite: bool) -> None:
        self.path, self.overwrite = options["path"], overwrite
        number = lambda k, default=None: float(options[k]) if k in options else default
        missing = [k for k in ("rows", "columns") if k not in options]
        if missing:
            raise ValueError(f"options {', '.join(missing)} are needed")
        self.grid = Grid(int(options["rows"]), int(options["columns"]), number("x0", 0.0), number("top", 0.0), number("dx", 1.0), number("dy", 1.0), int(options.get("side", "256")))
        self.dtype = np.dtype(options.get("dtype", "float32")).newbyteorder("<")
        if self.grid.side % 16 or self.dtype.kind not in "uif":
            raise ValueError("tiles need a side that 16 divides, and numbers")
        self.nodata = number("nodata", math.nan if self.dtype.kind == "f" else None)
        self.epsg, self.citation = (int(options["epsg"]) if "epsg" in options else None), options.get("projection")
        self.parts = f"{self.path}.parts-{uuid.uuid4().hex}"
        if not overwrite and exists(self.path):
            raise FileExistsError(self.path)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Part:
        system, folder = located(self.parts)
        system.create_dir(folder)
        name = f"{folder}/{uuid.uuid4().hex}"  # each attempt has its own
        numbers, sizes = [], []
        with system.open_output_stream(name) as out:
            for batch in iterator:
                tr, tc = (batch.column(batch.schema.get_field_index(k)).to_pylist() for k in ("tr", "tc"))
                for i, j, values in zip(tr, tc, arrays(batch.column(batch.schema.get_field_index("values"))), strict=True):
                    data = self.packed(i, j, values)
                    out.write(data)
                    numbers.append(i * self.grid.tile_columns + j)
                    sizes.append(len(data))
        return Part(name, np.array(numbers, np.int64), np.array(sizes, np.int64))

    def packed(self, tr: int, tc: int, values: np.ndarray) -> bytes:
        """A tile, filled up to its full side, compressed."""
        grid = self.grid
        if not (0 <= tr < grid.tile_rows and 0 <= tc < grid.tile_columns):
            raise ValueError(f"tile {tr}, {tc} lies outside of the image")
        if np.isnan(values).any() and self.nodata is None:
            raise ValueError("pixels are missing: integers need the option nodata")
        n, m = grid.size(tr, tc)
        tile = np.full((grid.side, grid.side), 0 if self.nodata is None else self.nodata, np.float64)
        tile[:n, :m] = np.where(np.isnan(values), tile[0, 0], values).reshape(n, m)
        return zlib.compress(tile.astype(self.dtype).tobytes(), 6)

    def commit(self, messages: list[Part | None]) -> None:
        parts = [m for m in messages if m is not None]
        system, target = located(self.path)
        numbers = np.concatenate([np.zeros(0, np.int64), *(p.tiles for p in parts)])
        sizes = np.concatenate([np.zeros(0, np.int64), *(p.sizes for p in parts)])
        if len(np.unique(numbers)) < len(numbers):
            self.abort(messages)
            raise ValueError("a tile comes twice")
        n = self.grid.tile_rows * self.grid.tile_columns
        big = int(sizes.sum()) + 32 * n + 4096 >= 1 << 32
        offsets, counts = np.zeros(n, np.int64), np.zeros(n, np.int64)
        first = len(self.directory(offsets, counts, big))
        offsets[numbers], counts[numbers] = first + np.cumsum(sizes) - sizes, sizes
        written = f"{located(self.parts)[1]}/image"
        system.create_dir(located(self.parts)[1])
        with system.open_output_stream(written) as out:
            out.write(self.directory(offsets, counts, big))
            for p in parts:
                with system.open_input_stream(p.path) as part:
                    while data := part.read(COPY_BYTES):
                        out.write(data)
        if self.overwrite and system.get_file_info(target).type == fs.FileType.File:
            system.delete_file(target)
        system.move(written, target)
        system.delete_dir(located(self.parts)[1])

    def abort(self, messages: list[Part | None]) -> None:
        system, folder = located(self.parts)
        if system.get_file_info(folder).type == fs.FileType.Directory:
            system.delete_dir(folder)

    def directory(self, offsets: np.ndarray, counts: np.ndarray, big: bool) -> bytes:
        """Header and directory of the image."""
        grid, long = self.grid, (16 if big else 4)
        code = {"u": 1, "i": 2, "f": 3}[self.dtype.kind]
        tags = [
            (WIDTH, 4, [grid.columns]), (HEIGHT, 4, [grid.rows]), (BITS, 3, [8 * self.dtype.itemsize]), (COMPRESSION, 3, [DEFLATE]), (PHOTOMETRIC, 3, [1]), (SAMPLES, 3, [1]), (TILE_WIDTH, 4, [grid.side]), (TILE_HEIGHT, 4, [grid.side]),
            (TILE_OFFSETS, long, offsets), (TILE_BYTES, long, counts), (FORMAT, 3, [code]), (SCALE, 12, [grid.dx, grid.dy, 0.0]), (TIE, 12, [0.0, 0.0, 0.0, grid.x0, grid.top, 0.0]),
        ]
        keys, texts = [], ""
        if self.epsg or self.citation:
            from gridlode.functions.projections import parse as projection

            geographic = projection(self.citation).kind == "longlat" if self.citation else 4000 <= self.epsg < 5000
            keys = [(1024, 0, 1, 2 if geographic else 1), (1025, 0, 1, 1)]
            if self.citation:
                texts = self.citation + "|"
                keys.append((1026, TEXTS, len(texts.encode()), 0))
            keys.append((2048 if geographic else 3072, 0, 1, self.epsg or 32767))
            tags.append((KEYS, 3, [1, 1, 0, len(keys), *(x for k in keys for x in k)]))
        if texts:
            tags.append((TEXTS, 2, texts.encode() + b"\0"))
        if self.nodata is not None:
            tags.append((NODATA, 2, f"{self.nodata:g}".encode() + b"\0"))
        wide = "Q" if big else "I"
        head = struct.pack("<2s3HQ", b"II", 43, 8, 0, 16) if big else struct.pack("<2sHI", b"II", 42, 8)
        inline, entries, after = struct.calcsize(wide), b"", b""
        start = len(head) + (8 if big else 2) + len(tags) * (4 + 2 * inline) + inline
        for tag, kind, values in tags:
            content = bytes(values) if kind == 2 else np.asarray(values, f"<{ {3: 'u2', 4: 'u4', 12: 'f8', 16: 'u8'}[kind] }").tobytes()
            count = len(content) // struct.calcsize(FIELDS[kind])
            if len(content) <= inline:
                held = content.ljust(inline, b"\0")
            else:
                held = struct.pack(f"<{wide}", start + len(after))
                after += content.ljust(-(-len(content) // 8) * 8, b"\0")
            entries += struct.pack(f"<2H{wide}", tag, kind, count) + held
        return head + struct.pack("<Q" if big else "<H", len(tags)) + entries + bytes(inline) + after


class GeoTiff(DataSource):
    """spark.dataSource.register(GeoTiff); format "geotiff"."""

    @classmethod
    def name(cls) -> str:
        return "geotiff"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> ImageReader:
        return ImageReader(self.options)

    def writer(self, schema: StructType, overwrite: bool) -> ImageWriter:
        return ImageWriter(self.options, overwrite)


def read_images(spark: SparkSession, paths: list[str], **options: str):
    """Blocks of several images in one frame; those earlier in the list have the lesser priority number, which a mosaic prefers."""
    spark.dataSource.register(GeoTiff)
    out = None
    for i, path in enumerate(paths):
        one = spark.read.format("geotiff").options(priority=str(i), **options).load(path)
        out = one if out is None else out.unionByName(one)
    return out
