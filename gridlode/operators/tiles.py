"""Rasters held as tiles: one row a tile, its pixels an array.

A tile row is tr, tc and arrays of side by side pixels, row by row from the north (fewer at the far edges); null is a
missing pixel. Neighbourhoods don't copy pixels: every tile sends strips of the neighbourhood's width to its eight
neighbours, and each tile is worked on with its strips. Grouped steps take their rows batch by batch and hold
arrays of one tile only, however many rows meet there.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridlode.functions.numeric import finite
from gridlode.operators.terrain import POSITION, ROUGHNESS

DERIVED = ["slope", "curvature", "position", "roughness"]
BLOCKS = "source string, priority int, x0 double, top double, dx double, dy double, rows int, columns int, values array<double>"


@dataclass(frozen=True)
class Grid:
    """rows by columns pixels of dx by dy from the upper left corner (x0, top), in tiles of side pixels."""

    rows: int
    columns: int
    x0: float = 0.0
    top: float = 0.0
    dx: float = 1.0
    dy: float = 1.0
    side: int = 256

    @classmethod
    def over(cls, box: tuple[float, float, float, float], dx: float, dy: float, pad: float = 0.0, side: int = 256) -> Grid:
        """The grid that covers a padded box (x0, y0, x1, y1) from its upper left corner on."""
        x0, y0, x1, y1 = box[0] - pad, box[1] - pad, box[2] + pad, box[3] + pad
        return cls(max(1, round((y1 - y0) / dy)), max(1, round((x1 - x0) / dx)), x0, y1, dx, dy, side)

    @property
    def tile_rows(self) -> int:
        return -(-self.rows // self.side)

    @property
    def tile_columns(self) -> int:
        return -(-self.columns // self.side)

    def span(self, t: int, axis: str) -> tuple[int, int]:
        """First pixel of a tile along an axis, and the first one behind it."""
        return t * self.side, min((t + 1) * self.side, self.rows if axis == "r" else self.columns)

    def size(self, tr: int, tc: int) -> tuple[int, int]:
        (a, b), (c, d) = self.span(tr, "r"), self.span(tc, "c")
        return b - a, d - c


def arrays(column: pa.Array) -> list[np.ndarray]:
    """The rows of a list column as arrays, null elements as NaN."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    ends = np.cumsum(column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
    return np.split(flat, ends[:-1]) if len(ends) else []


def lists(values: list[np.ndarray]) -> pa.Array:
    """Arrays as a list column, NaN as null."""
    flat = np.concatenate([np.zeros(0), *(v.ravel() for v in values)])
    ends = np.concatenate([[0], np.cumsum([v.size for v in values])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat, mask=np.isnan(flat)))


def _column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def _one(key: tuple[int, int], **columns: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*(pa.array([k], pa.int64()) for k in key), *(lists([v]) for v in columns.values())], names=["tr", "tc", *columns])


def tiled(pixels: DataFrame, value: str, grid: Grid) -> DataFrame:
    """tr, tc and values of pixels (r, c, value); pixels beyond the grid and tiles without any are left out."""
    at = lambda a: F.floor(F.col(a) / grid.side).cast("long")
    inside = pixels.where(F.col("r").between(0, grid.rows - 1) & F.col("c").between(0, grid.columns - 1))
    placed = inside.select(at("r").alias("tr"), at("c").alias("tc"), (F.col("r") % grid.side).cast("int").alias("i"), (F.col("c") % grid.side).cast("int").alias("j"), finite(F.col(value)).alias("v"))

    def fill(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tile = key[0].as_py(), key[1].as_py()
        out = np.full(grid.size(*tile), np.nan)
        for b in batches:
            out[_column(b, "i").to_numpy(), _column(b, "j").to_numpy()] = _column(b, "v").to_numpy(zero_copy_only=False)
        yield _one(tile, values=out)

    return placed.groupBy("tr", "tc").applyInArrow(fill, "tr long, tc long, values array<double>")


def pixels(tiles: DataFrame, grid: Grid, columns: list[str]) -> DataFrame:
    """r, c and the columns, one row a pixel."""
    width = F.least(F.lit(grid.side), grid.columns - F.col("tc") * grid.side)
    each = tiles.select("tr", "tc", width.alias("width"), F.posexplode(F.arrays_zip(*columns)).alias("at", "p"))
    return each.select((F.col("tr") * grid.side + F.floor(F.col("at") / F.col("width"))).alias("r"), (F.col("tc") * grid.side + F.col("at") % F.col("width")).alias("c"), *[F.col("p")[c].alias(c) for c in columns])


def every_tile(tiles: DataFrame, grid: Grid) -> DataFrame:
    """The tiles of the whole grid; those without a row have null in place of arrays."""
    n = grid.tile_columns
    at = tiles.sparkSession.range(grid.tile_rows * n).select(F.floor(F.col("id") / n).cast("long").alias("tr"), (F.col("id") % n).alias("tc"))
    return at.join(tiles, ["tr", "tc"], "left")


def sample(points: DataFrame, tiles: DataFrame, grid: Grid, columns: list[str]) -> DataFrame:
    """points (x, y) with the values of the pixels that they lie in, missing beyond the grid; arrays stay in their rows."""
    r, c = F.floor((grid.top - F.col("y")) / grid.dy).cast("long"), F.floor((F.col("x") - grid.x0) / grid.dx).cast("long")
    placed = points.withColumns({"_r": r, "_c": c}).withColumns({"tr": F.floor(F.col("_r") / grid.side).cast("long"), "tc": F.floor(F.col("_c") / grid.side).cast("long")})
    found = placed.join(tiles.select("tr", "tc", *[F.col(k).alias(f"_{k}") for k in columns]), ["tr", "tc"], "left")
    width = F.least(F.lit(grid.side), grid.columns - F.col("tc") * grid.side)
    inside = F.col("_r").between(0, grid.rows - 1) & F.col("_c").between(0, grid.columns - 1)
    at = ((F.col("_r") % grid.side) * width + F.col("_c") % grid.side).cast("int")
    return found.select(*points.columns, *[F.when(inside, F.get(f"_{k}", at)).alias(k) for k in columns])


def neighbourhoods(tiles: DataFrame, grid: Grid, halo: int) -> DataFrame:
    """Pieces (tr, tc, r0, c0, rows, columns, values) of all tiles: each tile itself and strips of halo pixels of its neighbours."""
    if halo > grid.side:
        raise ValueError(f"strips of {halo} pixels are wider than tiles of {grid.side}")

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for tr, tc, flat in zip(_column(b, "tr").to_pylist(), _column(b, "tc").to_pylist(), arrays(_column(b, "values")), strict=True):
                (r0, r1), (c0, c1) = grid.span(tr, "r"), grid.span(tc, "c")
                tile = flat.reshape(r1 - r0, c1 - c0) if flat.size else np.full((r1 - r0, c1 - c0), np.nan)
                rows = []
                for i in range(max(0, tr - 1), min(grid.tile_rows, tr + 2)):
                    for j in range(max(0, tc - 1), min(grid.tile_columns, tc + 2)):
                        (a, z), (f, g) = grid.span(i, "r"), grid.span(j, "c")
                        top, left = max(r0, a - halo), max(c0, f - halo)
                        piece = tile[top - r0 : max(top, min(r1, z + halo)) - r0, left - c0 : max(left, min(c1, g + halo)) - c0]
                        rows.append((i, j, top, left, *piece.shape, piece))
                cells = [pa.array([r[k] for r in rows], pa.int64()) for k in range(6)]
                yield pa.RecordBatch.from_arrays([*cells, lists([r[6] for r in rows])], names=["tr", "tc", "r0", "c0", "rows", "columns", "values"])

    return tiles.select("tr", "tc", "values").mapInArrow(send, "tr long, tc long, r0 long, c0 long, rows long, columns long, values array<double>")


def _with_strips(grid: Grid, halo: int, tr: int, tc: int, batches: Iterator[pa.RecordBatch]) -> tuple[np.ndarray, int, int]:
    """The pixels of a tile and of halo pixels around it within the grid, and where they begin."""
    (r0, r1), (c0, c1) = grid.span(tr, "r"), grid.span(tc, "c")
    top, left = max(0, r0 - halo), max(0, c0 - halo)
    out = np.full((min(grid.rows, r1 + halo) - top, min(grid.columns, c1 + halo) - left), np.nan)
    for b in batches:
        a, f, n, m = (_column(b, k).to_numpy() for k in ("r0", "c0", "rows", "columns"))
        for i, v in enumerate(arrays(_column(b, "values"))):
            out[a[i] - top : a[i] - top + n[i], f[i] - left : f[i] - left + m[i]] = v.reshape(n[i], m[i])
    return out, top, left


def _folded(first: int, last: int, n: int) -> np.ndarray:
    """Indexes from first to last; those beyond an edge of n pixels mirrored, the edge pixel itself twice."""
    at = np.arange(first, last) % (2 * n)
    return np.where(at < n, at, 2 * n - 1 - at)


def _mean(v: np.ndarray, size: int) -> np.ndarray:
    """Means over size by size pixels, that many less one fewer along each axis."""
    for axis in (0, 1):
        v = np.lib.stride_tricks.sliding_window_view(v, size, axis).mean(-1)
    return v


def _slope(v: np.ndarray, axis: int) -> np.ndarray:
    return np.gradient(v, axis=axis) if v.shape[axis] > 1 else np.zeros_like(v)


def derivatives(tiles: DataFrame, grid: Grid) -> DataFrame:
    """tr, tc, elevation (as it is), slope, curvature, position and roughness of the whole grid; gaps count as the mean of all."""
    halo = max(POSITION, ROUGHNESS) // 2
    mean = tiles.select(F.explode("values").alias("v")).agg(F.avg("v")).first()[0] or 0.0

    def derive(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tr, tc = key[0].as_py(), key[1].as_py()
        raw, top, left = _with_strips(grid, halo, tr, tc, batches)
        e = np.where(np.isnan(raw), mean, raw)
        (r0, r1), (c0, c1) = grid.span(tr, "r"), grid.span(tc, "c")
        own = (slice(r0 - top, r1 - top), slice(c0 - left, c1 - left))
        gy, gx = _slope(e, 0), _slope(e, 1)
        curvature = _slope(gx, 1) + _slope(gy, 0)

        def mean_of(v: np.ndarray, size: int) -> np.ndarray:
            half = size // 2
            rows, columns = _folded(r0 - half, r1 + half, grid.rows) - top, _folded(c0 - half, c1 + half, grid.columns) - left
            return _mean(v[np.ix_(rows, columns)], size)

        near, fine, square = mean_of(e, POSITION), mean_of(e, ROUGHNESS), mean_of(e * e, ROUGHNESS)
        yield _one((tr, tc), elevation=raw[own], slope=np.hypot(gx, gy)[own], curvature=curvature[own], position=e[own] - near, roughness=np.sqrt(np.maximum(square - fine * fine, 0.0)))

    columns = ", ".join(f"{c} array<double>" for c in ("elevation", *DERIVED))
    pieces = neighbourhoods(every_tile(tiles, grid), grid, halo)
    return pieces.groupBy("tr", "tc").applyInArrow(derive, f"tr long, tc long, {columns}")


def blocks(tiles: DataFrame, grid: Grid, source: str, priority: int) -> DataFrame:
    """The tiles of one raster as rows that say where they lie."""
    rows = F.least(F.lit(grid.side), grid.rows - F.col("tr") * grid.side)
    columns = F.least(F.lit(grid.side), grid.columns - F.col("tc") * grid.side)
    x0, top = grid.x0 + F.col("tc") * (grid.side * grid.dx), grid.top - F.col("tr") * (grid.side * grid.dy)
    return tiles.select(F.lit(source).alias("source"), F.lit(priority).alias("priority"), x0.alias("x0"), top.alias("top"), F.lit(grid.dx).alias("dx"), F.lit(grid.dy).alias("dy"), rows.cast("int").alias("rows"), columns.cast("int").alias("columns"), "values")


def mosaic(parts: DataFrame, grid: Grid) -> DataFrame:
    """tr, tc and values of the grid, out of blocks of rasters of any resolution (see BLOCKS).

    A pixel is interpolated between the four pixels of a raster around its centre, the weights of missing ones
    dealt to the others; it takes the raster of least priority (then name) that has a value there. Each block goes
    only to the tiles that it touches; first the blocks of one raster are put together, then the rasters.
    """
    # half a pixel beyond a block its pixels still count
    lo_c, hi_c = F.floor((F.col("x0") - F.col("dx") / 2 - grid.x0) / (grid.dx * grid.side)), F.floor((F.col("x0") + (F.col("columns") + 0.5) * F.col("dx") - grid.x0) / (grid.dx * grid.side))
    lo_r, hi_r = F.floor((grid.top - F.col("top") - F.col("dy") / 2) / (grid.dy * grid.side)), F.floor((grid.top - F.col("top") + (F.col("rows") + 0.5) * F.col("dy")) / (grid.dy * grid.side))
    within = lambda lo, hi, n: F.filter(F.sequence(F.greatest(lo, F.lit(0)).cast("long"), F.least(hi, F.lit(n)).cast("long")), lambda t: (t < n) & (t >= lo) & (t <= hi))
    sent = parts.withColumn("tr", F.explode(within(lo_r, hi_r, grid.tile_rows))).withColumn("tc", F.explode(within(lo_c, hi_c, grid.tile_columns)))

    def interpolate(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tr, tc = key[0].as_py(), key[1].as_py()
        (r0, r1), (c0, c1) = grid.span(tr, "r"), grid.span(tc, "c")
        y, x = grid.top - (np.arange(r0, r1) + 0.5) * grid.dy, grid.x0 + (np.arange(c0, c1) + 0.5) * grid.dx
        total, weight, held = np.zeros((3, len(y), len(x)))
        for b in batches:
            place = [_column(b, k).to_numpy() for k in ("x0", "top", "dx", "dy", "rows", "columns")]
            for v, (px, py, dx, dy, n, m) in zip(arrays(_column(b, "values")), zip(*place, strict=True), strict=True):
                v = v.reshape(int(n), int(m))
                row, column = (py - y) / dy, (x - px) / dx  # in pixels of the block, from its corner
                held += np.outer((row >= 0) & (row < n), (column >= 0) & (column < m))
                known = np.where(np.isnan(v), 0.0, v)
                for i, wr in _neighbours(row - 0.5, int(n)):
                    for j, wc in _neighbours(column - 0.5, int(m)):
                        at, w = np.ix_(i, j), np.outer(wr, wc)
                        total += w * known[at]
                        weight += w * ~np.isnan(v[at])
        with np.errstate(invalid="ignore", divide="ignore"):
            out = np.where((weight > 0) & (held > 0), total / weight, np.nan)
        batch = _one((tr, tc), values=out)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([key[2].as_py()], pa.int32()), pa.array([key[3].as_py()], pa.string())], names=["tr", "tc", "values", "priority", "source"])

    def first(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tile = key[0].as_py(), key[1].as_py()
        size = grid.size(*tile)
        out, of, names = np.full(size, np.nan), np.full(size, -1), []
        for b in batches:
            for v, rank in zip(arrays(_column(b, "values")), zip(_column(b, "priority").to_pylist(), _column(b, "source").to_pylist(), strict=True), strict=True):
                names.append(rank)
                v = v.reshape(size)
                before = np.array([True, *(rank < other for other in names)])  # at -1 there is none yet
                better = ~np.isnan(v) & before[of + 1]
                out[better], of[better] = v[better], len(names) - 1
        yield _one(tile, values=out)

    each = sent.groupBy("tr", "tc", "priority", "source").applyInArrow(interpolate, "tr long, tc long, values array<double>, priority int, source string")
    return each.groupBy("tr", "tc").applyInArrow(first, "tr long, tc long, values array<double>")


def _neighbours(at: np.ndarray, n: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For places between pixel centres: the pixels before and behind, and their weights, 0 beyond the block."""
    low = np.floor(at).astype(np.int64)
    part = at - low
    for i, w in ((low, 1 - part), (low + 1, part)):
        yield np.clip(i, 0, n - 1), np.where((i >= 0) & (i < n), w, 0.0)


def place_of(blocks_: DataFrame) -> tuple[float, float, float, float] | None:
    """The box (x0, y0, x1, y1) that blocks cover."""
    low = blocks_.agg(F.min("x0"), F.min(F.col("top") - F.col("rows") * F.col("dy")), F.max(F.col("x0") + F.col("columns") * F.col("dx")), F.max("top")).first()
    return None if low[0] is None else tuple(map(float, low))
