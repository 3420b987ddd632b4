"""Vectorised word hashing over Arrow string columns.

A whole column is taken as one byte buffer; words, their hashes, and hashes of word
runs come from array operations, so no Python code runs per word. Batches are cut into
pieces of bounded size, which keeps the memory of a task bounded whatever the batch is.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Bytes of text handled at a time; a longer text makes a piece of its own.
PIECE_BYTES = 1 << 21
#: Words hashed at a time, and those of their bytes that are taken place by place.
AT_ONCE, FIRST_BYTES = 1 << 15, 24

U64 = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def stream(seed: int, n: int) -> np.ndarray:
    """n well spread 64-bit numbers that depend on the seed alone."""
    steps = np.arange(1, n + 1, dtype=U64) * U64(0x9E3779B97F4A7C15)
    return mix(steps + mix(np.array([seed], dtype=U64)))


def _classes(member) -> np.ndarray:
    return np.array([member(b) for b in range(256)], dtype=bool)


#: Bytes of words cut at white space, and of words of letters, digits and anything beyond ASCII.
SPACED = _classes(lambda b: b != 0x20 and not 0x09 <= b <= 0x0D)
ALNUM = _classes(lambda b: b >= 0x80 or 0x30 <= b <= 0x39 or 0x41 <= b <= 0x5A or 0x61 <= b <= 0x7A)

_BYTE = stream(11, 256)
_BYTE[65:91] = _BYTE[97:123]  # A-Z count as a-z
_BASE = U64(0x9DDFEA08EB382D69)
_POWERS = np.ones(1, dtype=U64)


def _powers(n: int) -> np.ndarray:
    global _POWERS
    if len(_POWERS) < n:
        _POWERS = np.concatenate([np.ones(1, dtype=U64), np.cumprod(np.full(2 * n, _BASE, dtype=U64))])
    return _POWERS


@dataclass
class Words:
    """The words of some rows: hash, row, and byte range within buf, in text order. first[r]:first[r+1] are row r's."""

    buf: np.ndarray
    hash: np.ndarray
    row: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray

    @property
    def count(self) -> np.ndarray:
        return np.diff(self.first)

    def text(self, i: int) -> bytes:
        return self.buf[self.start[i] : self.end[i]].tobytes()


def byte_column(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a column of strings or bytes; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) else "")
    column = column.cast(pa.large_binary() if pa.types.is_binary(column.type) else pa.large_string())
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    buf = np.frombuffer(data, dtype=np.uint8)[offsets[0] : offsets[-1]] if data is not None and offsets[-1] > offsets[0] else np.zeros(0, np.uint8)
    return buf, offsets - offsets[0]


def _sums(buf: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Sums of each word's bytes, weighted by their places; first bytes of many words at a time, which stay in the cache, then the rest of long words."""
    out, power = np.empty(len(start), U64), _powers(int(length.max()) + 1)
    for lo in range(0, len(start), AT_ONCE):
        capped = np.minimum(length[lo : lo + AT_ONCE], FIRST_BYTES)
        order = np.argsort(-capped.astype(np.int8), kind="stable")
        at, h = start[lo : lo + AT_ONCE].take(order), np.zeros(len(order), U64)
        for k, n in enumerate(len(order) - np.cumsum(np.bincount(capped))[: capped.max()]):  # words longer than k
            h[:n] += _BYTE.take(buf.take(at[:n] + k)) * power[k]
        out[lo + order] = h
    long = np.flatnonzero(length > FIRST_BYTES)
    if len(long):
        n = length[long] - FIRST_BYTES
        head = np.cumsum(n) - n
        within = np.arange(FIRST_BYTES, FIRST_BYTES + n.sum()) - np.repeat(head, n)
        out[long] += np.add.reduceat(_BYTE[buf[np.repeat(start[long], n) + within]] * power[within], head)
    return out


def hash_words(column: pa.Array, kind: np.ndarray = SPACED) -> Words:
    """Hashes of the words of every row, A-Z taken as a-z."""
    buf, offsets = byte_column(column)
    rows = len(offsets) - 1
    inside = kind[buf]
    before = np.empty_like(inside)
    after = np.empty_like(inside)
    if len(buf):
        before[0], after[-1] = False, False
        before[1:], after[:-1] = inside[:-1], inside[1:]
        cuts = offsets[(offsets > 0) & (offsets < len(buf))]
        before[cuts], after[cuts - 1] = False, False
    start = np.flatnonzero(inside & ~before)
    end = np.flatnonzero(inside & ~after) + 1
    first = np.searchsorted(start, offsets).astype(np.int64)
    length = end - start
    row = np.repeat(np.arange(rows, dtype=np.int32), np.diff(first))
    if not len(start):
        return Words(buf, np.zeros(0, U64), row, start, end, first)
    return Words(buf, mix(_sums(buf, start, length) + length.astype(U64)), row, start, end, first)


def runs(words: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of n words within a row, and the index of each run's first word."""
    h = words.hash
    if len(h) < n:
        return np.zeros(0, U64), np.zeros(0, np.int64)
    last = len(h) - n + 1
    out = np.zeros(last, dtype=U64)
    for i in range(n):
        out = out * _BASE + h[i : i + last]
    at = np.flatnonzero(words.row[:last] == words.row[n - 1 :])
    return mix(out[at] + U64(n)), at


def whole(words: Words, r: int) -> np.uint64:
    """Hash of all words of row r as one run."""
    out = U64(0)
    with np.errstate(over="ignore"):
        for h in words.hash[words.first[r] : words.first[r + 1]]:
            out = out * _BASE + h
        return mix(np.array([out + U64(words.first[r + 1] - words.first[r])], dtype=U64))[0]


def pieces(batch: pa.RecordBatch, column: str, limit: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that no piece of several rows holds more than limit bytes of the column."""
    n = batch.num_rows
    if not n:
        return
    _, offsets = byte_column(batch.column(batch.schema.get_field_index(column)))
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, side="right")) - 1)
        yield batch.slice(lo, hi - lo)
        lo = hi


def column_of(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def as_long(values: np.ndarray) -> np.ndarray:
    """The same 64 bits as a signed number, which is what Spark has."""
    return values.view(np.int64) if values.dtype == U64 else values.astype(np.int64)
