"""Vectorised word work on Arrow string columns, for Arrow-batched functions.

A column's bytes are handled as one array.  Words are runs of bytes other than
ASCII white space, which is what the pattern ``[^\\x20\\x09-\\x0D]+`` matches in
UTF-8, and A-Z may be lowered.  A word's hash is a polynomial over 64-bit random
byte values, finished by an avalanche step; two different words collide with a
probability of about 2^-64.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

BLOCK = 1 << 20
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)

SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True


def _byte_values(lower: bool) -> np.ndarray:
    values = np.random.Generator(np.random.PCG64(20240601)).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    if lower:
        values[65:91] = values[97:123]
    return values


VALUES = {True: _byte_values(True), False: _byte_values(False)}
_powers: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """B^i and B^-i modulo 2^64 for i < n at least."""
    if len(_powers.get("up", ())) < n:
        size = max(n, BLOCK + 1)
        for name, base in (("up", _BASE), ("down", _INVERSE)):
            out = np.full(size, base, np.uint64)
            out[0] = 1
            _powers[name] = np.cumprod(out, dtype=np.uint64)
    return _powers["up"], _powers["down"]


def mix64(x: np.ndarray) -> np.ndarray:
    """The finisher of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def batch_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column, and where each row starts, with the end; null rows are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()) if pa.types.is_binary(column.type) else column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_large_binary(column.type) else "")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, ends, data = column.buffers()
    offsets = np.frombuffer(ends, np.int64)[column.offset : column.offset + len(column) + 1]
    bytes_ = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return bytes_[offsets[0] : offsets[-1]], offsets - offsets[0]


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, row) of each word."""
    n = len(data)
    if not n:
        none = np.zeros(0, np.int64)
        return none, none, none
    inside = ~SPACE[data]
    before = np.empty(n, bool)
    before[0], before[1:] = False, inside[:-1]
    rows = offsets[:-1]
    before[rows[rows < n]] = False
    after = np.empty(n, bool)
    after[-1], after[:-1] = False, inside[1:]
    last = offsets[1:] - 1
    after[last[last >= 0]] = False
    starts = np.flatnonzero(inside & ~before)
    ends = np.flatnonzero(inside & ~after) + 1
    counts = np.diff(np.searchsorted(starts, offsets))
    return starts, ends, np.repeat(np.arange(len(counts)), counts)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = True) -> np.ndarray:
    """Hashes of the bytes in each span; spans are ordered and don't overlap."""
    out = np.empty(len(starts), np.uint64)
    values = VALUES[lower]
    i = 0
    while i < len(starts):
        begin = starts[i]
        j = max(i + 1, int(np.searchsorted(ends, begin + BLOCK, side="right")))
        stop = ends[j - 1]
        up, down = powers(int(stop - begin) + 1)
        sums = np.empty(stop - begin + 1, np.uint64)
        sums[0] = 0
        np.cumsum(values[data[begin:stop]] * up[: stop - begin], dtype=np.uint64, out=sums[1:])
        a, b = starts[i:j] - begin, ends[i:j] - begin
        out[i:j] = mix64((sums[b] - sums[a]) * down[a] ^ (b - a).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
        i = j
    return out


def append_columns(df: DataFrame, fields: list[T.StructField], values: Callable[[pa.RecordBatch], list], input_columns: list[str] | None = None) -> DataFrame:
    """df (or its input_columns) with columns that values computes from each Arrow batch."""
    base = df.drop(*[f.name for f in fields])
    base = base.select(*input_columns) if input_columns else base
    schema = T.StructType([*base.schema.fields, *fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            new = values(batch)
            yield pa.RecordBatch.from_arrays([*batch.columns, *map(pa.array, new)], names=[*batch.schema.names, *[f.name for f in fields]])

    return base.mapInArrow(run, schema)


def pieces(batch: pa.RecordBatch, column: str, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """batch in slices whose column has at most `most` bytes each, or a single row."""
    lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(lengths, dtype=np.int64)
    i = 0
    while i < len(ends):
        base = ends[i - 1] if i else 0
        j = max(i + 1, int(np.searchsorted(ends, base + most, side="right")))
        yield batch.slice(i, j - i)
        i = j
