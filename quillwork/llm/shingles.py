"""Sets of word shingles, as 64-bit hashes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillwork.llm.packed import batch_bytes, mix64, pieces, span_hashes, word_spans

_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63)]


def shingle_sets(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(distinct shingle hashes of each row, sorted, one row after the other; where each row starts, with the end).

    A row with fewer words than width, but some, has its whole sequence as one shingle.
    """
    data, offsets = batch_bytes(column)
    starts, ends, rows = word_spans(data, offsets)
    words = span_hashes(data, starts, ends)
    n_rows = len(offsets) - 1
    first = np.searchsorted(rows, np.arange(n_rows + 1))
    counts = np.diff(first)
    size = np.where(counts >= width, counts - width + 1, np.minimum(counts, 1))
    begin = np.concatenate([[0], np.cumsum(size)])
    # Position in words of each shingle's first word.
    at = np.arange(begin[-1]) - np.repeat(begin[:-1], size) + np.repeat(first[:-1], size)
    span = np.repeat(np.minimum(counts, width), size)
    h = span.astype(np.uint64) * np.uint64(0xFF51AFD7ED558CCD)
    for k in range(width):
        here = span > k
        h[here] = mix64(h[here] * _ODD[0] + words[at[here] + k] * _ODD[k % len(_ODD)] + np.uint64(k))
    out, sizes = [], np.zeros(n_rows, np.int64)
    for i in np.flatnonzero(size):
        u = np.unique(h[begin[i] : begin[i + 1]])
        out.append(u)
        sizes[i] = len(u)
    return (np.concatenate(out) if out else np.zeros(0, np.uint64)), np.concatenate([[0], np.cumsum(sizes)])


def lists(values: np.ndarray, starts: np.ndarray) -> pa.Array:
    """array<long> column from unsigned hashes."""
    return pa.ListArray.from_arrays(pa.array(starts.astype(np.int32)), pa.array(values.view(np.int64)))


def identities(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """A 64-bit identity of each set, whatever its order; 0 for empty ones."""
    out = np.zeros(len(starts) - 1, np.uint64)
    some = np.flatnonzero(np.diff(starts))
    if len(some):
        at = starts[:-1][some]
        total = np.add.reduceat(mix64(values ^ np.uint64(0x2545F4914F6CDD1D)), at)
        parity = np.bitwise_xor.reduceat(mix64(values * np.uint64(0xD1342543DE82EF95) + np.uint64(1)), at)
        out[some] = mix64(total + parity * np.uint64(0x9FB21C651E98DF25))
    return out


def with_sets(docs: DataFrame, width: int, share: float, percent: int) -> DataFrame:
    """(doc_id, key, n, sid, low) for each row of docs(doc_id, key, text).

    n: set size; sid: identity of the set; low: its hashes in the lowest `share` of
    the hash space, and more, by hash, if these are fewer than the prefix that a join
    at `percent` needs.  share 1 keeps the whole set.
    """
    limit = np.uint64(min(int(share * 2**64), 2**64 - 1))

    def run(batches):
        for whole in batches:
            for batch in pieces(whole, "text"):
                values, starts = shingle_sets(batch.column("text"), width)
                n = np.diff(starts)
                below = np.concatenate([[0], np.cumsum(values <= limit)])
                low = np.maximum(below[starts[1:]] - below[starts[:-1]], np.where(n > 0, n - (n * percent + 99) // 100 + 1, 0))
                ends = np.concatenate([[0], np.cumsum(low)])
                picked = values[np.arange(ends[-1]) - np.repeat(ends[:-1], low) + np.repeat(starts[:-1], low)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), batch.column("key"), pa.array(n.astype(np.int32)), pa.array(identities(values, starts).view(np.int64)), lists(picked, ends)],
                    names=["doc_id", "key", "n", "sid", "low"],
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "key", "text").mapInArrow(run, f"doc_id {kind}, key bigint, n int, sid bigint, low array<bigint>")


def row_key():
    return F.xxhash64("doc_id", "text")
