"""Streams of frames in files: decoding msgpack and protobuf, and a data source for both.

A stream ends with its first frame that is done.  A msgpack stream that ends inside
a frame ends silently, and the bytes left over are reported; a protobuf stream
that does raises.  Nested values are skipped to a depth of 64 at most.
"""

from __future__ import annotations

import glob
import os
import re
import struct
from collections.abc import Iterator
from dataclasses import dataclass
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

MAX_DEPTH = 64
SCHEMA = "stream string, frame_seq bigint, ids array<bigint>, done boolean, finish_reason string, trailing_bytes bigint"


class Incomplete(Exception):
    """More bytes are needed."""


@dataclass
class Frame:
    ids: list[int]
    done: bool = False
    finish_reason: str | None = None


def _need(data: bytes, at: int, n: int) -> None:
    if at + n > len(data):
        raise Incomplete


_FIXED = {0xCC: ">B", 0xCD: ">H", 0xCE: ">I", 0xCF: ">Q", 0xD0: ">b", 0xD1: ">h", 0xD2: ">i", 0xD3: ">q", 0xCA: ">f", 0xCB: ">d"}
_SIZED = {0xD9: (">B", "str"), 0xDA: (">H", "str"), 0xDB: (">I", "str"), 0xC4: (">B", "bin"), 0xC5: (">H", "bin"), 0xC6: (">I", "bin"), 0xDC: (">H", "array"), 0xDD: (">I", "array"), 0xDE: (">H", "map"), 0xDF: (">I", "map")}


def msgpack_value(data: bytes, at: int, depth: int = 0) -> tuple[Any, int]:
    """(value, position after it)."""
    if depth > MAX_DEPTH:
        raise ValueError("msgpack value is nested too deeply")
    _need(data, at, 1)
    b = data[at]
    at += 1
    if b < 0x80:
        return b, at
    if b >= 0xE0:
        return b - 256, at
    if b in (0xC0, 0xC2, 0xC3):
        return {0xC0: None, 0xC2: False, 0xC3: True}[b], at
    if b in _FIXED:
        n = struct.calcsize(_FIXED[b])
        _need(data, at, n)
        return struct.unpack_from(_FIXED[b], data, at)[0], at + n
    if b < 0x90:
        what, n = "map", b & 15
    elif b < 0xA0:
        what, n = "array", b & 15
    elif b < 0xC0:
        what, n = "str", b & 31
    elif b in _SIZED:
        size, what = _SIZED[b]
        _need(data, at, struct.calcsize(size))
        n = struct.unpack_from(size, data, at)[0]
        at += struct.calcsize(size)
    else:
        raise ValueError(f"msgpack type {b:#x} isn't supported")
    if what in ("str", "bin"):
        _need(data, at, n)
        raw = data[at : at + n]
        return (raw.decode() if what == "str" else raw), at + n
    out: list = []
    for _ in range(n if what == "array" else 2 * n):
        value, at = msgpack_value(data, at, depth + 1)
        out.append(value)
    return (out if what == "array" else dict(zip(out[::2], out[1::2], strict=True))), at


def msgpack_frames(data: bytes) -> tuple[list[Frame], int]:
    """(frames up to the one that is done, bytes left over inside a frame)."""
    frames, at = [], 0
    while at < len(data):
        try:
            value, end = msgpack_value(data, at)
        except Incomplete:
            return frames, len(data) - at
        if not isinstance(value, dict):
            raise ValueError("a frame must be a map")
        at = end
        frames.append(Frame([int(i) for i in value.get("ids") or []], bool(value.get("done")), value.get("finish_reason")))
        if frames[-1].done:
            break
    return frames, 0


#: A base-128 number: bytes with the high bit, then one without; ten bytes hold 64 bits.
VARINT = re.compile(rb"[\x80-\xFF]{0,9}[\x00-\x7F]")
#: Bytes of the wire types of fixed width.
WIDTHS = {1: 8, 5: 4}


def numbers(data: bytes) -> list[int]:
    """All base-128 numbers of packed data."""
    found = VARINT.findall(data)
    if sum(map(len, found)) != len(data):
        raise ValueError("truncated varint")
    return [sum((b & 127) << 7 * k for k, b in enumerate(raw)) for raw in found]


def fields(data: bytes) -> Iterator[tuple[int, int, Any]]:
    """(number, wire type, value) of each field of a message: a number for type 0, else the field's bytes."""
    at = 0

    def number() -> int:
        nonlocal at
        if not (found := VARINT.match(data, at)):
            raise ValueError("truncated varint")
        at = found.end()
        return numbers(found[0])[0]

    while at < len(data):
        tag = number()
        wire = tag & 7
        if wire == 0:
            yield tag >> 3, wire, number()
            continue
        if wire != 2 and wire not in WIDTHS:
            raise ValueError(f"unknown wire type {wire}")
        size = number() if wire == 2 else WIDTHS[wire]
        if at + size > len(data):
            raise ValueError("truncated field")
        yield tag >> 3, wire, data[at : at + size]
        at += size


def protobuf_frame(data: bytes) -> Frame:
    """One message: 1 packed or single ids, 2 done, 3 finish reason; other fields don't matter."""
    frame = Frame([])
    for known in fields(data):
        match known:
            case (1, 0, value):
                frame.ids.append(value)
            case (1, 2, packed):
                frame.ids += numbers(packed)
            case (2, 0, value):
                frame.done = bool(value)
            case (3, 2, text):
                frame.finish_reason = text.decode()
    return frame


def protobuf_frames(data: bytes) -> tuple[list[Frame], int]:
    frames, at = [], 0
    while at < len(data):
        if at + 4 > len(data) or at + 4 + (size := struct.unpack_from(">I", data, at)[0]) > len(data):
            raise ValueError("protobuf stream ends inside a frame")
        frames.append(protobuf_frame(data[at + 4 : at + 4 + size]))
        at += 4 + size
        if frames[-1].done:
            break
    return frames, 0


def typed_frames(data: bytes) -> list[tuple[int, bytes]]:
    """(type, payload) of frames with a byte of type and four of length; an incomplete one at the end is dropped."""
    out, at = [], 0
    while at + 5 <= len(data):
        kind, size = struct.unpack_from(">BI", data, at)
        if at + 5 + size > len(data):
            break
        out.append((kind, data[at + 5 : at + 5 + size]))
        at += 5 + size
    return out


DECODERS = {"msgpack": msgpack_frames, "protobuf": protobuf_frames}


def rows_of(stream: str, data: bytes, wire: str) -> list[tuple]:
    frames, left = DECODERS[wire](data)
    out = [(stream, k, f.ids, f.done, f.finish_reason, left if k == len(frames) - 1 else 0) for k, f in enumerate(frames)]
    return out or ([(stream, 0, [], False, None, left)] if left else [])


def decode(bodies: DataFrame, wire: str) -> DataFrame:
    """Frames of bodies(stream string, content binary), one stream a row, by any file system that Spark reads."""
    if wire not in DECODERS:
        raise ValueError(f"unknown wire format {wire!r}")
    names = [c.split(" ")[0] for c in SCHEMA.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.string(), pa.int64(), pa.list_(pa.int64()), pa.bool_(), pa.string(), pa.int64()]
        for batch in batches:
            for row in batch.to_pylist():
                if found := rows_of(row["stream"], row["content"], wire):
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found, strict=True), kinds, strict=True)], names=names)

    return bodies.select("stream", "content").mapInArrow(run, SCHEMA)


def read_files(spark: SparkSession, path: str, wire: str) -> DataFrame:
    """Frames of all files below path, one stream a file."""
    files = spark.read.format("binaryFile").load(path)
    return decode(files.select(F.col("path").alias("stream"), "content"), wire)


def count_tokens(bodies: DataFrame, wire: str) -> DataFrame:
    """(stream, n_tokens) of bodies in msgpack, protobuf or lines of server-sent events."""
    if wire == "sse":
        data = F.regexp_extract_all(F.decode("content", "utf-8"), F.lit(r"(?m)^data: (\{.*\})$"), 1)
        sizes = F.transform(data, lambda j: F.size(F.coalesce(F.from_json(j, "ids array<bigint>")["ids"], F.array().cast("array<bigint>"))))
        return bodies.select("stream", F.aggregate(sizes, F.lit(0).cast("long"), lambda a, n: a + n).alias("n_tokens"))
    return decode(bodies, wire).groupBy("stream").agg(F.sum(F.size("ids")).alias("n_tokens"))


class _File(InputPartition):
    def __init__(self, path: str) -> None:
        self.path = path


class _Reader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.paths = sorted(p for p in glob.glob(os.path.join(options["path"], options.get("pattern", "*"))) if os.path.isfile(p))
        self.wire = options.get("wire", "msgpack")

    def partitions(self) -> list[InputPartition]:
        return [_File(p) for p in self.paths]

    def read(self, partition: _File) -> Iterator[tuple]:
        with open(partition.path, "rb") as f:
            yield from rows_of(partition.path, f.read(), self.wire)


class FrameSource(DataSource):
    """spark.read.format("frames").option("wire", "msgpack").load(folder), for folders that all executors mount."""

    @classmethod
    def name(cls) -> str:
        return "frames"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(FrameSource)
