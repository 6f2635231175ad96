"""Tensor streams: scales, symmetric quantization, packing, keyframe deltas, fp16.

A tensor is an array of floats, channels first.  Single precision is kept by a
cast after each step, as Spark divides in double precision.
"""

from __future__ import annotations

import struct

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

PIPELINES = ("raw", "int8", "int4", "int8-adaptive", "int4-adaptive", "delta+int8", "delta+int4")


def half(x: Column) -> Column:
    """The nearest half-precision value, ties to even; beyond its range infinite."""
    m = F.abs(x.cast("double"))
    step = F.when(m < 2.0**-14, 2.0**-24).otherwise(F.pow(F.lit(2.0), F.floor(F.log2(F.when(m > 0, m).otherwise(1.0))) - 10))
    value = F.rint(m / step) * step
    value = F.when(value >= 65520, float("inf")).otherwise(value)
    return F.when(x < 0, -value).otherwise(value).cast("float")


def channels(x: Column, n: int) -> Column:
    """An array of n channels of equal length."""
    size = F.floor(F.size(x) / n).cast("int")
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda c: F.slice(x, c * size + 1, size))


def scales(x: Column, n: int) -> Column:
    """Largest magnitude of each channel, as half precision."""
    return F.transform(channels(x, n), lambda c: half(F.array_max(F.transform(c, F.abs))))


def quantize(x: Column, s: Column, top: int, n: int) -> Column:
    """round(x / scale * top), ties to even, within -top and top; 0 for a scale of 0."""

    def one(v: Column, scale: Column) -> Column:
        q = F.rint(((v / scale).cast("float") * top).cast("float"))
        return F.when(scale == 0, 0).otherwise(F.greatest(F.lit(-top), F.least(F.lit(top), q))).cast("int")

    per = F.zip_with(channels(x, n), s, lambda c, scale: F.transform(c, lambda v: one(v, scale)))
    return F.flatten(per)


def dequantize(q: Column, s: Column, top: int, n: int) -> Column:
    return F.flatten(F.zip_with(channels(q, n), s, lambda c, scale: F.transform(c, lambda v: ((v.cast("float") * scale).cast("float") / top).cast("float"))))


def pack4(q: Column) -> Column:
    """Hexadecimal text of values in [-8, 7], low nibble first; an odd end is padded with 0."""
    pairs = F.sequence(F.lit(0), F.ceil(F.size(q) / 2).cast("int") - 1)

    def nibble(v: Column) -> Column:
        return F.hex(F.pmod(F.coalesce(v, F.lit(0)).cast("long"), F.lit(16)))

    return F.when(F.size(q) == 0, "").otherwise(F.array_join(F.transform(pairs, lambda k: F.concat(nibble(F.get(q, k * 2 + 1)), nibble(F.get(q, k * 2)))), ""))


def unpack4(packed: Column, n: Column) -> Column:
    """n values from pack4's text; null if the length doesn't fit."""

    def value(k: Column) -> Column:
        at = F.floor(k / 2) * 2 + F.when(k % 2 == 0, 2).otherwise(1)
        v = F.conv(F.substring(packed, at.cast("int"), F.lit(1)), 16, 10).cast("int")
        return F.when(v > 7, v - 16).otherwise(v)

    none = F.array().cast("array<int>")
    return F.when(F.length(packed) == F.ceil(n / 2) * 2, F.when(n == 0, none).otherwise(F.transform(F.sequence(F.lit(0), n - 1), value)))


def saturating(a: Column, b: Column, top: int, sign: int = -1) -> Column:
    return F.zip_with(a, b, lambda x, y: F.greatest(F.lit(-top), F.least(F.lit(top), x + sign * y)))


def delta_encode(frames: DataFrame, top: int, n: int) -> DataFrame:
    """frames(stream, seq, x, keyframe) with scales, q and data: q of keyframes, else the residual against the last keyframe on its scales."""
    before = Window.partitionBy("stream").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    own = frames.withColumn("_s", F.when(F.col("keyframe"), scales(F.col("x"), n)))
    own = own.withColumn("_k", F.when(F.col("keyframe"), F.struct(F.col("_s").alias("s"), quantize(F.col("x"), F.col("_s"), top, n).alias("q"))))
    held = own.withColumn("_last", F.last("_k", ignorenulls=True).over(before))
    q = quantize(F.col("x"), F.col("_last.s"), top, n)
    data = F.when(F.col("keyframe"), q).otherwise(saturating(q, F.col("_last.q"), top))
    return held.withColumns({"scales": F.col("_last.s"), "q": q, "data": data}).drop("_s", "_k", "_last")


def delta_decode(coded: DataFrame, top: int, n: int) -> DataFrame:
    """coded(stream, seq, keyframe, scales, data) with q and y, the decoded tensor."""
    before = Window.partitionBy("stream").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    held = coded.withColumn("_key", F.last(F.when(F.col("keyframe"), F.col("data")), ignorenulls=True).over(before))
    q = F.when(F.col("keyframe"), F.col("data")).otherwise(saturating(F.col("data"), F.col("_key"), top, 1))
    return held.withColumn("q", q).withColumn("y", dequantize(F.col("q"), F.col("scales"), top, n)).drop("_key")


def check_frames(frames: DataFrame, size: int, delta: bool) -> DataFrame:
    """frames(stream, seq, x, keyframe) with error: sequence, shape or a delta stream that doesn't start with a keyframe."""
    order = Window.partitionBy("stream").orderBy("seq")
    previous = F.lag("seq").over(order)
    error = F.when(previous.isNotNull() & (F.col("seq") <= previous), "seq").when(F.size("x") != size, "shape")
    if delta:
        error = F.when(previous.isNull() & ~F.col("keyframe"), "first frame must be a keyframe").otherwise(error)
    return frames.withColumn("error", error)


def rejections(requests: DataFrame, offered: DataFrame) -> DataFrame:
    """requests(space_id, media, pipeline, has_scales) with reason, null if offered(space_id, pipeline) allows it."""
    known = offered.select("space_id", "pipeline").distinct().withColumn("_ok", F.lit(True))
    joined = requests.join(known, ["space_id", "pipeline"], "left")
    reason = (
        F.when(~F.col("pipeline").isin(*PIPELINES), "unknown pipeline").when(F.col("_ok").isNull(), "not offered")
        .when((F.col("media") == "image") & F.col("pipeline").startswith("delta"), "delta needs a stream of frames")
        .when(F.col("pipeline").isin("int8", "int4") & ~F.col("has_scales"), "static scales are missing")
    )
    return joined.withColumn("reason", reason).drop("_ok")


def typed_bytes(x: Column, dtype: str) -> Column:
    """Little-endian bytes of a tensor: fp32, fp16, bf16 (as half, by convention), int8."""
    kind = {"fp32": "<f4", "fp16": "<f2", "bf16": "<f2", "int8": "i1"}[dtype]

    def run(values: pd.Series) -> pd.Series:
        return values.map(lambda v: np.asarray(v, dtype=np.float32).astype(kind).tobytes())

    return F.pandas_udf(run, T.BinaryType())(x)


def from_bytes(data: Column, dtype: str) -> Column:
    kind = {"fp32": "<f4", "fp16": "<f2", "bf16": "<f2", "int8": "i1"}[dtype]

    def run(values: pd.Series) -> pd.Series:
        return values.map(lambda b: np.frombuffer(bytes(b), kind).astype(np.float32).tolist())

    return F.pandas_udf(run, T.ArrayType(T.FloatType()))(data)


def frame_msgpack(data: Column, seq: Column, keyframe: Column, done: Column, reason: Column) -> Column:
    """A latent frame as msgpack: data, seq, keyframe, done and finish_reason if there is one; in hexadecimal."""
    from quillwork.functions import wire

    n = F.octet_length(data)
    head = F.when(n < 256, F.concat(F.lit("C4"), wire.hex_byte(n))).when(n < 65536, F.concat(F.lit("C5"), wire.hex_wide(n, 4))).otherwise(F.concat(F.lit("C6"), wire.hex_wide(n, 8)))
    flag = lambda c: F.when(c, "C3").otherwise("C2")
    name = lambda s: wire.msgpack_str_hex(F.lit(s))
    return F.concat(
        wire.hex_byte(F.when(reason.isNull(), 4).otherwise(5) + 0x80), name("data"), head, F.hex(data), name("seq"), wire.msgpack_uint_hex(seq),
        name("keyframe"), flag(keyframe), name("done"), flag(done), F.when(reason.isNull(), "").otherwise(F.concat(name("finish_reason"), wire.msgpack_str_hex(reason))),
    )


def scales_bytes(s: list[float]) -> bytes:
    return struct.pack(f"<{len(s)}e", *s)


def activations(tokens: DataFrame, width: int) -> DataFrame:
    """(stream, seq, token_count, error, values): token-major activations from tokens(stream, seq, token, values)."""
    grouped = tokens.groupBy("stream", "seq").agg(F.array_sort(F.collect_list(F.struct("token", "values"))).alias("t"))
    flat = grouped.select("stream", "seq", F.size("t").alias("token_count"), F.flatten(F.transform("t", lambda x: x["values"])).alias("values"))
    return flat.withColumn("error", F.when(F.size("values") != F.col("token_count") * width, "length"))
