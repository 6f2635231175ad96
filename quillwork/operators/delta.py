"""Delta frames: differences of consecutive ids, zigzag-coded, on the base of the last non-empty frame.

A frame carries its base, so frames decode independently and a lost frame doesn't
disturb the others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillwork.functions.wire import unzigzag, zigzag


def bases(frames: DataFrame) -> DataFrame:
    """frames with base_id: the last id of the previous non-empty frame of the stream, 0 at its start."""
    before = Window.partitionBy("stream_id").orderBy("frame_seq").rowsBetween(Window.unboundedPreceding, -1)
    last = F.last(F.when(F.size("ids") > 0, F.element_at("ids", -1)), ignorenulls=True).over(before)
    return frames.withColumn("base_id", F.coalesce(last, F.lit(0)).cast("long"))


def deltas(ids: Column, base: Column) -> Column:
    """Zigzag-coded differences; the first is against the base."""
    n = F.size(ids)
    before = F.slice(F.concat(F.array(base.cast("long")), ids), F.lit(1), n)
    return F.transform(F.zip_with(ids, before, lambda a, b: a - b), zigzag)


def undelta(coded: Column, base: Column) -> Column:
    """Ids from zigzag-coded differences, by a running sum."""
    start = F.struct(base.cast("long").alias("at"), F.array().cast("array<bigint>").alias("ids"))

    def step(s: Column, z: Column) -> Column:
        at = s["at"] + unzigzag(z)
        return F.struct(at.alias("at"), F.concat(s["ids"], F.array(at)).alias("ids"))

    return F.aggregate(coded, start, step)["ids"]


def encode(frames: DataFrame) -> DataFrame:
    """frames with base_id and ids_delta."""
    based = bases(frames)
    return based.withColumn("ids_delta", deltas(F.col("ids"), F.col("base_id")))


def decode(coded: DataFrame) -> DataFrame:
    """coded(base_id, ids_delta, ...) with ids."""
    return coded.withColumn("ids", undelta(F.col("ids_delta"), F.col("base_id")))


def encode_tokens(tokens: DataFrame) -> DataFrame:
    """tokens(stream_id, pos, id) with delta, zigzag-coded against the previous id of the stream."""
    before = Window.partitionBy("stream_id").orderBy("pos", "id")
    return tokens.withColumn("delta", zigzag(F.col("id") - F.coalesce(F.lag("id").over(before), F.lit(0))))


def decode_tokens(coded: DataFrame) -> DataFrame:
    """coded(stream_id, pos, id, delta) with decoded, the running sum of differences."""
    upto = Window.partitionBy("stream_id").orderBy("pos", "id").rowsBetween(Window.unboundedPreceding, 0)
    return coded.withColumn("decoded", F.sum(unzigzag(F.col("delta"))).over(upto))
