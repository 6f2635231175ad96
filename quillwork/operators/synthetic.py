"""Synthetic token streams; ids are hashes of position and seed, so any partitioning gives the same."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillwork.plans.ranks import running

VOCABULARY = 152_064
SHAPES = ("uniform", "cyclic", "low_entropy", "dominant")


def ids(shape: str, pos: Column, seed: int = 42, vocabulary: int = VOCABULARY, period: int = 10, unique: int = 50, dominant: int = 11, share: float = 0.5) -> Column:
    h = F.xxhash64(pos, F.lit(seed))
    if shape == "uniform":
        return F.pmod(h, F.lit(vocabulary))
    if shape == "cyclic":
        return F.pmod(pos, F.lit(period)).cast("long")
    if shape == "low_entropy":
        return F.pmod(h, F.lit(unique))
    if shape == "dominant":
        coin = F.pmod(F.xxhash64(pos, F.lit(seed + 1)), F.lit(1_000_000)) / 1e6
        return F.when(coin < share, F.lit(dominant).cast("long")).otherwise(F.pmod(h, F.lit(vocabulary)))
    raise ValueError(f"unknown shape {shape!r}")


def stream(spark: SparkSession, shape: str, n: int, **how) -> DataFrame:
    """(pos, id) of n tokens."""
    return spark.range(n).select(F.col("id").alias("pos"), ids(shape, F.col("id"), **how).alias("id"))


def bursts(tokens: DataFrame, seed: int = 7, longest: int = 8) -> DataFrame:
    """tokens(pos, id) with frame_seq: frames of one to `longest` tokens as a server flushes them, by hash of position."""
    cut = (F.pmod(F.xxhash64("pos", F.lit(seed)), F.lit(longest)) == 0).cast("long")
    marked = tokens.withColumns({"_cut": cut, "_block": F.floor(F.col("pos") / 65536)})
    return running(marked.withColumn("_g", F.lit(0)), ["_g"], "_block", [F.col("pos")], F.col("_cut"), "frame_seq", inclusive=True).drop("_g", "_block", "_cut")
