"""Equal rows: telling rows apart by what they hold, and working on counts of equal rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Copies that one step of expanded() makes of a row.
STRIDE = 4096


def identity(df: DataFrame) -> list[Column]:
    """Two 64-bit hashes over all columns of df, named _k1 and _k2; rows that hold the same have the same."""
    fields = [F.map_entries(f.name) if isinstance(f.dataType, T.MapType) else F.col(f.name) for f in df.schema.fields]
    # A hash skips nulls, so their places are hashed as well.
    nulls = F.concat(*[F.when(F.col(c).isNull(), "0").otherwise("1") for c in df.columns])
    return [F.xxhash64(F.lit(seed), nulls, *fields).alias(f"_k{seed}") for seed in (1, 2)]


def expanded(df: DataFrame, copies: Column, out: str) -> DataFrame:
    """Each row `copies` times (at least once), numbered from 0 by column out; no array exceeds STRIDE entries by much."""
    last = copies.cast("long") - 1
    strides = F.sequence(F.lit(0).cast("long"), F.floor(last / STRIDE).cast("long"))
    cut = df.withColumn("_last", last).withColumn("_stride", F.explode(strides))
    begin = F.col("_stride") * STRIDE
    return cut.withColumn(out, F.explode(F.sequence(begin, F.least("_last", begin + (STRIDE - 1))))).drop("_last", "_stride")
