"""Running sums and row numbers that no single task computes for a whole group.

Rows carry a group and a bucket number; buckets of a group are ordered, and rows
are ordered inside a bucket.  One aggregation gives the totals by bucket, a
window over those few totals gives each bucket's offset, and a second window,
partitioned by group and bucket, finishes inside the bucket.  A group with a
third of all rows is spread over as many tasks as it has buckets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def bucket_of(unit: Column, rows: Column, rows_per_bucket: int) -> Column:
    """Bucket for a uniform value in [0, 1): as many buckets as the group's rows ask for."""
    return F.floor(unit * F.ceil(rows / F.lit(float(rows_per_bucket))))


def running(
    df: DataFrame,
    groups: list[str],
    bucket: str,
    order: list[Column],
    value: Column,
    out: str,
    inclusive: bool = False,
) -> DataFrame:
    """Adds out: the sum of value over the group's earlier rows (and this one, if inclusive).

    Groups and bucket may be null; nulls are one group.  Ties of order that differ
    in nothing else get their sums in some order.
    """
    df = df.withColumn("_v", value.cast("long"))
    totals = df.groupBy(*groups, bucket).agg(F.sum("_v").alias("_t"))
    before = Window.partitionBy(*groups).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        *[F.col(g).alias(f"_g{i}") for i, g in enumerate(groups)],
        F.col(bucket).alias("_b"),
        F.coalesce(F.sum("_t").over(before), F.lit(0)).alias("_off"),
    )
    inside = Window.partitionBy(*groups, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    summed = df.withColumn("_in", F.sum("_v").over(inside))
    on = F.col(bucket).eqNullSafe(F.col("_b"))
    for i, g in enumerate(groups):
        on = on & F.col(g).eqNullSafe(F.col(f"_g{i}"))
    base = F.col("_off") + F.col("_in") - (F.lit(0) if inclusive else F.col("_v"))
    return summed.join(offsets, on).withColumn(out, base).drop("_v", "_in", "_off", "_b", *[f"_g{i}" for i in range(len(groups))])
