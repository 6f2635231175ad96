"""Arrow batches bounded by bytes, for Python stages over long texts."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession

SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"


@contextmanager
def bounded_batches(spark: SparkSession, max_bytes: int) -> Iterator[None]:
    """What runs inside hands Python batches of about max_bytes at most, instead of so many rows of any length."""
    before = spark.conf.get(SETTING, None)
    spark.conf.set(SETTING, str(max_bytes))
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(SETTING)
        else:
            spark.conf.set(SETTING, before)
