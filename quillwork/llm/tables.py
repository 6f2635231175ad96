"""Reading the tables of a folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillwork.plans.spread import spread
from quillwork.plans.streams import read


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table by name; those of long texts are dealt over all cores if they have few files."""
    df = read(spark, sf_dir, name)
    return spread(df) if name in ("documents", "pages") else df
