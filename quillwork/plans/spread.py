"""Using all cores on tables of few files."""

from __future__ import annotations

from pyspark.sql import DataFrame


def spread(df: DataFrame) -> DataFrame:
    """df dealt over all cores if it has fewer files than there are cores, else as it is.

    A file of one row group is read by one task, however long its rows take.  Tables
    with files enough, as all large ones, are not shuffled.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if len(df._jdf.inputFiles()) >= cores else df.repartition(cores)
