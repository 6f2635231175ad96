"""Cutting lineage through the shared folder, and broadcasts behind a size check.

Executors can be lost at any time, so intermediate results that several later
jobs read are written as Parquet below the folder that the session names in
``spark.checkpoint.dir``.  Only where that setting is absent and Spark runs
in one process (unit tests, a laptop) a folder of our own is used; a cluster has to name one.
"""

from __future__ import annotations

import ctypes
import gc
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillwork.plans.ship import ship

#: Used only where the session names no shared folder.
LOCAL_SHARED = "/tmp/checkpoints/quillwork"

#: Paths of tables made inside scratch(), innermost last.
_scopes: list[list[str]] = []

#: Rows up to which a side counts as small; callers keep such rows narrow.
BROADCAST_ROWS = 1_000_000


def shared_dir(spark: SparkSession) -> str:
    """The shared folder of this application, without a trailing slash."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = LOCAL_SHARED
    return f"{base.rstrip('/')}/quillwork-{spark.sparkContext.applicationId}"


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder, removed when the driver's JVM ends."""
    ship(spark)
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(jpath)
    return path


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: later jobs start from there."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written = path
    if _scopes:
        _scopes[-1].append(path)
    return out


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Removes at its end what was materialized inside, but for the tables handed to the function it yields."""
    paths: list[str] = []

    def keep(df: DataFrame) -> DataFrame:
        paths.remove(df._written)
        return df

    _scopes.append(paths)
    try:
        yield keep
    finally:
        _scopes.remove(paths)
        for path in paths:
            drop_path(spark, path)


def discard(df: DataFrame) -> None:
    """Remove what materialize() wrote for df, once nothing reads it any more."""
    drop_path(df.sparkSession, df._written)


def release(spark: SparkSession) -> None:
    """Let Spark remove shuffle files of finished steps, which it does when the driver collects garbage, and trim the driver."""
    gc.collect()
    spark._jvm.System.gc()
    trim(spark)


def trim(spark: SparkSession) -> bool:
    """Give memory that the driver's Python and JVM have freed back to the system; their C library keeps such pages otherwise.

    Whether the JVM has a command for that.
    """
    library = ctypes.CDLL(None)
    if hasattr(library, "malloc_trim"):
        library.malloc_trim(0)
    jvm = spark._jvm
    call = spark.sparkContext._gateway.new_array(jvm.java.lang.Object, 4)  # two nulls at the end: no arguments
    call[0], call[1] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
    server = jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer()
    invoke = next(m for m in jvm.java.lang.Class.forName("javax.management.MBeanServer").getMethods() if m.getName() == "invoke")
    try:
        invoke.invoke(server, call)
    except Py4JJavaError:
        return False
    return True


def drop_path(spark: SparkSession, path: str) -> None:
    """Remove a materialized table that nothing reads any more."""
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jpath, True)


def small_enough(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> bool:
    """Whether df has at most max_rows rows; reads no more than that many and one."""
    return df.limit(max_rows + 1).count() <= max_rows


def broadcast_if_small(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if its counted rows allow it, else df as it is (a shuffle join)."""
    return F.broadcast(df) if small_enough(df, max_rows) else df
