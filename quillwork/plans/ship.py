"""Giving the package to Python workers that can't import it."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parent.parent
_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Once an application: sends the package's sources to all executors, through Spark's own file server.

    Not needed, and not done, where PYTHONPATH names the folder that holds the package.
    """
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    _shipped.add(context.applicationId)
    if str(ROOT.parent) in map(os.path.realpath, filter(None, os.environ.get("PYTHONPATH", "").split(os.pathsep))):
        return
    archive = Path(tempfile.mkdtemp(prefix=f"{ROOT.name}-")) / f"{ROOT.name}.zip"
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as out:
        for source in sorted(ROOT.rglob("*.py")):
            out.write(source, source.relative_to(ROOT.parent))
    context.addPyFile(str(archive))
