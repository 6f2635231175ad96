"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillwork.plans.materialize import discard, materialize


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for the nodes that aren't their component's smallest node, from edges (a, b).

    Each step halves distances about; edges stay distributed and are written to the
    shared folder after each step.  Ends when a step changes nothing.
    """
    hi, lo = F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")
    links = materialize(edges.filter("a <> b").select(hi, lo).distinct(), "links")
    state = None
    while True:
        now = links.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first()
        if now == state or not now[0]:
            out = links.select(F.col("hi").alias("node"), F.col("lo").alias("component"))
            out._written = links._written
            return out
        state = now
        both = links.select(F.col("hi").alias("x"), F.col("lo").alias("y")).union(links.select("lo", "hi"))
        least = both.groupBy("x").agg(F.least(F.min("y"), F.first("x")).alias("m"))
        large = both.join(least, "x").filter("y > x").select(F.col("y").alias("hi"), F.col("m").alias("lo"))
        large = large.filter("hi <> lo").distinct()
        root = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = large.join(root, "hi").select(F.explode(F.array(F.struct(F.col("lo").alias("hi"), F.col("m").alias("lo")), F.struct("hi", F.col("m").alias("lo")))).alias("e"))
        before, links = links, materialize(small.select("e.hi", "e.lo").filter("hi <> lo").distinct(), "links")
        discard(before)
