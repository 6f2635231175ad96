"""Delimited regions in streams of token ids.

After a start marker a stream is inside a region, after an end marker outside: a
nested start does not close a region and a stray end opens none.  So a token's
state is the last marker before it.  That last marker, the region's number and the
count of body tokens are running values, computed in two levels: over the frames
of a stream, then inside each frame.  No task holds a whole stream.

Regions longer than the cap are reported once as overflow and never as complete;
what is buffered then stays for a truncated event.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillwork.plans.materialize import materialize
from quillwork.plans.ranks import running

CAP = 65536
KEYS = ["stream_id", "frame_seq"]


def resolve(specials: dict[str, int], start: str, end: str) -> tuple[int, int]:
    """Ids of two named markers; raises if a name is missing or both are one."""
    for name in (start, end):
        if name not in specials:
            raise ValueError(f"marker {name!r} is not among the special tokens")
    if specials[start] == specials[end]:
        raise ValueError("start and end markers have the same id")
    return specials[start], specials[end]


def states(tokens: DataFrame, start: int, end: int) -> DataFrame:
    """tokens with inside, what (open, close, nested, body, pass), region and body_before."""
    mark = F.when(F.col("id") == start, "s").when(F.col("id") == end, "e")
    marked = tokens.withColumn("mark", mark)
    by_frame = marked.groupBy(*KEYS).agg(F.max(F.when(F.col("mark").isNotNull(), F.struct("pos", "mark")))["mark"].alias("last_mark"))
    before = Window.partitionBy("stream_id").orderBy("frame_seq").rowsBetween(Window.unboundedPreceding, -1)
    carried = by_frame.select(*KEYS, F.last("last_mark", ignorenulls=True).over(before).alias("carry"))
    in_frame = Window.partitionBy(*KEYS).orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    seen = marked.join(carried, KEYS).withColumn("inside", F.coalesce(F.coalesce(F.last("mark", ignorenulls=True).over(in_frame), "carry") == "s", F.lit(False)))
    inside = F.col("inside")
    what = (
        F.when(F.col("mark") == "s", F.when(inside, "nested").otherwise("open"))
        .when((F.col("mark") == "e") & inside, "close")
        .otherwise(F.when(inside, "body").otherwise("pass"))
    )
    told = seen.withColumn("what", what).drop("carry", "mark")
    numbered = running(told, ["stream_id"], "frame_seq", [F.col("pos")], (F.col("what") == "open").cast("int"), "region", inclusive=True)
    return running(numbered, ["stream_id"], "frame_seq", [F.col("pos")], (F.col("what") == "body").cast("int"), "body_before")


def ids_in_order(condition=None):
    pair = F.struct("pos", "id")
    return F.transform(F.array_sort(F.collect_list(pair if condition is None else F.when(condition, pair))), lambda x: x["id"])


def watch(tokens: DataFrame, start: int, end: int, cap: int = CAP, ends: DataFrame | None = None) -> DataFrame:
    """(stream_id, at, kind, ids, finish_reason), at being the position at which the event is emitted.

    ends(stream_id, length, finish_reason): the streams that have ended; only those
    can be truncated.
    """
    # Five kinds of events are read from the states, so these are written once.
    t = materialize(states(tokens, start, end).select(*KEYS, "pos", "id", "what", "region", "body_before"), "region-states")
    opens = t.filter("what = 'open'").select("stream_id", "region", F.col("body_before").alias("base"))
    body = t.filter("what = 'body'").join(opens, ["stream_id", "region"]).withColumn("rn", F.col("body_before") - F.col("base") + 1)
    bodies = body.groupBy("stream_id", "region").agg(ids_in_order(F.col("rn") <= cap).alias("ids"), F.count("*").alias("n"))
    none = F.array().cast("array<bigint>")
    regions = opens.select("stream_id", "region").join(bodies, ["stream_id", "region"], "left").withColumns({"ids": F.coalesce("ids", none), "n": F.coalesce("n", F.lit(0))})
    closes = t.filter("what = 'close'").select("stream_id", "region", F.col("pos").alias("at"))
    reason = F.lit(None).cast("string").alias("finish_reason")
    passing = t.filter("what = 'pass'").groupBy("stream_id", "frame_seq", "region").agg(F.min("pos").alias("at"), ids_in_order().alias("ids"))
    parts = [
        passing.select("stream_id", "at", F.lit("passthrough").alias("kind"), "ids", reason),
        regions.filter(F.col("n") <= cap).join(closes, ["stream_id", "region"]).select("stream_id", "at", F.lit("region").alias("kind"), "ids", reason),
        t.filter("what = 'nested'").select("stream_id", F.col("pos").alias("at"), F.lit("nested_start").alias("kind"), F.array("id").alias("ids"), reason),
        body.filter(F.col("rn") == cap + 1).select("stream_id", "region", F.col("pos").alias("at")).join(regions, ["stream_id", "region"]).select("stream_id", "at", F.lit("overflow").alias("kind"), "ids", reason),
    ]
    if ends is not None:
        left = regions.join(closes, ["stream_id", "region"], "left_anti").join(ends, "stream_id")
        parts.append(left.select("stream_id", F.col("length").alias("at"), F.lit("truncated").alias("kind"), "ids", "finish_reason"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def scan_text(text, tag: str = "tool_call"):
    """Bodies of <tag>...</tag> in a text, the baseline that works on text."""
    return F.regexp_extract_all(text, F.lit(f"(?s)<{tag}>(.*?)</{tag}>"), 1)
