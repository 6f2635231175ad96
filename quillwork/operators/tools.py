"""Tool results with attached token ids, cached fragments and templates.

A result is an array of blocks: struct(type, text, meta), meta being a map from a
key to struct(map_id, ids).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCK = "struct<type:string,text:string,meta:map<string,struct<map_id:string,ids:array<bigint>>>>"
KEY, LEGACY = "token_ids", "_token_meta"


def wrap(content: Column, encoded: Column, map_id: str, min_length: int = 0, key: str = KEY) -> Column:
    """content with ids attached to text blocks; encoded holds each block's ids.

    Short texts and blocks that carry ids of this map already are left alone.
    """

    def one(b: Column, ids: Column) -> Column:
        there = F.coalesce(F.try_element_at(b["meta"], F.lit(key))["map_id"] == map_id, F.lit(False))
        skip = (b["type"] != "text") | b["text"].isNull() | (F.length(b["text"]) < min_length) | there
        added = F.create_map(F.lit(key), F.struct(F.lit(map_id).alias("map_id"), ids.alias("ids")))
        rest = F.map_filter(F.coalesce(b["meta"], F.create_map().cast("map<string,struct<map_id:string,ids:array<bigint>>>")), lambda k, _: k != key)
        return F.when(skip, b).otherwise(F.struct(b["type"].alias("type"), b["text"].alias("text"), F.map_concat(rest, added).alias("meta")))

    return F.zip_with(content, encoded, one)


def ids_of(content: Column, key: str = KEY, legacy: str = LEGACY) -> Column:
    """array<struct<map_id, ids>> for each block: its own, else those of a legacy block right after it."""

    def one(b: Column, i: Column) -> Column:
        after = F.get(content, i + 1)
        sibling = F.when((b["type"] != legacy) & (after["type"] == legacy), F.try_element_at(after["meta"], F.lit(key)))
        return F.coalesce(F.try_element_at(b["meta"], F.lit(key)), sibling)

    return F.transform(content, one)


def mismatches(found: Column, map_id: str) -> Column:
    """Whether any ids belong to another map, which a reader must refuse."""
    return F.exists(found, lambda m: F.coalesce(m["map_id"] != map_id, F.lit(False)))


def strip(content: Column, key: str = KEY, legacy: str = LEGACY) -> Column:
    """content without legacy blocks and without the key; a map that is left empty goes."""

    def one(b: Column) -> Column:
        rest = F.map_filter(b["meta"], lambda k, _: k != key)
        return F.struct(b["type"].alias("type"), b["text"].alias("text"), F.when(F.size(rest) > 0, rest).alias("meta"))

    return F.transform(F.filter(content, lambda b: b["type"] != legacy), one)


SLOT = r"\{([a-zA-Z_][a-zA-Z0-9_]*)\}"


def template_parts(text: Column) -> Column:
    """array<struct<literal, slot>> of a template, one of either being null in each part."""
    slots, literals = F.regexp_extract_all(text, F.lit(SLOT), 1), F.split(text, SLOT, -1)
    part = lambda lit, slot: F.struct(lit.cast("string").alias("literal"), slot.cast("string").alias("slot"))
    both = F.zip_with(literals, slots, lambda lit, s: F.array(part(lit, F.lit(None)), part(F.lit(None), s)))
    return F.filter(F.flatten(both), lambda p: F.coalesce(p["literal"], F.lit("")).cast("string").isNotNull() & ((F.length(p["literal"]) > 0) | p["slot"].isNotNull()))


def render(parts: Column, slots: Column) -> Column:
    """struct(text, missing) of a template's parts with slots filled from a map; missing names the first slot without value."""
    gone = F.filter(parts, lambda p: p["slot"].isNotNull() & F.try_element_at(slots, p["slot"]).isNull())
    filled = F.array_join(F.transform(parts, lambda p: F.coalesce(p["literal"], F.try_element_at(slots, p["slot"]))), "")
    missing = F.get(gone, F.lit(0))["slot"]
    return F.struct(F.when(missing.isNull(), filled).alias("text"), missing.alias("missing"))


def verify_cache(have: Column, want: Column) -> Column:
    return F.lower(have) == F.lower(want)


def bindings(manifests: DataFrame, models: DataFrame) -> DataFrame:
    """models(model_id) with the cache file that manifests(name, models) bind them to."""
    flat = manifests.select("name", F.explode("models").alias("m")).select("name", F.col("m.modelId").alias("model_id"), F.col("m.cacheFile").alias("cache_file"))
    return models.join(flat, "model_id", "left")


def result(kind: str, value: Column) -> Column:
    """Outcome of a tool: its token ids, a text or an error."""
    none = F.lit(None)
    fields = {"tokens": none.cast("array<bigint>"), "text": none.cast("string"), "error": none.cast("string")}
    if kind not in fields:
        raise ValueError(f"unknown kind of result {kind!r}")
    fields[kind] = value
    return F.struct(F.lit(kind).alias("kind"), *[c.alias(n) for n, c in fields.items()])


def turn_stats(turns: DataFrame) -> DataFrame:
    """Sums of an agent loop by conversation, from turns(conv_id, wire_bytes, dispatch_ms, ttfb_ms, total_ms, tool_calls)."""
    return turns.groupBy("conv_id").agg(*[F.sum(c).alias(c) for c in ("wire_bytes", "dispatch_ms", "total_ms", "tool_calls")], F.min("ttfb_ms").alias("ttfb_ms"), F.count("*").alias("n_turns"))
