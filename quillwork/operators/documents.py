"""Published documents as JSON rows: validation, pinning by hash, discovery, policies of versions.

A validator is an ordered list of checks; the first that fails gives the error.
Types are those of the parsed value, so numbers in the place of texts are noticed.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

Check = tuple[Column, str]


def kind(value: Column, path: str) -> Column:
    """Type at a path of a variant: STRING, BIGINT, OBJECT<...>, ARRAY<...>; null if absent, VOID for null."""
    return F.schema_of_variant(F.try_variant_get(value, path, "variant"))


def text(value: Column, path: str) -> Column:
    return F.when(kind(value, path) == "STRING", F.try_variant_get(value, path, "string"))


def absent(value: Column, path: str) -> Column:
    return kind(value, path).isNull() | (kind(value, path) == "VOID")


def is_object(value: Column, path: str = "$") -> Column:
    return F.coalesce(kind(value, path).startswith("OBJECT"), F.lit(False))


def is_array(value: Column, path: str) -> Column:
    return F.coalesce(kind(value, path).startswith("ARRAY"), F.lit(False))


def is_text(value: Column, path: str) -> Column:
    return F.coalesce(kind(value, path) == "STRING", F.lit(False))


def is_integer(value: Column, path: str) -> Column:
    return F.coalesce(kind(value, path) == "BIGINT", F.lit(False))


def items(value: Column, path: str) -> Column:
    return F.coalesce(F.try_variant_get(value, path, "array<variant>"), F.array().cast("array<variant>"))


def non_empty(value: Column, path: str) -> Column:
    """Whether an object or array at path holds anything."""
    k = kind(value, path)
    return F.coalesce((k.startswith("OBJECT") & (k != "OBJECT<>")) | (k.startswith("ARRAY") & (F.size(items(value, path)) > 0)), F.lit(False))


def first_error(checks: list[Check]) -> Column:
    """Message of the first check that doesn't hold."""
    out = F.lit(None).cast("string")
    for ok, message in reversed(checks):
        out = F.when(~F.coalesce(ok, F.lit(False)), message).otherwise(out)
    return out


CONVENTIONS = ("tool_call", "python_tag", "mistral", "llama", "qwen", "deepseek", "none")


def map_error(raw: Column, conventions: tuple[str, ...] = CONVENTIONS) -> Column:
    """First fault of a tokenizer map, null if it is valid."""
    v = F.try_parse_json(raw)
    size = F.try_variant_get(v, "$.vocab_size", "long")
    start, end = absent(v, "$.byte_fallback_start"), absent(v, "$.byte_fallback_end")
    tools = ~absent(v, "$.tool_calling")
    specials = F.coalesce(F.map_keys(F.try_variant_get(v, "$.special_tokens", "map<string,variant>")), F.array().cast("array<string>"))
    opens, closes = text(v, "$.tool_calling.markers.start"), text(v, "$.tool_calling.markers.end")
    return first_error(
        [
            (is_object(v), "not an object"),
            (F.length(text(v, "$.id")) > 0, "id must be a non-empty string"),
            (F.length(text(v, "$.version")) > 0, "version must be a non-empty string"),
            (is_integer(v, "$.vocab_size") & (size >= 1), "vocab_size must be a positive integer"),
            ((is_object(v, "$.vocab") & non_empty(v, "$.vocab")) | (is_object(v, "$.tokens") & non_empty(v, "$.tokens")), "one of vocab and tokens is required"),
            (absent(v, "$.encoder") | text(v, "$.encoder").isin("byte_level", "metaspace"), "encoder must be byte_level or metaspace"),
            (absent(v, "$.merges") | is_array(v, "$.merges"), "merges must be a list"),
            (start == end, "byte_fallback_start and byte_fallback_end must both be set or both omitted"),
            (~tools | is_object(v, "$.tool_calling"), "tool_calling must be an object"),
            (~tools | text(v, "$.tool_calling.convention").isin(*conventions), "unknown tool_calling.convention"),
            (~tools | ((F.length(opens) > 0) & (F.length(closes) > 0)), "tool_calling.markers must be an object with non-empty start and end"),
            (~tools | (F.array_contains(specials, opens) & F.array_contains(specials, closes)), "tool_calling.markers must be special tokens"),
        ]
    )


ACTIONS, HOSTS = ("stop", "redact", "regenerate", "flag"), ("server", "client", "both")
ENGINE_FEATURES = ("logits_processor", "hidden_states", "sampling_chain")


def policy_error(raw: Column, category_name: str = "^[a-z][a-z0-9_]*$") -> Column:
    """First fault of a safety policy, null if it is valid."""
    v = F.try_parse_json(raw)
    cats, feats = items(v, "$.categories"), items(v, "$.classifier.requires_engine_features")
    counts = ("banned_token_id_count", "regex_pattern_count", "grammar_constraint_count", "multi_token_pattern_count")
    number = lambda p: absent(v, p) | (is_integer(v, p) & (F.try_variant_get(v, p, "long") >= 0))
    return first_error(
        [
            (is_object(v), "not an object"),
            (F.length(text(v, "$.id")) > 0, "id must be a non-empty string"),
            (is_text(v, "$.version"), "version must be a string"),
            (is_array(v, "$.tokenizers") & non_empty(v, "$.tokenizers"), "tokenizers must be a non-empty array"),
            (F.forall(items(v, "$.tokenizers"), lambda t: is_text(t, "$")), "tokenizers entries must be strings"),
            (is_array(v, "$.categories") & non_empty(v, "$.categories"), "categories must be a non-empty array"),
            (F.forall(cats, lambda c: is_object(c)), "category entry must be an object"),
            (F.forall(cats, lambda c: F.coalesce(text(c, "$.name").rlike(category_name), F.lit(False))), "category.name is malformed"),
            (F.forall(cats, lambda c: F.coalesce(text(c, "$.action").isin(*ACTIONS), F.lit(False))), "category.action must be one of stop|redact|regenerate|flag"),
            (is_object(v, "$.classifier"), "classifier must be an object"),
            (F.length(text(v, "$.classifier.family")) > 0, "classifier.family must be a non-empty string"),
            (absent(v, "$.classifier.host") | text(v, "$.classifier.host").isin(*HOSTS), "classifier.host must be one of server|client|both"),
            (F.forall(feats, lambda f: F.coalesce(text(f, "$").isin(*ENGINE_FEATURES), F.lit(False))), "unknown classifier.requires_engine_features"),
            (absent(v, "$.rules_summary") | is_object(v, "$.rules_summary"), "rules_summary must be an object"),
            *[(number(f"$.rules_summary.{c}"), f"rules_summary.{c} must be a non-negative integer") for c in counts],
            (absent(v, "$.publisher") | is_object(v, "$.publisher"), "publisher must be an object"),
        ]
    )


def manifest_error(raw: Column) -> Column:
    """First fault of a tool manifest, null if it is valid."""
    v = F.try_parse_json(raw)
    models = items(v, "$.models")
    each = lambda name: F.forall(models, lambda m: is_text(m, f"$.{name}"))
    return first_error(
        [
            (is_object(v), "manifest must be an object"),
            (text(v, "$.schema") == "1", "unsupported schema version"),
            (F.length(text(v, "$.name")) > 0, "missing or empty name"),
            (is_text(v, "$.version"), "missing version"),
            (is_text(v, "$.description"), "missing description"),
            (is_object(v, "$.argumentsSchema"), "missing or invalid argumentsSchema"),
            (is_array(v, "$.models") & non_empty(v, "$.models"), "models must be a non-empty array"),
            (each("modelId"), "modelId missing"),
            (each("tokenizerHash"), "tokenizerHash missing"),
            (each("cacheFile"), "cacheFile missing"),
            (F.forall(models, lambda m: text(m, "$.tokenizerHash").rlike("(?i)^[a-f0-9]{64}$")), "tokenizerHash must be SHA-256 hex"),
        ]
    )


def pinned(documents: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted(url, hash) with content and status: ok, missing or mismatch, from documents(url, content)."""
    found = documents.select("url", "content", F.concat(F.lit("sha256:"), F.sha2("content", 256)).alias("_hash"))
    joined = wanted.join(found, "url", "left")
    status = F.when(F.col("_hash").isNull(), "missing").when(F.col("_hash") == F.lower("hash"), "ok").otherwise("mismatch")
    return joined.withColumn("status", status).withColumn("content", F.when(F.col("status") == "ok", F.col("content"))).drop("_hash")


def discover(pointers: DataFrame, documents: DataFrame) -> DataFrame:
    """pointers(id, body) resolved: an inline document stands for itself, a pointer {id, url, hash} leads to documents(url, content)."""
    v = F.try_parse_json(F.col("body"))
    is_pointer = text(v, "$.url").isNotNull() & text(v, "$.hash").isNotNull() & absent(v, "$.vocab") & absent(v, "$.tokens")
    read = pointers.select("id", "body", text(v, "$.id").alias("_said"), F.when(is_pointer, text(v, "$.url")).alias("url"), F.when(is_pointer, text(v, "$.hash")).alias("hash"))
    led = read.join(pinned(documents, read.filter("url is not null").select("url", "hash").distinct()), ["url", "hash"], "left")
    status = F.when(F.col("url").isNull(), F.when(F.col("_said") == F.col("id"), "ok").otherwise("id mismatch")).otherwise(F.col("status"))
    return led.select("id", F.coalesce(F.when(F.col("url").isNull(), F.col("body")), "content").alias("document"), status.alias("status"))


def well_known_url(origin: Column, base: str, folder: str, name: Column, suffix: str = ".json") -> Column:
    """origin/base/folder/name.json; null for names that aren't plain or would climb out of the folder."""
    ok = name.rlike("^[a-z0-9._/-]+$") & ~name.contains("..") & ~name.startswith("/") & ~name.endswith("/")
    return F.when(ok, F.concat(F.regexp_replace(origin, "/$", ""), F.lit(f"/{base.strip('/')}/{folder}/"), name, F.lit(suffix)))


def version_required(status: Column, body: Column, code: str = "version_required") -> Column:
    """struct(required, minimum_version, features, error) of a response; only status 426 demands a version.

    code: the value of the body's error field that marks such a demand.
    """
    v = F.try_parse_json(body)
    feats = items(v, "$.required_features")
    good = (
        is_object(v) & (text(v, "$.error") == code) & is_text(v, "$.minimum_version") & is_text(v, "$.client_version")
        & is_array(v, "$.required_features") & F.forall(feats, lambda f: is_text(f, "$"))
    )
    good = F.coalesce(good, F.lit(False))
    error = F.when((status == 426) & v.isNull(), "body was not JSON").when((status == 426) & ~good, "unrecognized body")
    hit = (status == 426) & good
    return F.struct(
        hit.alias("required"), F.when(hit, text(v, "$.minimum_version")).alias("minimum_version"),
        F.when(hit, F.transform(feats, lambda f: text(f, "$"))).alias("features"), error.alias("error"),
    )


def canonical(document: dict) -> bytes:
    """Two-space JSON with a newline at its end and without nulls, as it is published and hashed."""

    def clean(x):
        if isinstance(x, dict):
            return {k: clean(v) for k, v in x.items() if v is not None}
        return [clean(v) for v in x] if isinstance(x, list) else x

    return (json.dumps(clean(document), indent=2, ensure_ascii=False) + "\n").encode()


def canonical_hash(raw: Column) -> Column:
    """sha256:... of the canonical form of a JSON text."""
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else "sha256:" + hashlib.sha256(canonical(json.loads(t))).hexdigest())

    return F.pandas_udf(run, T.StringType())(raw)


def sanitize_policy(raw: Column, internal: tuple[str, ...] = ("banned_token_ids", "regex_patterns", "grammar_constraints", "multi_token_patterns")) -> Column:
    """struct of the sizes of a policy's internal lists, which are all that may be published of them."""
    v = F.try_parse_json(raw)
    return F.struct(*[F.size(items(v, f"$.{name}")).alias(f"{name}_count") for name in internal])


def upsert(index: DataFrame, new: DataFrame) -> DataFrame:
    """index with rows of the same id replaced by new ones."""
    return index.join(new.select("id"), "id", "left_anti").unionByName(new)


def publish(documents: DataFrame, path: str) -> None:
    """Writes documents(id, content) as a tree, one folder an id, and their sorted index."""
    hashed = documents.withColumn("hash", F.concat(F.lit("sha256:"), F.sha2("content", 256)))
    hashed.write.mode("overwrite").partitionBy("id").json(f"{path}/documents")
    hashed.select("id", "hash").orderBy("id").write.mode("overwrite").json(f"{path}/index")


def parse_hash(value: str) -> str:
    """Bare lower-case digest of 'sha256:<hex>' or '<hex>'; raises on anything else."""
    bare = value.strip().removeprefix("sha256:").lower()
    if not re.fullmatch("[0-9a-f]{64}", bare):
        raise ValueError(f"{value!r} isn't a SHA-256 digest")
    return bare


Validator = Callable[[Column], Column]
