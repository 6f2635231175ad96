"""Queries on published documents, tool results and templates."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillwork.operators import documents as D
from quillwork.operators import tools
from quillwork.plans.streams import joined, read

MAPS = (
    '{"id":"a/b","version":"2","vocab_size":10,"vocab":{"x":1},"encoder":"byte_level"}', '{"id":"","version":"2"}', '{"id":"a","version":2}', '{"id":"a","version":"1","vocab_size":0}',
    '{"id":"a","version":"1","vocab_size":3,"vocab":{}}', '{"id":"a","version":"1","vocab_size":3,"tokens":{"1":"x"},"encoder":"other"}', '{"id":"a","version":"1","vocab_size":3,"tokens":{"1":"x"},"merges":"x"}',
    '{"id":"a","version":"1","vocab_size":3,"tokens":{"1":"x"},"byte_fallback_start":1}', "[1]", '{"id":"a","version":"1","vocab_size":3,"vocab":{"x":1},"tool_calling":{"convention":"none","markers":{"start":"<s>","end":"</s>"}},"special_tokens":{"<s>":1}}',
)
POLICIES = (
    '{"id":"p","version":"1","tokenizers":["a"],"categories":[{"name":"pii","action":"redact"}],"classifier":{"family":"f"}}', '{"id":"p","version":"1","tokenizers":[]}', '{"id":"p","version":"1","tokenizers":["a",1]}',
    '{"id":"p","version":"1","tokenizers":["a"],"categories":[{"name":"Bad Name","action":"stop"}],"classifier":{"family":"f"}}', '{"id":"p","version":"1","tokenizers":["a"],"categories":[{"name":"x","action":"explode"}]}',
    '{"id":"p","version":"1","tokenizers":["a"],"categories":[{"name":"x","action":"flag"}],"classifier":{"family":"f","host":"moon"}}', '{"id":"p","version":"1","tokenizers":["a"],"categories":[{"name":"x","action":"flag"}],"classifier":{"family":"f"},"rules_summary":{"regex_pattern_count":-1}}',
)
BODIES = ('{"error":"version_required","minimum_version":"0.5","client_version":"0.4","required_features":["zstd","delta"]}', '{"error":"other"}', "no json", '{"error":"version_required","minimum_version":"0.5","client_version":"0.4","required_features":[1]}')


def _one_of(values, key):
    return F.element_at(F.array(*map(F.lit, values)), (F.col(key) % len(values) + 1).cast("int"))


def map_validation(spark, sf_dir):
    return read(spark, sf_dir, "benchmark").select("item_id", D.map_error(_one_of(MAPS, "item_id")).alias("error"))


def policy_validation(spark, sf_dir):
    return read(spark, sf_dir, "benchmark").select("item_id", D.policy_error(_one_of(POLICIES, "item_id")).alias("error"))


def policy_hashes(spark, sf_dir):
    return read(spark, sf_dir, "benchmark").select("item_id", D.canonical_hash(_one_of(POLICIES, "item_id")).alias("hash"))


def pinned_documents(spark, sf_dir):
    docs = read(spark, sf_dir, "pages").select("url", F.col("html").alias("content")).groupBy("url").agg(F.min("content").alias("content"))
    digest = F.concat(F.lit("sha256:"), F.sha2(F.when(F.length("content") % 3 == 0, F.lit("x")).otherwise(F.col("content")), 256))
    wanted = docs.select(F.when(F.length("content") % 5 == 0, F.concat("url", F.lit("?gone"))).otherwise(F.col("url")).alias("url"), digest.alias("hash"))
    return D.pinned(docs, wanted).select("url", "status")


def well_known_urls(spark, sf_dir):
    name = _one_of(("qwen/qwen2", "../x", "/abs", "UPPER", "a.b-c_d/1", "end/"), "item_id")
    return read(spark, sf_dir, "benchmark").select("item_id", D.well_known_url(F.lit("https://example.org/"), ".well-known/maps-store", "maps", name).alias("url"))


def version_policy(spark, sf_dir):
    got = D.version_required(F.when(F.col("item_id") % 3 == 0, 200).otherwise(426), _one_of(BODIES, "item_id"))
    out = read(spark, sf_dir, "benchmark").select("item_id", got.alias("r"))
    return out.select("item_id", "r.required", "r.minimum_version", F.array_join("r.features", ",").alias("features"), "r.error")


def index_upsert(spark, sf_dir):
    index = read(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("id"), F.col("n_name").alias("entry"))
    new = read(spark, sf_dir, "region").select((F.col("r_regionkey") * 7).cast("long").alias("id"), F.col("r_name").alias("entry"))
    return D.upsert(index, new)


def template_render(spark, sf_dir):
    template = _one_of(("Hello {name}, from {lang}!", "{name}{name}", "no slots", "{missing} x", "{name} {bad-slot}"), "doc_id")
    slots = F.create_map(F.lit("name"), F.col("source"), F.lit("lang"), F.col("lang"))
    out = read(spark, sf_dir, "documents").select("doc_id", tools.render(tools.template_parts(template), slots).alias("r"))
    return out.select("doc_id", "r.text", "r.missing")


def leaf_meta_pairs(spark, sf_dir):
    """Ids of each turn's text: attached to even turns, in a legacy block after odd ones."""
    ids = F.transform(F.sequence(F.lit(1), F.least(F.length("text"), F.lit(4))), lambda i: i.cast("long") + F.col("turn"))
    meta = F.create_map(F.lit(tools.KEY), F.struct(F.lit("m1").alias("map_id"), ids.alias("ids")))
    block = lambda kind, text, m: F.struct(F.lit(kind).alias("type"), text.alias("text"), m.alias("meta")).cast(tools.BLOCK)
    none = F.lit(None).cast("map<string,struct<map_id:string,ids:array<bigint>>>")
    content = F.when(F.col("turn") % 2 == 0, F.array(block("text", F.col("text"), meta))).otherwise(F.array(block("text", F.col("text"), none), block(tools.LEGACY, F.lit(None).cast("string"), meta)))
    rows = read(spark, sf_dir, "conversations").select("conv_id", "turn", F.posexplode(tools.ids_of(content)).alias("place", "m"), F.size(tools.strip(content)).alias("n_stripped"))
    return rows.select("conv_id", "turn", "place", "m.map_id", joined(F.col("m.ids")).alias("ids"), "n_stripped")


def wrapped_tool_results(spark, sf_dir):
    ids = F.array(F.col("turn"), F.length("text").cast("long"))
    content = F.array(F.struct(F.lit("text").alias("type"), F.col("text").alias("text"), F.lit(None).cast("map<string,struct<map_id:string,ids:array<bigint>>>").alias("meta")).cast(tools.BLOCK))
    once = tools.wrap(content, F.array(ids), "m1", 100)
    rows = read(spark, sf_dir, "conversations").select("conv_id", "turn", tools.ids_of(tools.wrap(once, F.array(F.array(F.lit(0).cast("long"))), "m1", 100))[0].alias("m"))
    return rows.select("conv_id", "turn", "m.map_id", joined(F.col("m.ids")).alias("ids"))


def _list(values) -> str:
    return "([" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + f"])[1 + item_id % {len(values)}]"


def _case(*checks: tuple[str, str]) -> str:
    return "CASE " + " ".join(f"WHEN NOT coalesce({ok}, false) THEN '{message}'" for ok, message in checks) + " END"


def _none(path: str) -> str:
    return f"coalesce(json_type(j, '{path}'), 'NULL') = 'NULL'"


_MAP_CHECKS = _case(
    ("json_type(j) = 'OBJECT'", "not an object"), ("json_type(j, '$.id') = 'VARCHAR' AND j->>'$.id' <> ''", "id must be a non-empty string"), ("json_type(j, '$.version') = 'VARCHAR' AND j->>'$.version' <> ''", "version must be a non-empty string"),
    ("json_type(j, '$.vocab_size') IN ('UBIGINT', 'BIGINT') AND (j->>'$.vocab_size')::BIGINT >= 1", "vocab_size must be a positive integer"),
    ("coalesce(len(json_keys(j, '$.vocab')), 0) > 0 OR coalesce(len(json_keys(j, '$.tokens')), 0) > 0", "one of vocab and tokens is required"), (f"{_none('$.encoder')} OR j->>'$.encoder' IN ('byte_level', 'metaspace')", "encoder must be byte_level or metaspace"),
    (f"{_none('$.merges')} OR json_type(j, '$.merges') = 'ARRAY'", "merges must be a list"), (f"({_none('$.byte_fallback_start')}) = ({_none('$.byte_fallback_end')})", "byte_fallback_start and byte_fallback_end must both be set or both omitted"),
    (f"{_none('$.tool_calling')} OR list_contains(json_keys(j, '$.special_tokens'), j->>'$.tool_calling.markers.start') AND list_contains(json_keys(j, '$.special_tokens'), j->>'$.tool_calling.markers.end')", "tool_calling.markers must be special tokens"),
)
_EACH = "(SELECT coalesce(bool_and({0}), true) FROM (SELECT unnest(json_extract(j, '{1}[*]')) AS c))"
_POLICY_CHECKS = _case(
    ("json_array_length(j, '$.tokenizers') > 0", "tokenizers must be a non-empty array"), ("len(list_filter(json_extract(j, '$.tokenizers[*]'), lambda t: json_type(t) <> 'VARCHAR')) = 0", "tokenizers entries must be strings"),
    ("json_array_length(j, '$.categories') > 0", "categories must be a non-empty array"), ("len(list_filter(json_extract(j, '$.categories[*]'), lambda c: NOT regexp_matches(c->>'$.name', '^[a-z][a-z0-9_]*$'))) = 0", "category.name is malformed"),
    ("len(list_filter(json_extract(j, '$.categories[*]'), lambda c: c->>'$.action' NOT IN ('stop', 'redact', 'regenerate', 'flag'))) = 0", "category.action must be one of stop|redact|regenerate|flag"),
    (f"{_none('$.classifier.host')} OR j->>'$.classifier.host' IN ('server', 'client', 'both')", "classifier.host must be one of server|client|both"),
    (f"{_none('$.rules_summary.regex_pattern_count')} OR (j->>'$.rules_summary.regex_pattern_count')::BIGINT >= 0", "rules_summary.regex_pattern_count must be a non-negative integer"),
)
QUERIES = {
    f.__name__: f
    for f in (map_validation, policy_validation, policy_hashes, pinned_documents, well_known_urls, version_policy, index_upsert, template_render, leaf_meta_pairs, wrapped_tool_results)
}
ORACLES = {
    "map_validation": f"SELECT item_id, {_MAP_CHECKS} AS error FROM (SELECT item_id, ({_list(MAPS)})::JSON AS j FROM benchmark)",
    "policy_validation": f"SELECT item_id, {_POLICY_CHECKS} AS error FROM (SELECT item_id, ({_list(POLICIES)})::JSON AS j FROM benchmark)",
    "pinned_documents": """WITH d AS (SELECT url, min(html) AS c FROM pages GROUP BY url) SELECT CASE WHEN length(c) % 5 = 0 THEN url || '?gone' ELSE url END AS url,
      CASE WHEN length(c) % 5 = 0 AND NOT EXISTS (SELECT 1 FROM d e WHERE e.url = d.url || '?gone') THEN 'missing' WHEN length(c) % 3 = 0 THEN 'mismatch' ELSE 'ok' END AS status FROM d""",
    "well_known_urls": f"""SELECT item_id, CASE WHEN regexp_matches(n, '^[a-z0-9._/-]+$') AND NOT contains(n, '..') AND n[1] <> '/' AND n[-1] <> '/' THEN 'https://example.org/.well-known/maps-store/maps/' || n || '.json' END AS url
      FROM (SELECT item_id, {_list(('qwen/qwen2', '../x', '/abs', 'UPPER', 'a.b-c_d/1', 'end/'))} AS n FROM benchmark)""",
    "version_policy": """WITH t AS (SELECT item_id, item_id % 3 <> 0 AS up, item_id % 4 AS b FROM benchmark) SELECT item_id, up AND b = 0 AS required, CASE WHEN up AND b = 0 THEN '0.5' END AS minimum_version,
      CASE WHEN up AND b = 0 THEN 'zstd,delta' END AS features, CASE WHEN up AND b = 2 THEN 'body was not JSON' WHEN up AND b IN (1, 3) THEN 'unrecognized body' END AS error FROM t""",
    "index_upsert": "SELECT n_nationkey::BIGINT AS id, n_name AS entry FROM nation WHERE n_nationkey NOT IN (SELECT r_regionkey * 7 FROM region) UNION ALL SELECT (r_regionkey * 7)::BIGINT, r_name FROM region",
    "template_render": """SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'Hello ' || source || ', from ' || lang || '!' WHEN 1 THEN source || source WHEN 2 THEN 'no slots' WHEN 4 THEN source || ' {bad-slot}' END AS text,
      CASE WHEN doc_id % 5 = 3 THEN 'missing' END AS missing FROM documents""",
    "leaf_meta_pairs": """WITH p AS (SELECT conv_id, turn, array_to_string(list_transform(range(1, least(length(text), 4) + 1), lambda i: i + turn), ',') AS ids FROM conversations)
      SELECT conv_id, turn, 0 AS place, 'm1' AS map_id, ids, 1 AS n_stripped FROM p UNION ALL SELECT conv_id, turn, 1, 'm1', ids, 1 FROM p WHERE turn % 2 = 1""",
    "wrapped_tool_results": "SELECT conv_id, turn, CASE WHEN length(text) >= 100 THEN 'm1' END AS map_id, CASE WHEN length(text) >= 100 THEN turn || ',' || length(text) END AS ids FROM conversations",
}
