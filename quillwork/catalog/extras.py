"""Queries on guard outputs, synthetic streams, tool calls and crossovers."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillwork.functions import wire
from quillwork.operators import guards, matrix, synthetic
from quillwork.plans.streams import read

OUTPUTS = ("safe", "unsafe\nS1,S10", "unsafe", "unsafe\ns14 S2", "Safe\nS1", "unsafe\nS99")


def guard_categories(spark, sf_dir):
    output = F.element_at(F.array(*map(F.lit, OUTPUTS)), (F.col("doc_id") % len(OUTPUTS) + 1).cast("int"))
    rows = read(spark, sf_dir, "documents").select("doc_id", F.explode(guards.guard_scores(output)).alias("category", "score"))
    return rows.filter("score > 0")


def prompt_guard_scores(spark, sf_dir):
    label = lambda n, c: F.struct(F.lit(n).alias("label"), c.cast("double").alias("score"))
    scores = F.array(label("BENIGN", F.lit(0.9)), label("INJECTION", F.col("doc_id") % 7 / 10), label("JAILBREAK", F.col("doc_id") % 5 / 10))
    return read(spark, sf_dir, "documents").select("doc_id", F.round(guards.prompt_guard(scores), 6).alias("score"))


def tool_call_frames(spark, sf_dir):
    call = F.struct(F.when(F.col("p_partkey") % 2 == 0, F.col("p_brand")).alias("name"), F.concat(F.lit('{"n":'), F.col("p_size").cast("string"), F.lit("}")).alias("arguments_json"), F.lit(None).cast("string").alias("id"))
    ids = F.array(F.col("p_partkey"))
    frame = wire.msgpack_frame_with_calls_hex(ids, F.lit(False), F.lit(None).cast("string"), F.array(call))
    return read(spark, sf_dir, "part").select("p_partkey", frame.alias("msgpack_hex"), wire.tool_call_protobuf_hex(call).alias("protobuf_hex"))


def synthetic_streams(spark, sf_dir):
    out = None
    for shape in synthetic.SHAPES:
        one = synthetic.stream(spark, shape, 2048).agg(F.count("*").alias("n_tokens"), F.count_distinct("id").alias("n_distinct"), F.sum(F.lit(1) + wire.msgpack_uint_size(F.col("id"))).alias("n_bytes")).select(F.lit(shape).alias("shape"), "*")
        out = one if out is None else out.unionByName(one)
    return out


def crossover_rules(spark, sf_dir):
    cells = read(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("path"), F.col("l_linenumber").alias("size"), F.element_at(F.array(F.lit("br"), F.lit("gzip"), F.lit("zstd")), (F.col("l_suppkey") % 3 + 1).cast("int")).alias("encoding"))
    out = matrix.crossover(cells.agg(F.count("*").alias("wire_bytes")))
    text = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",")
    return out.select("path", "encoding", text(F.col("wins")).alias("wins"), text(F.col("losses")).alias("losses"))


_NAMES = "['" + "', '".join(guards.GUARD_CATEGORIES) + "']"
_HEX = "lpad(hex({0}), 2, '0')"
QUERIES = {f.__name__: f for f in (guard_categories, prompt_guard_scores, tool_call_frames, synthetic_streams, crossover_rules)}
ORACLES = {
    "guard_categories": f"SELECT doc_id, ({_NAMES})[k] AS category, 1.0::DOUBLE AS score FROM (SELECT doc_id, unnest(CASE doc_id % 6 WHEN 1 THEN [1, 10] WHEN 3 THEN [14, 2] ELSE []::INT[] END) AS k FROM documents) UNION ALL SELECT doc_id, 'unsafe', 1.0 FROM documents WHERE doc_id % 6 IN (2, 5)",
    "prompt_guard_scores": "SELECT doc_id, round(greatest(doc_id % 7 / 10, doc_id % 5 / 10), 6) AS score FROM documents",
    "tool_call_frames": f"""WITH c AS (SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN p_brand END AS n, '{{"n":' || p_size || '}}' AS a FROM part),
      i AS (SELECT *, CASE WHEN p_partkey < 128 THEN {_HEX.format('p_partkey')} WHEN p_partkey < 256 THEN 'CC' || {_HEX.format('p_partkey')} WHEN p_partkey < 65536 THEN 'CD' || lpad(hex(p_partkey), 4, '0') ELSE 'CE' || lpad(hex(p_partkey), 8, '0') END AS h FROM c),
      b AS (SELECT *, CASE WHEN n IS NULL THEN '' ELSE '0A' || {_HEX.format('strlen(n)')} || hex(n) END || '12' || {_HEX.format('strlen(a)')} || hex(a) AS body FROM i)
      SELECT p_partkey, '83A3696473' || '91' || h || 'A4646F6E65C2' || 'AA' || hex('tool_calls') || '91' || CASE WHEN n IS NULL THEN '81' ELSE '82' END || 'AE' || hex('arguments_json') || {_HEX.format('strlen(a) + 160')} || hex(a)
        || CASE WHEN n IS NULL THEN '' ELSE 'A4' || hex('name') || {_HEX.format('strlen(n) + 160')} || hex(n) END AS msgpack_hex, '22' || {_HEX.format('len(body) // 2')} || body AS protobuf_hex FROM b""",
    "crossover_rules": """WITH r AS (SELECT l_returnflag AS path, l_linenumber AS size, (['br', 'gzip', 'zstd'])[1 + l_suppkey % 3] AS encoding, count(*) AS w FROM lineitem GROUP BY ALL),
      b AS (SELECT *, first_value(encoding) OVER o AS best, first_value(w) OVER o AS least FROM r WINDOW o AS (PARTITION BY path, size ORDER BY w, encoding))
      SELECT path, encoding, coalesce(string_agg(size::VARCHAR, ',' ORDER BY size) FILTER (encoding = best), '') AS wins, coalesce(string_agg(size::VARCHAR, ',' ORDER BY size) FILTER (w > least * 1.2), '') AS losses FROM b GROUP BY path, encoding""",
}
