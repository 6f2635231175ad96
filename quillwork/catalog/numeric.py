"""Queries on compression, tensors and benchmark matrices."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quillwork.operators import compress, latents, matrix
from quillwork.plans.spread import spread
from quillwork.plans.streams import joined, read

HEADERS = ("gzip, br;q=0.5, zstd;q=0.3", "zstd, gzip", "br", "*;q=0", "identity;q=0, gzip", "", "GZIP;q=0.2, br; q=0.9, deflate", "identity", "br, zstd;q=0", "zstd;q=1.0, br;q=1.0")


def _header():
    return F.element_at(F.array(*map(F.lit, HEADERS)), (F.col("doc_id") % len(HEADERS) + 1).cast("int"))


def accept_encoding_parse(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", _header().alias("header"), F.array_join(compress.accept_encoding(_header()), ",").alias("accepted"))


def byte_entropy(spark, sf_dir):
    return spread(read(spark, sf_dir, "documents")).select("doc_id", F.round(compress.byte_entropy(F.col("text")), 5).alias("bits"))


def entropy_buckets(spark, sf_dir):
    docs = spread(read(spark, sf_dir, "documents"))
    rated = docs.select(compress.bucket(F.octet_length("text")).alias("bucket"), compress.byte_entropy(F.col("text")).alias("bits"))
    return rated.groupBy("bucket").agg(F.count("*").alias("n_docs"), F.round(F.avg("bits"), 5).alias("mean_bits"))


def _picked(spark, sf_dir):
    entropy = F.when(F.col("doc_id") % 4 == 0, 2.5).when(F.col("doc_id") % 4 == 1, 4.5)
    got = compress.pick(_header(), F.col("doc_id") % 3 != 0, F.col("doc_id") % 5 != 0, entropy)
    return read(spark, sf_dir, "documents").select("doc_id", got.alias("p"))


def pick_encoding(spark, sf_dir):
    return _picked(spark, sf_dir).select("doc_id", "p.encoding", "p.reason_code", F.array_join("p.considered", ",").alias("considered"))


def pick_grid_counts(spark, sf_dir):
    return _picked(spark, sf_dir).groupBy("p.encoding", "p.reason_code").agg(F.count("*").alias("n_cells"))


def negotiate(spark, sf_dir):
    client = F.filter(F.array(F.when(F.col("doc_id") % 2 == 0, "gzip"), F.when(F.col("doc_id") % 3 == 0, "dict-zstd"), F.when(F.col("doc_id") % 5 != 0, "identity")), lambda x: x.isNotNull())
    server = F.array(F.lit("dict-zstd"), F.lit("gzip"), F.lit("identity"))
    out = read(spark, sf_dir, "documents").select("doc_id", compress.negotiate(client, server, F.when(F.col("doc_id") % 7 == 0, "development").otherwise("production")).alias("n"))
    return out.select("doc_id", "n.chosen", "n.error")


def size_buckets_rollup(spark, sf_dir):
    sized = read(spark, sf_dir, "documents").select("lang", compress.bucket(F.octet_length("text")).alias("bucket"), F.octet_length("text").alias("n"))
    return sized.rollup("bucket", "lang").agg(F.count("*").alias("n_docs"), F.sum("n").alias("n_bytes"), F.round(F.avg("n"), 4).alias("mean_bytes"))


def budget_exceeded(spark, sf_dir):
    chunks = read(spark, sf_dir, "documents").select("source", "doc_id", F.octet_length("text").cast("long").alias("n"))
    return compress.over_budget(chunks, "source", "doc_id", "n", 50_000).select("source", "doc_id", "total", "over")


def best_encoding_per_size(spark, sf_dir):
    cells = read(spark, sf_dir, "lineitem").select((F.col("l_quantity") % 5).cast("int").alias("size"), F.concat("l_returnflag", "l_linestatus").alias("encoding"), F.col("l_extendedprice").alias("wire"))
    per = cells.groupBy("size", "encoding").agg(F.round(F.min("wire"), 2).alias("wire"))
    return per.groupBy("size").agg(F.min(F.struct("wire", "encoding")).alias("b")).select("size", F.col("b.encoding").alias("winner"), F.col("b.wire").alias("wire"))


def gzip_zstd_sizes(spark, sf_dir):
    data = F.encode(F.col("text"), "utf-8")
    return spread(read(spark, sf_dir, "documents")).select("doc_id", F.octet_length("text").alias("identity"), compress.gzip_length(data).alias("gzip"), compress.zstd_length(data).alias("zstd"))


def dictionary_training(spark, sf_dir):
    samples = read(spark, sf_dir, "conversations").select(F.col("role").alias("kind"), F.encode(F.col("text"), "utf-8").alias("data"))
    trained = compress.train_dictionaries(samples, (1024, 4096))
    return trained.join(compress.winners(trained).withColumn("winner", F.lit(True)), ["kind", "dict_size"], "left").select("kind", "dict_size", F.round("gain_pct", 3).alias("gain_pct"), F.coalesce("winner", F.lit(False)).alias("winner"))


def dictionary_selection(spark, sf_dir):
    good = compress.dict_hash(F.col("text"))
    docs = read(spark, sf_dir, "benchmark").select("item_id", "text", F.when(F.col("item_id") % 5 == 0, None).otherwise("zstd").alias("content_encoding"), F.when(F.col("item_id") % 5 == 1, None).when(F.col("item_id") % 5 == 2, "sha256:xyz").otherwise(good).alias("dict_hash"))
    loaded = read(spark, sf_dir, "benchmark").filter("item_id % 2 = 0").select(good.alias("hash"))
    return compress.select_dictionary(docs, loaded).select("item_id", "status")


def _vectors(spark, sf_dir):
    return read(spark, sf_dir, "embeddings").select("vec_id", "label", F.col("embedding").alias("x"))


def _quantized(spark, sf_dir, top):
    v = _vectors(spark, sf_dir).withColumn("s", latents.scales(F.col("x"), 4))
    return v.withColumn("q", latents.quantize(F.col("x"), F.col("s"), top, 4))


def latent_scales(spark, sf_dir):
    return _quantized(spark, sf_dir, 127).select("vec_id", F.posexplode("s").alias("channel", "scale")).select("vec_id", "channel", F.col("scale").cast("double").alias("scale"))


def quantize_int8(spark, sf_dir):
    return _quantized(spark, sf_dir, 127).select("vec_id", joined(F.col("q")).alias("q"))


def quantize_int4(spark, sf_dir):
    return _quantized(spark, sf_dir, 7).select("vec_id", joined(F.col("q")).alias("q"))


def dequantize_error(spark, sf_dir):
    v = _quantized(spark, sf_dir, 127).withColumn("y", latents.dequantize(F.col("q"), F.col("s"), 127, 4))
    worst = F.array_max(F.zip_with("x", "y", lambda a, b: F.abs(a.cast("double") - b.cast("double"))))
    return v.select("vec_id", F.round(worst, 6).alias("worst_error"))


def int4_pack_hex(spark, sf_dir):
    return _quantized(spark, sf_dir, 7).select("vec_id", latents.pack4(F.slice("q", 1, F.size("q") - 1)).alias("packed"))


def int4_unpack(spark, sf_dir):
    v = _quantized(spark, sf_dir, 7).select("vec_id", latents.pack4(F.slice("q", 1, F.size("q") - 1)).alias("p"), (F.size("q") - 1).alias("n"))
    return v.select("vec_id", joined(latents.unpack4(F.col("p"), F.col("n"))).alias("q"))


def _keyed(spark, sf_dir):
    order = Window.partitionBy("label").orderBy("vec_id")
    v = _vectors(spark, sf_dir).withColumn("seq", (F.row_number().over(order) - 1).cast("long"))
    return v.select(F.col("label").alias("stream"), "seq", "x", (F.col("seq") % 4 == 0).alias("keyframe"))


def delta_keyframe_residual(spark, sf_dir):
    return latents.delta_encode(_keyed(spark, sf_dir), 127, 4).select("stream", "seq", joined(F.col("data")).alias("data"))


def delta_reconstruct(spark, sf_dir):
    out = latents.delta_decode(latents.delta_encode(_keyed(spark, sf_dir), 127, 4).select("stream", "seq", "keyframe", "scales", "data"), 127, 4)
    return out.select("stream", "seq", joined(F.col("q")).alias("q"))


def pipeline_rejections(spark, sf_dir):
    pipeline = F.element_at(F.array(*map(F.lit, (*latents.PIPELINES, "zip"))), (F.col("vec_id") % 8 + 1).cast("int"))
    asked = read(spark, sf_dir, "embeddings").select("vec_id", F.col("label").alias("space_id"), pipeline.alias("pipeline"), F.when(F.col("vec_id") % 2 == 0, "image").otherwise("video").alias("media"), (F.col("vec_id") % 3 == 0).alias("has_scales"))
    offered = asked.filter("pipeline <> 'zip' and space_id % 2 = 0").select("space_id", "pipeline").distinct()
    return latents.rejections(asked, offered).select("vec_id", "pipeline", "reason")


def latent_frame_bytes(spark, sf_dir):
    frame = latents.frame_msgpack(latents.typed_bytes(F.col("x"), "fp16"), F.col("vec_id"), F.col("vec_id") % 4 == 0, F.lit(False), F.lit(None).cast("string"))
    return _vectors(spark, sf_dir).select("vec_id", F.sha2(frame, 256).alias("frame_sha256"))


def _bench(spark, sf_dir):
    error = F.when((F.col("l_linenumber") == 7) & (F.col("l_orderkey") % 97 == 0), "timeout")
    return read(spark, sf_dir, "lineitem").select(
        F.col("l_returnflag").alias("engine"), F.col("l_linestatus").alias("lang"), (F.col("l_linenumber") % 3).alias("size"),
        F.element_at(F.array(F.lit("identity"), F.lit("gzip"), F.lit("zstd")), (F.col("l_suppkey") % 3 + 1).cast("int")).alias("encoding"),
        F.floor(F.col("l_quantity") * 100).cast("long").alias("wire_bytes"), (F.col("l_discount") * 1000 + 1).alias("ttft_ms"), F.floor(F.col("l_quantity")).cast("long").alias("tokens"),
        error.alias("error"), F.col("l_orderkey").alias("run_id"), (F.col("l_partkey") % 3).cast("string").alias("fingerprint"), F.col("l_linenumber").alias("line"),
    )


CELL = ["engine", "size", "encoding"]


def median_matrix(spark, sf_dir):
    return matrix.medians(_bench(spark, sf_dir), [*CELL, "lang"], ["wire_bytes", "ttft_ms"]).withColumn("ttft_ms", F.round("ttft_ms", 6))


def unanimity(spark, sf_dir):
    clients = matrix.client_medians(_bench(spark, sf_dir), CELL, "lang", ["wire_bytes", "tokens"])
    return matrix.unanimity(clients, CELL)


def pivot_grid(spark, sf_dir):
    return matrix.pivot_grid(_bench(spark, sf_dir), ["engine", "lang", "size"], ["identity", "gzip", "zstd"], "wire_bytes")


def headline_ratio(spark, sf_dir):
    cells = _bench(spark, sf_dir).groupBy(*CELL).agg(F.max("wire_bytes").alias("wire_bytes"))
    return matrix.headline(cells, (F.col("encoding") == "identity") & (F.col("size") == 1), "wire_bytes").select(*CELL, F.round("ratio", 6).alias("ratio"))


def quarantine(spark, sf_dir):
    runs = _bench(spark, sf_dir).groupBy("engine", "run_id").agg(F.min("fingerprint").alias("fingerprint"))
    return matrix.quarantine(runs)


def errored_cells(spark, sf_dir):
    return matrix.errored(_bench(spark, sf_dir)).groupBy(*CELL, "error").agg(F.count("*").alias("n_errors"))


def efficiency_ratios(spark, sf_dir):
    cells = _bench(spark, sf_dir).groupBy("size", "encoding").agg(F.sum("wire_bytes").alias("wire_bytes"), F.min("ttft_ms").alias("ttft_ms"))
    out = matrix.efficiency(cells)
    return out.select("size", "encoding", *[F.round(c, 6).alias(c) for c in ("wire_coeff", "ttft_ratio", "interactive", "batch")])


def energy_budget(spark, sf_dir):
    rows = read(spark, sf_dir, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.sum(F.floor("l_quantity") * 100).alias("text_bytes"), F.sum(F.floor("l_quantity")).alias("id_bytes"))
    out = matrix.energy(rows.withColumn("round_trips", F.lit(3)))
    return out.select("l_returnflag", "l_linestatus", *[F.round(c, 4).alias(c) for c in ("text_mj", "ids_mj", "ratio")])


_HEAD = "(['" + "', '".join(HEADERS) + "'])[1 + doc_id % 10]"
_ACCEPT = f"""h AS (SELECT doc_id, {_HEAD} AS header FROM documents),
p AS (SELECT doc_id, header, list_filter(list_transform(string_split(header, ','), lambda x: trim(x)), lambda x: x <> '') AS parts FROM h),
e AS (SELECT doc_id, header, parts, list_transform(parts, lambda x, i: struct_pack(nq := -coalesce(try_cast(nullif(regexp_extract(x, ';\\s*q\\s*=\\s*([0-9.]+)\\s*(?:;|$)', 1), '') AS DOUBLE), 1.0), i := i, name := lower(trim(split_part(x, ';', 1))))) AS es FROM p),
n AS (SELECT *, list_transform(list_sort(list_filter(es, lambda x: x.nq < 0 AND x.name IN ('gzip', 'br', 'zstd', 'identity'))), lambda x: x.name) AS names FROM e),
a AS (SELECT doc_id, header, CASE WHEN len(parts) = 0 THEN ['identity'] WHEN len(list_filter(parts, lambda x: regexp_matches(x, '(?i)^identity\\s*;\\s*q\\s*=\\s*0'))) > 0 OR (len(list_filter(es, lambda x: x.name = '*' AND x.nq = 0)) > 0 AND len(names) = 0)
  OR list_contains(names, 'identity') THEN names ELSE list_append(names, 'identity') END AS accepted FROM n)"""
_PICK = f"""WITH {_ACCEPT}, c AS (SELECT doc_id, list_contains(accepted, 'zstd') AS z, list_contains(accepted, 'br') AS b, list_contains(accepted, 'gzip') AS g, list_contains(accepted, 'identity') AS d,
  doc_id % 3 <> 0 AS dict, doc_id % 5 <> 0 AS en, CASE doc_id % 4 WHEN 0 THEN 2.5 WHEN 1 THEN 4.5 END AS ent FROM a),
r AS (SELECT *, z AND dict AND en AS zz, CASE WHEN NOT z THEN 'gzip_no_zstd_in_accept' WHEN NOT dict THEN 'gzip_no_dict' WHEN NOT en THEN 'gzip_middleware_disabled' END AS dropped FROM c),
k AS (SELECT doc_id, CASE WHEN coalesce(ent < 3, false) AND b AND zz THEN 'br' WHEN zz THEN 'zstd' WHEN g THEN 'gzip' WHEN b THEN 'br' ELSE 'identity' END AS encoding,
  CASE WHEN coalesce(ent < 3, false) AND b AND zz THEN 'br_content_sample_low_entropy' WHEN zz THEN 'dict_zstd_default' WHEN g THEN dropped WHEN b THEN 'br_fallback_no_gzip' ELSE 'identity_last_resort' END AS reason_code,
  array_to_string(list_filter([CASE WHEN b THEN 'br' END, CASE WHEN g THEN 'gzip' END, CASE WHEN d THEN 'identity' END, CASE WHEN zz THEN 'zstd' END], lambda x: x IS NOT NULL), ',') AS considered FROM r)"""
_BUCKET = "CASE WHEN strlen(text) <= 300 THEN 'small' WHEN strlen(text) <= 2048 THEN 'medium' ELSE 'large' END"
_BITS = """r AS (SELECT row_number() OVER () AS rid, doc_id, text FROM documents),
b AS (SELECT rid, byte, count(*) AS c FROM (SELECT rid, unnest(regexp_extract_all(hex(text), '..')) AS byte FROM r) GROUP BY ALL),
e AS (SELECT rid, log2(sum(c)) - sum(c * log2(c)) / sum(c) AS bits FROM b GROUP BY rid),
bits AS (SELECT doc_id, text, CASE WHEN text IS NOT NULL THEN coalesce(bits, 0) END AS bits FROM r LEFT JOIN e USING (rid))"""
_HALF = "(CASE WHEN {0} < power(2, -14) THEN round_even({0}::DOUBLE / power(2, -24), 0) * power(2, -24) ELSE round_even({0}::DOUBLE / power(2, floor(log2({0}::DOUBLE)) - 10), 0) * power(2, floor(log2({0}::DOUBLE)) - 10) END)::FLOAT"
_VEC = "v AS (SELECT vec_id, label, embedding AS x FROM embeddings)"
_SCALES = f"{_VEC}, s AS (SELECT *, list_transform([0, 1, 2, 3], lambda c: {_HALF.format('list_max(list_transform(x[len(x) // 4 * c + 1 : len(x) // 4 * (c + 1)], lambda e: abs(e)))')}) AS s FROM v)"


def _q(top: int, x: str = "x", s: str = "s") -> str:
    return f"list_transform({x}, lambda e, i: CASE WHEN {s}[1 + (i - 1) // (len({x}) // 4)] = 0 THEN 0 ELSE greatest(-{top}, least({top}, round_even(((e / {s}[1 + (i - 1) // (len({x}) // 4)])::FLOAT * {top}::FLOAT)::FLOAT, 0)))::INT END)"


_PACK = "array_to_string(list_transform(range(0, (len(q) + 1) // 2), lambda k: substr('0123456789ABCDEF', 1 + (coalesce(q[2 * k + 2], 0) + 16) % 16, 1) || substr('0123456789ABCDEF', 1 + (q[2 * k + 1] + 16) % 16, 1)), '')"
_KEYED = f"""{_SCALES}, k AS (SELECT label AS stream, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS seq, x, s FROM s),
f AS (SELECT a.stream, a.seq, a.seq % 4 = 0 AS keyframe, a.x, b.s AS ks, b.x AS kx FROM k a JOIN k b ON a.stream = b.stream AND b.seq = a.seq - a.seq % 4),
g AS (SELECT stream, seq, keyframe, {_q(127, 'x', 'ks')} AS q, {_q(127, 'kx', 'ks')} AS kq FROM f),
r AS (SELECT *, CASE WHEN keyframe THEN q ELSE list_transform(q, lambda e, i: greatest(-127, least(127, e - kq[i]))) END AS data FROM g)"""
_BENCH = """bench AS (SELECT l_returnflag AS engine, l_linestatus AS lang, l_linenumber % 3 AS size, (['identity', 'gzip', 'zstd'])[1 + l_suppkey % 3] AS encoding, floor(l_quantity * 100)::BIGINT AS wire_bytes,
  l_discount * 1000 + 1 AS ttft_ms, floor(l_quantity)::BIGINT AS tokens, CASE WHEN l_linenumber = 7 AND l_orderkey % 97 = 0 THEN 'timeout' END AS error, l_orderkey AS run_id, (l_partkey % 3)::VARCHAR AS fingerprint FROM lineitem)"""

QUERIES = {
    f.__name__: f
    for f in (accept_encoding_parse, byte_entropy, entropy_buckets, pick_encoding, pick_grid_counts, negotiate, size_buckets_rollup, budget_exceeded, best_encoding_per_size, gzip_zstd_sizes,
              dictionary_training, dictionary_selection, latent_scales, quantize_int8, quantize_int4, dequantize_error, int4_pack_hex, int4_unpack, delta_keyframe_residual, delta_reconstruct,
              pipeline_rejections, latent_frame_bytes, median_matrix, unanimity, pivot_grid, headline_ratio, quarantine, errored_cells, efficiency_ratios, energy_budget)
}
ORACLES = {
    "accept_encoding_parse": f"WITH {_ACCEPT} SELECT doc_id, header, array_to_string(accepted, ',') AS accepted FROM a",
    "byte_entropy": f"WITH {_BITS} SELECT doc_id, round(bits, 5) AS bits FROM bits",
    "entropy_buckets": f"WITH {_BITS} SELECT {_BUCKET} AS bucket, count(*) AS n_docs, round(avg(bits), 5) AS mean_bits FROM bits GROUP BY 1",
    "pick_encoding": _PICK + " SELECT doc_id, encoding, reason_code, considered FROM k",
    "pick_grid_counts": _PICK + " SELECT encoding, reason_code, count(*) AS n_cells FROM k GROUP BY ALL",
    "negotiate": """WITH c AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'dict-zstd' WHEN doc_id % 2 = 0 THEN 'gzip' WHEN doc_id % 5 <> 0 THEN 'identity' END AS chosen FROM documents),
      e AS (SELECT *, CASE WHEN chosen IS NULL THEN 'no algorithm in common' WHEN chosen = 'identity' AND doc_id % 7 <> 0 THEN 'identity rejected in production' END AS error FROM c)
      SELECT doc_id, CASE WHEN error IS NULL THEN chosen END AS chosen, error FROM e""",
    "size_buckets_rollup": f"SELECT bucket, lang, count(*) AS n_docs, sum(n)::BIGINT AS n_bytes, round(avg(n), 4) AS mean_bytes FROM (SELECT lang, {_BUCKET} AS bucket, strlen(text) AS n FROM documents) GROUP BY ROLLUP (bucket, lang)",
    "budget_exceeded": "SELECT source, doc_id, total, total > 50000 AS over FROM (SELECT source, doc_id, sum(strlen(text)) OVER (PARTITION BY source ORDER BY doc_id ROWS UNBOUNDED PRECEDING)::BIGINT AS total FROM documents)",
    "best_encoding_per_size": "WITH c AS (SELECT (l_quantity % 5)::INT AS size, l_returnflag || l_linestatus AS encoding, round(min(l_extendedprice), 2) AS wire FROM lineitem GROUP BY ALL) SELECT size, encoding AS winner, wire FROM (SELECT *, row_number() OVER (PARTITION BY size ORDER BY wire, encoding) AS r FROM c) WHERE r = 1",
    "dictionary_selection": """SELECT item_id, CASE WHEN item_id % 5 = 0 THEN 'none' WHEN item_id % 5 = 1 THEN 'missing' WHEN item_id % 5 = 2 THEN 'malformed'
      WHEN sha256(text) IN (SELECT sha256(text) FROM benchmark WHERE item_id % 2 = 0) THEN 'ok' ELSE 'unknown' END AS status FROM benchmark""",
    "latent_scales": f"WITH {_SCALES} SELECT vec_id, unnest([0, 1, 2, 3])::INT AS channel, unnest(s)::DOUBLE AS scale FROM s",
    "quantize_int8": f"WITH {_SCALES} SELECT vec_id, array_to_string({_q(127)}, ',') AS q FROM s",
    "quantize_int4": f"WITH {_SCALES} SELECT vec_id, array_to_string({_q(7)}, ',') AS q FROM s",
    "dequantize_error": f"WITH {_SCALES}, t AS (SELECT vec_id, x, s, {_q(127)} AS q FROM s) SELECT vec_id, round(list_max(list_transform(x, lambda e, i: abs(e::DOUBLE - ((q[i]::FLOAT * s[1 + (i - 1) // (len(x) // 4)])::FLOAT / 127::FLOAT)::DOUBLE))), 6) AS worst_error FROM t",
    "int4_pack_hex": f"WITH {_SCALES}, t AS (SELECT vec_id, ({_q(7)})[1:len(x) - 1] AS q FROM s) SELECT vec_id, {_PACK} AS packed FROM t",
    "int4_unpack": f"WITH {_SCALES} SELECT vec_id, array_to_string(({_q(7)})[1:len(x) - 1], ',') AS q FROM s",
    "delta_keyframe_residual": f"WITH {_KEYED} SELECT stream, seq, array_to_string(data, ',') AS data FROM r",
    "delta_reconstruct": f"WITH {_KEYED} SELECT stream, seq, array_to_string(CASE WHEN keyframe THEN data ELSE list_transform(data, lambda e, i: greatest(-127, least(127, e + kq[i]))) END, ',') AS q FROM r",
    "pipeline_rejections": """WITH a AS (SELECT vec_id, label, (['raw', 'int8', 'int4', 'int8-adaptive', 'int4-adaptive', 'delta+int8', 'delta+int4', 'zip'])[1 + vec_id % 8] AS pipeline FROM embeddings)
      SELECT vec_id, pipeline, CASE WHEN pipeline = 'zip' THEN 'unknown pipeline' WHEN (label, pipeline) NOT IN (SELECT (label, pipeline) FROM a WHERE label % 2 = 0) THEN 'not offered'
        WHEN vec_id % 2 = 0 AND starts_with(pipeline, 'delta') THEN 'delta needs a stream of frames' WHEN pipeline IN ('int8', 'int4') AND vec_id % 3 <> 0 THEN 'static scales are missing' END AS reason FROM a""",
    "median_matrix": f"WITH {_BENCH} SELECT engine, size, encoding, lang, median(wire_bytes)::DOUBLE AS wire_bytes, round(median(ttft_ms), 6) AS ttft_ms, count(*) AS n_reps FROM bench GROUP BY ALL",
    "unanimity": f"WITH {_BENCH} SELECT engine, size, encoding, count(DISTINCT w) = 1 AS wire_unanimous, count(DISTINCT t) = 1 AND sum(e) = 0 AS decode_unanimous, count(*) AS n_rows FROM (SELECT engine, size, encoding, lang, median(wire_bytes) AS w, median(tokens) AS t, count(error) AS e FROM bench GROUP BY ALL) GROUP BY engine, size, encoding",
    "pivot_grid": f"WITH {_BENCH} SELECT engine, lang, size, " + ", ".join(f"min(wire_bytes) FILTER (encoding = '{e}') AS {e}" for e in ("identity", "gzip", "zstd")) + " FROM bench GROUP BY engine, lang, size",
    "headline_ratio": f"WITH {_BENCH}, c AS (SELECT engine, size, encoding, max(wire_bytes) AS w FROM bench GROUP BY ALL) SELECT c.engine, c.size, c.encoding, round(b.w / c.w, 6) AS ratio FROM c JOIN c b ON b.engine = c.engine AND b.encoding = 'identity' AND b.size = 1",
    "quarantine": f"WITH {_BENCH}, r AS (SELECT engine, run_id, min(fingerprint) AS fingerprint FROM bench GROUP BY ALL), f AS (SELECT *, first_value(fingerprint) OVER (PARTITION BY engine ORDER BY run_id) AS canonical FROM r) SELECT engine, run_id, fingerprint, canonical FROM f WHERE fingerprint <> canonical",
    "errored_cells": f"WITH {_BENCH} SELECT engine, size, encoding, error, count(*) AS n_errors FROM bench WHERE error IS NOT NULL GROUP BY ALL",
    "efficiency_ratios": f"""WITH {_BENCH}, c AS (SELECT size, encoding, sum(wire_bytes)::DOUBLE AS w, min(ttft_ms) AS t FROM bench GROUP BY ALL), j AS (SELECT c.size, c.encoding, c.w / b.w AS w, c.t / b.t AS t FROM c JOIN c b ON b.size = c.size AND b.encoding = 'identity')
      SELECT size, encoding, round(w, 6) AS wire_coeff, round(t, 6) AS ttft_ratio, round(1 / (w * t), 6) AS interactive, round(1 / w, 6) AS batch FROM j""",
    "energy_budget": """WITH r AS (SELECT l_returnflag, l_linestatus, sum(floor(l_quantity) * 100) AS t, sum(floor(l_quantity)) AS i FROM lineitem GROUP BY ALL),
      e AS (SELECT *, t * ((2.1 + 14.0 + 0.9 + 10.0 + 50.0 + 10.0 + 0.15 + 6.0 + 1.8) * 1e-6) * 3 AS a, i * ((2.1 + 0.9 + 10.0 + 50.0 + 10.0 + 0.15 + 2.1) * 1e-6) * 3 + i * (6.0 * 1e-6) AS b FROM r)
      SELECT l_returnflag, l_linestatus, round(a, 4) AS text_mj, round(b, 4) AS ids_mj, round(a / b, 4) AS ratio FROM e""",
}
