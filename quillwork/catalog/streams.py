"""Queries on token streams: regions, deltas, frames and their sizes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillwork.functions import wire
from quillwork.operators import delta, regions
from quillwork.plans.streams import END, EVENT_TOKENS_SQL, START, event_tokens, frames_of, joined, line_tokens, read


def stream_ends(tokens: DataFrame) -> DataFrame:
    reason = F.when(F.col("stream_id") % 2 == 0, "stop").otherwise("length").alias("finish_reason")
    return tokens.groupBy("stream_id").agg(F.count("*").alias("length")).select("stream_id", "length", reason)


def _events(spark: SparkSession, sf_dir: str, cap: int) -> DataFrame:
    tokens = event_tokens(spark, sf_dir)
    return regions.watch(tokens, START, END, cap, stream_ends(tokens)).withColumn("ids", joined(F.col("ids")))


def region_events(spark, sf_dir):
    return _events(spark, sf_dir, regions.CAP)


def region_overflow_cap(spark, sf_dir):
    return _events(spark, sf_dir, 3)


def region_bodies(spark, sf_dir):
    found = regions.watch(event_tokens(spark, sf_dir), START, END).filter("kind = 'region'")
    return found.select("stream_id", "at", F.size("ids").alias("n_ids"), joined(F.col("ids")).alias("ids"))


def region_stats(spark, sf_dir):
    found = _events(spark, sf_dir, regions.CAP)
    return found.groupBy("kind").agg(F.count("*").alias("n_events"), F.countDistinct("stream_id").alias("n_streams"))


def stream_stats(spark, sf_dir):
    tokens = line_tokens(spark, sf_dir)
    return tokens.groupBy("stream_id").agg(F.count("*").alias("token_count"), (4 * F.count("*")).alias("byte_count"), F.lit(4.0).alias("bytes_per_token"))


def _framed(spark, sf_dir):
    return frames_of(event_tokens(spark, sf_dir))


def _sized(spark, sf_dir, *shapes):
    framed = _framed(spark, sf_dir)
    sizes = wire.frame_sizes(F.col("ids"), F.col("done"), F.col("finish_reason"))
    return framed.select("stream_id", "frame_seq", F.size("ids").alias("n_ids"), *[sizes[s].cast("long").alias(s) for s in shapes or sizes])


def frame_sizes_msgpack(spark, sf_dir):
    return _sized(spark, sf_dir, "current", "short_keys", "int_keys", "int_keys_sparse", "positional", "varint_bin", "varint_delta")


def frame_sizes_protobuf(spark, sf_dir):
    return _sized(spark, sf_dir, "protobuf", "protobuf_always_done")


def frame_shape_compare(spark, sf_dir):
    sized = _sized(spark, sf_dir)
    shapes = [c for c in sized.columns if c not in ("stream_id", "frame_seq", "n_ids")]
    sums = sized.agg(F.sum("n_ids").alias("n"), *[F.sum(s).alias(s) for s in shapes])
    long = sums.select("n", F.explode(F.array(*[F.struct(F.lit(s).alias("shape"), F.col(s).alias("total_bytes")) for s in shapes])).alias("x"))
    return long.select("x.shape", "x.total_bytes", F.round(F.col("x.total_bytes") / F.col("n"), 6).alias("bytes_per_token"))


def msgpack_frame_hex(spark, sf_dir):
    return _framed(spark, sf_dir).select("stream_id", "frame_seq", wire.msgpack_frame_hex(F.col("ids"), F.col("done"), F.col("finish_reason")).alias("frame_hex"))


def protobuf_frame_hex(spark, sf_dir):
    args = F.col("ids"), F.col("done"), F.col("finish_reason")
    return _framed(spark, sf_dir).select("stream_id", "frame_seq", wire.protobuf_frame_hex(*args).alias("frame_hex"), wire.protobuf_frame_hex(*args, always_done=True).alias("always_done_hex"))


def typed_frame_hex(spark, sf_dir):
    payload = F.unhex(wire.packed_ids_hex(F.col("ids")))
    return _framed(spark, sf_dir).select("stream_id", "frame_seq", wire.typed_frame_hex(F.lit(2), payload).alias("frame_hex"))


def uint32_pack_hex(spark, sf_dir):
    return _framed(spark, sf_dir).select("stream_id", "frame_seq", wire.packed_ids_hex(F.col("ids")).alias("packed_hex"))


def uint32_unpack(spark, sf_dir):
    packed = _framed(spark, sf_dir).select("stream_id", "frame_seq", wire.packed_ids_hex(F.col("ids")).alias("p"))
    return packed.select("stream_id", "frame_seq", joined(wire.unpack_ids(F.col("p"))).alias("ids"))


def json_frame_bytes(spark, sf_dir):
    frame = F.to_json(F.struct("ids", "done"))
    return _framed(spark, sf_dir).groupBy("stream_id").agg(
        F.sum(F.octet_length(frame)).alias("json_bytes"), F.sum(F.octet_length(F.concat(F.lit("data: "), frame, F.lit("\n\n")))).alias("sse_bytes")
    )


def varint_hex(spark, sf_dir):
    return line_tokens(spark, sf_dir).select(F.col("id")).distinct().select("id", wire.varint_hex(F.col("id")).alias("varint"), wire.varint_hex(wire.zigzag(-F.col("id"))).alias("negative"))


def delta_encode(spark, sf_dir):
    return delta.encode_tokens(line_tokens(spark, sf_dir)).select("stream_id", "pos", "delta")


def delta_decode_roundtrip(spark, sf_dir):
    both = delta.decode_tokens(delta.encode_tokens(line_tokens(spark, sf_dir)))
    return both.groupBy("stream_id").agg(F.count("*").alias("n_ids"), F.count_if(F.col("decoded") == F.col("id")).alias("n_equal"))


def delta_frame_bases(spark, sf_dir):
    coded = delta.decode(delta.encode(_framed(spark, sf_dir)).select("stream_id", "frame_seq", "base_id", "ids_delta"))
    return coded.select("stream_id", "frame_seq", "base_id", joined(F.col("ids_delta")).alias("ids_delta"), joined(F.col("ids")).alias("ids"))


def xorshift_stream(spark, sf_dir):
    """32-bit xorshift numbers, one stream a nation, 16 steps each."""
    mask = F.lit(0xFFFFFFFF)

    def step(s, _):
        x = F.element_at(s, -1)
        x = x.bitwiseXOR(F.shiftleft(x, 13).bitwiseAND(mask))
        x = x.bitwiseXOR(F.shiftright(x, 17))
        x = x.bitwiseXOR(F.shiftleft(x, 5).bitwiseAND(mask))
        return F.concat(s, F.array(x))

    seed = (F.col("n_nationkey").cast("long") * 2654435761 + 1).bitwiseAND(mask)
    out = F.aggregate(F.sequence(F.lit(1), F.lit(16)), F.array(seed), step)
    return read(spark, sf_dir, "nation").select("n_nationkey", joined(F.transform(F.slice(out, 2, 16), lambda x: x % 50000)).alias("ids"))


_REGIONS = """
marked AS (SELECT *, CASE WHEN id = {s} THEN 's' WHEN id = {e} THEN 'e' END AS m FROM tok),
seen AS (SELECT *, coalesce(last_value(m IGNORE NULLS) OVER (PARTITION BY stream_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) = 's', false) AS inside FROM marked),
told AS (SELECT *, coalesce(m = 's' AND NOT inside, false) AS opens, coalesce(m = 'e' AND inside, false) AS closes, coalesce(m = 's' AND inside, false) AS nested,
  inside AND m IS NULL AS body, NOT inside AND coalesce(m, '') <> 's' AS pass FROM seen),
numbered AS (SELECT *, sum(opens::INT) OVER (PARTITION BY stream_id ORDER BY pos) AS region FROM told),
bodies AS (SELECT *, row_number() OVER (PARTITION BY stream_id, region ORDER BY pos) AS rn FROM numbered WHERE body),
held AS (SELECT stream_id, region, list(id ORDER BY pos) FILTER (rn <= {cap}) AS ids, count(*) AS n FROM bodies GROUP BY ALL),
opened AS (SELECT o.stream_id, o.region, coalesce(ids, []) AS ids, coalesce(n, 0) AS n FROM (SELECT stream_id, region FROM numbered WHERE opens) o LEFT JOIN held USING (stream_id, region)),
closed AS (SELECT stream_id, region, pos AS "at" FROM numbered WHERE closes),
events_ AS (
  SELECT stream_id, min(pos) AS "at", 'passthrough' AS kind, list(id ORDER BY pos) AS ids, NULL::VARCHAR AS finish_reason FROM numbered WHERE pass GROUP BY stream_id, frame_seq, region
  UNION ALL SELECT stream_id, "at", 'region', ids, NULL FROM opened JOIN closed USING (stream_id, region) WHERE n <= {cap}
  UNION ALL SELECT stream_id, pos, 'nested_start', [id], NULL FROM numbered WHERE nested
  UNION ALL SELECT b.stream_id, b.pos, 'overflow', o.ids, NULL FROM bodies b JOIN opened o USING (stream_id, region) WHERE rn = {cap} + 1
  UNION ALL SELECT o.stream_id, e.length, 'truncated', o.ids, CASE WHEN o.stream_id % 2 = 0 THEN 'stop' ELSE 'length' END
    FROM opened o ANTI JOIN closed c USING (stream_id, region) JOIN (SELECT stream_id, count(*) AS length FROM tok GROUP BY ALL) e USING (stream_id))"""


def _regions(select: str, cap: int) -> str:
    return f"WITH {EVENT_TOKENS_SQL}, {_REGIONS.format(s=START, e=END, cap=cap)} {select}"


_ALL = 'SELECT stream_id, "at", kind, array_to_string(ids, chr(44)) AS ids, finish_reason FROM events_'
_MP = "CASE WHEN {0} < 128 THEN 1 WHEN {0} < 256 THEN 2 WHEN {0} < 65536 THEN 3 WHEN {0} < 4294967296 THEN 5 ELSE 9 END"
_VAR = "CASE WHEN {0} < 128 THEN 1 WHEN {0} < 16384 THEN 2 WHEN {0} < 2097152 THEN 3 WHEN {0} < 268435456 THEN 4 ELSE 5 END"
_BIN = "({0} + CASE WHEN {0} < 256 THEN 2 WHEN {0} < 65536 THEN 3 ELSE 5 END)"
_SIZES = f"""WITH {EVENT_TOKENS_SQL},
parts AS (
  SELECT stream_id, frame_seq, len(ids) AS n_ids, CASE WHEN done THEN 1 ELSE 0 END AS t, finish_reason IS NOT NULL AS has, coalesce(strlen(finish_reason), 0) AS w,
    CASE WHEN len(ids) < 16 THEN 1 WHEN len(ids) < 65536 THEN 3 ELSE 5 END + coalesce(list_sum(list_transform(ids, lambda i: {_MP.format('i')})), 0) AS arr,
    coalesce(list_sum(list_transform(ids, lambda i: {_VAR.format('i')})), 0) AS var,
    coalesce(list_sum(list_transform(list_zip(ids[2:], ids[:-2]), lambda p: {_VAR.format('(CASE WHEN p[1] >= p[2] THEN 2 * (p[1] - p[2]) ELSE 2 * (p[2] - p[1]) - 1 END)')})), 0) AS del,
    CASE WHEN len(ids) > 0 THEN 1 + {_MP.format('ids[1]')} ELSE 0 END AS base
  FROM frames),
sized AS (
  SELECT stream_id, frame_seq, n_ids,
    11 + arr + CASE WHEN has THEN 14 + 1 + w ELSE 0 END AS current, 6 + arr + CASE WHEN has THEN 2 + 1 + w ELSE 0 END AS short_keys,
    4 + arr + CASE WHEN has THEN 1 + 1 + w ELSE 0 END AS int_keys, 2 + arr + 2 * t + CASE WHEN has THEN 1 + 1 + w ELSE 0 END AS int_keys_sparse,
    2 + arr + CASE WHEN has THEN 1 + w ELSE 0 END AS "positional", 2 + {_BIN.format('var')} + 2 * t + CASE WHEN has THEN 2 + w ELSE 0 END AS varint_bin,
    1 + base + CASE WHEN n_ids > 1 THEN 1 + {_BIN.format('del')} ELSE 0 END + 2 * t + CASE WHEN has THEN 2 + w ELSE 0 END AS varint_delta,
    4 + CASE WHEN n_ids > 0 THEN 1 + {_VAR.format('var')} + var ELSE 0 END + 2 * t + CASE WHEN w > 0 THEN 2 + w ELSE 0 END AS protobuf,
    4 + CASE WHEN n_ids > 0 THEN 1 + {_VAR.format('var')} + var ELSE 0 END + 2 + CASE WHEN w > 0 THEN 2 + w ELSE 0 END AS protobuf_always_done
  FROM parts)"""
_SHAPES = ["current", "short_keys", "int_keys", "int_keys_sparse", "positional", "varint_bin", "varint_delta", "protobuf", "protobuf_always_done"]
_H2 = "lpad(hex({0}), 2, '0')"
_MPHEX = f"CASE WHEN i < 128 THEN {_H2.format('i')} WHEN i < 256 THEN 'CC' || {_H2.format('i')} WHEN i < 65536 THEN 'CD' || lpad(hex(i), 4, '0') ELSE 'CE' || lpad(hex(i), 8, '0') END"
_PACKED = "array_to_string(list_transform(ids, lambda i: lpad(hex(i), 8, '0')), '')"
_VARHEX = "array_to_string(list_transform(range(0, {size}), lambda k: lpad(hex(({n} >> (7 * k)) % 128 + CASE WHEN k < {size} - 1 THEN 128 ELSE 0 END), 2, '0')), '')"


def _varhex(n: str) -> str:
    return _VARHEX.format(n=n, size=f"({_VAR.format(n)})")


_LINES = "tok AS (SELECT l_orderkey AS stream_id, l_linenumber::BIGINT AS pos, l_partkey AS id FROM lineitem)"
_ZZ = "CASE WHEN {0} >= 0 THEN 2 * ({0}) ELSE -2 * ({0}) - 1 END"

QUERIES = {
    f.__name__: f
    for f in (region_events, region_bodies, region_stats, region_overflow_cap, stream_stats, frame_sizes_msgpack, frame_sizes_protobuf, frame_shape_compare,
              msgpack_frame_hex, protobuf_frame_hex, typed_frame_hex, uint32_pack_hex, uint32_unpack, json_frame_bytes, varint_hex, delta_encode,
              delta_decode_roundtrip, delta_frame_bases, xorshift_stream)
}
ORACLES = {
    "region_events": _regions(_ALL, 65536),
    "region_overflow_cap": _regions(_ALL, 3),
    "region_bodies": _regions("SELECT stream_id, \"at\", len(ids)::INT AS n_ids, array_to_string(ids, ',') AS ids FROM events_ WHERE kind = 'region'", 65536),
    "region_stats": _regions("SELECT kind, count(*) AS n_events, count(DISTINCT stream_id) AS n_streams FROM events_ GROUP BY kind", 65536),
    "stream_stats": f"WITH {_LINES} SELECT stream_id, count(*) AS token_count, 4 * count(*) AS byte_count, 4.0::DOUBLE AS bytes_per_token FROM tok GROUP BY stream_id",
    "frame_sizes_msgpack": _SIZES + f" SELECT stream_id, frame_seq, n_ids::INT AS n_ids, {', '.join(f'"{s}"::BIGINT AS "{s}"' for s in _SHAPES[:7])} FROM sized",
    "frame_sizes_protobuf": _SIZES + f" SELECT stream_id, frame_seq, n_ids::INT AS n_ids, {', '.join(f'"{s}"::BIGINT AS "{s}"' for s in _SHAPES[7:])} FROM sized",
    "frame_shape_compare": _SIZES + " SELECT shape, total_bytes, round(total_bytes / n, 6) AS bytes_per_token FROM (" + " UNION ALL ".join(f"SELECT '{s}' AS shape, sum(\"{s}\")::BIGINT AS total_bytes, sum(n_ids) AS n FROM sized" for s in _SHAPES) + ")",
    "msgpack_frame_hex": f"""WITH {EVENT_TOKENS_SQL} SELECT stream_id, frame_seq, CASE WHEN finish_reason IS NULL THEN '82' ELSE '83' END || 'A3696473' ||
      CASE WHEN len(ids) < 16 THEN {_H2.format('len(ids) + 144')} ELSE 'DC' || lpad(hex(len(ids)), 4, '0') END || array_to_string(list_transform(ids, lambda i: {_MPHEX}), '') ||
      'A4646F6E65' || CASE WHEN done THEN 'C3' ELSE 'C2' END || CASE WHEN finish_reason IS NULL THEN '' ELSE 'AD' || hex('finish_reason') || {_H2.format('strlen(finish_reason) + 160')} || hex(finish_reason) END AS frame_hex FROM frames""",
    "protobuf_frame_hex": f"""WITH {EVENT_TOKENS_SQL}, p AS (SELECT *, array_to_string(list_transform(ids, lambda i: {_varhex('i')}), '') AS ph FROM frames),
      b AS (SELECT stream_id, frame_seq, done, '0A' || {_varhex('(len(ph) // 2)')} || ph AS one, CASE WHEN finish_reason IS NULL THEN '' ELSE '1A' || {_H2.format('strlen(finish_reason)')} || hex(finish_reason) END AS three FROM p),
      c AS (SELECT stream_id, frame_seq, one || CASE WHEN done THEN '1001' ELSE '' END || three AS x, one || CASE WHEN done THEN '1001' ELSE '1000' END || three AS y FROM b)
      SELECT stream_id, frame_seq, lpad(hex(len(x) // 2), 8, '0') || x AS frame_hex, lpad(hex(len(y) // 2), 8, '0') || y AS always_done_hex FROM c""",
    "typed_frame_hex": f"WITH {EVENT_TOKENS_SQL} SELECT stream_id, frame_seq, '02' || lpad(hex(4 * len(ids)), 8, '0') || {_PACKED} AS frame_hex FROM frames",
    "uint32_pack_hex": f"WITH {EVENT_TOKENS_SQL} SELECT stream_id, frame_seq, {_PACKED} AS packed_hex FROM frames",
    "uint32_unpack": f"WITH {EVENT_TOKENS_SQL} SELECT stream_id, frame_seq, array_to_string(ids, ',') AS ids FROM frames",
    "json_frame_bytes": f"""WITH {EVENT_TOKENS_SQL}, j AS (SELECT stream_id, strlen('{{"ids":[' || array_to_string(ids, ',') || '],"done":' || CASE WHEN done THEN 'true' ELSE 'false' END || '}}') AS n FROM frames)
      SELECT stream_id, sum(n)::BIGINT AS json_bytes, sum(n + 8)::BIGINT AS sse_bytes FROM j GROUP BY stream_id""",
    "varint_hex": f"SELECT id, {_varhex('id')} AS varint, {_varhex('(CASE WHEN id = 0 THEN 0 ELSE 2 * id - 1 END)')} AS negative FROM (SELECT DISTINCT l_partkey AS id FROM lineitem)",
    "delta_encode": f"WITH {_LINES} SELECT stream_id, pos, {_ZZ.format('d')} AS delta FROM (SELECT *, id - coalesce(lag(id) OVER (PARTITION BY stream_id ORDER BY pos, id), 0) AS d FROM tok)",
    "delta_decode_roundtrip": f"WITH {_LINES} SELECT stream_id, count(*) AS n_ids, count(*) AS n_equal FROM tok GROUP BY stream_id",
    "delta_frame_bases": f"""WITH {EVENT_TOKENS_SQL}, b AS (SELECT *, coalesce(lag(ids[-1]) OVER (PARTITION BY stream_id ORDER BY frame_seq), 0) AS base_id FROM frames)
      SELECT stream_id, frame_seq, base_id, array_to_string(list_transform(list_zip(ids, list_concat([base_id], ids[:-2])), lambda p: {_ZZ.format('(p[1] - p[2])')}), ',') AS ids_delta, array_to_string(ids, ',') AS ids FROM b""",
    "xorshift_stream": """WITH RECURSIVE s AS (SELECT n_nationkey, 0 AS k, (n_nationkey::BIGINT * 2654435761 + 1) & 4294967295 AS x FROM nation
      UNION ALL SELECT n_nationkey, k + 1, xor(c, (c * 32) & 4294967295) FROM (SELECT n_nationkey, k, xor(b, b >> 17) AS c FROM (SELECT n_nationkey, k, xor(x, (x * 8192) & 4294967295) AS b FROM s WHERE k < 16)))
      SELECT n_nationkey, string_agg((x % 50000)::VARCHAR, ',' ORDER BY k) AS ids FROM s WHERE k > 0 GROUP BY n_nationkey""",
}
