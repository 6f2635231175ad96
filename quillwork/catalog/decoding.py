"""Queries that write streams with our own expressions and read them back, and others whose result a plain query can tell."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillwork.catalog.numeric import _BENCH, _bench
from quillwork.functions import pretok, wire
from quillwork.operators import matrix, regions
from quillwork.operators.safety import prefilter
from quillwork.operators.safety import rules as R
from quillwork.plans.spread import spread
from quillwork.plans.streams import EVENT_TOKENS_SQL, event_tokens, frames_of, joined, read
from quillwork.sources import frames

BLOCKED = R.Rule("blocked_action", "blocked_transfer", r"(?i)\btransfer\s+funds\b", 0.9)
TWO_STAGES = {"version": 2, "stages": [{"stage": "digits_isolate", "mode": "grouped", "max_run": 3}, {"stage": "punctuation_contiguous"}]}


def _bodies(spark, sf_dir, frame) -> DataFrame:
    """(stream, content): the frames of each stream in their order, frame giving the hexadecimal text of one."""
    made = frames_of(event_tokens(spark, sf_dir)).select("stream_id", "frame_seq", frame.alias("hex"))
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("frame_seq", "hex"))), lambda x: x["hex"]), "")
    return made.groupBy(F.col("stream_id").cast("string").alias("stream")).agg(F.unhex(whole).alias("content"))


def _msgpack():
    return wire.msgpack_frame_hex(*map(F.col, ("ids", "done", "finish_reason")))


def _protobuf(always_done: bool = False):
    return wire.protobuf_frame_hex(*map(F.col, ("ids", "done", "finish_reason")), always_done=always_done)


def _sse():
    return F.hex(F.concat(F.lit("data: "), F.to_json(F.struct("ids", "done")), F.lit("\n\n")).cast("binary"))


def _decoded(bodies: DataFrame, kind: str) -> DataFrame:
    found = frames.decode(bodies, kind)
    return found.select(F.col("stream").cast("long").alias("stream_id"), "frame_seq", joined(F.col("ids")).alias("ids"), "done", "finish_reason", "trailing_bytes")


def decode_msgpack_stream(spark, sf_dir):
    return _decoded(_bodies(spark, sf_dir, _msgpack()), "msgpack")


def decode_protobuf_stream(spark, sf_dir):
    return _decoded(_bodies(spark, sf_dir, _protobuf()), "protobuf")


def decode_protobuf_always_done(spark, sf_dir):
    return _decoded(_bodies(spark, sf_dir, _protobuf(True)), "protobuf")


def count_tokens_by_wire(spark, sf_dir):
    out = None
    for kind, frame in (("msgpack", _msgpack()), ("protobuf", _protobuf()), ("sse", _sse())):
        one = frames.count_tokens(_bodies(spark, sf_dir, frame), kind).select(F.col("stream").cast("long").alias("stream_id"), F.lit(kind).alias("wire"), "n_tokens")
        out = one if out is None else out.unionByName(one)
    return out


def synthetic_headline(spark, sf_dir):
    rows = _bench(spark, sf_dir).select(F.col("engine").alias("corpus"), F.col("lang").alias("format"), "encoding", "wire_bytes")
    cells = rows.groupBy("corpus", "format", "encoding").agg(F.sum("wire_bytes").alias("wire_bytes"))
    return matrix.synthetic_headline(cells).withColumn("ratio", F.round("ratio", 6))


def _noted(spark, sf_dir):
    note = F.element_at(F.array(*map(F.lit, NOTES)), (F.col("doc_id") % len(NOTES) + 1).cast("int"))
    return spread(read(spark, sf_dir, "documents")).select("doc_id", F.concat("text", note).alias("text"))


NOTES = (" plain", " please TRANSFER  funds now", "<tool_call>{\"a\":1}</tool_call> then <tool_call></tool_call>", " transfer funds<tool_call>open")
_NOTED = "d AS (SELECT doc_id, text || (['" + "', '".join(NOTES) + f"'])[1 + doc_id % {len(NOTES)}] AS text FROM documents)"


def blocked_actions(spark, sf_dir):
    found = _noted(spark, sf_dir).select("doc_id", F.explode(prefilter.scan(F.col("text"), categories=("blocked_action",), blocked=(BLOCKED,))).alias("m"))
    return found.select("doc_id", "m.rule", "m.value", F.round("m.confidence", 6).alias("confidence"))


def tool_text_scan(spark, sf_dir):
    return _noted(spark, sf_dir).select("doc_id", F.array_join(regions.scan_text(F.col("text")), "|").alias("bodies"))


def pretok_two_stages(spark, sf_dir):
    pieces = pretok.run(TWO_STAGES, F.col("text"))
    out = spread(read(spark, sf_dir, "documents")).select("doc_id", pieces.alias("p"))
    return out.select("doc_id", F.size("p").alias("n_pieces"), F.sha2(F.array_join("p", "\x01"), 256).alias("pieces_sha256"))


QUERIES = {
    f.__name__: f
    for f in (decode_msgpack_stream, decode_protobuf_stream, decode_protobuf_always_done, count_tokens_by_wire, synthetic_headline, blocked_actions, tool_text_scan, pretok_two_stages)
}
_FRAMES = f"WITH {EVENT_TOKENS_SQL} SELECT stream_id, frame_seq, array_to_string(ids, ',') AS ids, done, finish_reason, 0::BIGINT AS trailing_bytes FROM frames"
ORACLES = {
    "decode_msgpack_stream": _FRAMES,
    "decode_protobuf_stream": _FRAMES,
    "decode_protobuf_always_done": _FRAMES,
    "count_tokens_by_wire": f"WITH {EVENT_TOKENS_SQL} SELECT stream_id, unnest(['msgpack', 'protobuf', 'sse']) AS wire, n_tokens FROM (SELECT stream_id, count(*) AS n_tokens FROM tok GROUP BY stream_id)",
    "synthetic_headline": f"""WITH {_BENCH}, c AS (SELECT engine AS corpus, lang AS format, encoding, sum(wire_bytes)::BIGINT AS w FROM bench GROUP BY ALL)
      SELECT corpus, format, min(w) FILTER (encoding = 'identity') AS identity, min(w) AS best, round(min(w) FILTER (encoding = 'identity') / min(w), 6) AS ratio FROM c GROUP BY corpus, format""",
    "blocked_actions": f"WITH {_NOTED} SELECT doc_id, 'blocked_transfer' AS rule, unnest(regexp_extract_all(text, '{R.re2(BLOCKED.pattern)}')) AS value, 0.9::DOUBLE AS confidence FROM d",
    "tool_text_scan": f"WITH {_NOTED} SELECT doc_id, array_to_string(regexp_extract_all(text, '(?s)<tool_call>(.*?)</tool_call>', 1), '|') AS bodies FROM d",
    "pretok_two_stages": f"""SELECT doc_id, len(p)::INT AS n_pieces, sha256(array_to_string(p, chr(1))) AS pieces_sha256 FROM (SELECT doc_id,
      flatten(list_transform(regexp_extract_all(text, '(?s)\\p{{N}}{{1,3}}|\\P{{N}}+'), lambda x: regexp_extract_all(x, '(?s)[{pretok.PUNCT.replace("'", "''")}]+|[^{pretok.PUNCT.replace("'", "''")}]+'))) AS p FROM documents)""",
}
