import pytest
from pyspark.sql import functions as F

from quillwork.operators import regions, tokenize
from quillwork.streaming import processors as P

FRAMES = [(1, 0, [0, 90, 3], False, None), (1, 1, [4, 91, 1], True, "stop"), (2, 0, [90, 7], False, None), (2, 1, [8], True, "length"), (3, 0, [5], False, None)]
SCHEMA = "stream_id bigint, frame_seq bigint, ids array<bigint>, done boolean, finish_reason string"


def live(spark, tmp_path, processor, rows, name):
    for k, v in P.ROCKSDB.items():
        spark.conf.set(k, v)
    for seq in sorted({r[1] for r in rows}):  # one micro-batch a file
        spark.createDataFrame([r for r in rows if r[1] == seq], SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = P.run(source, processor).writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination(120)
    return spark.sql(f"SELECT * FROM {name}").collect()


def test_regions_equal_the_batch(spark, tmp_path):
    got = live(spark, tmp_path, P.Regions(90, 91), FRAMES, "live_regions")
    t = spark.createDataFrame(FRAMES, SCHEMA).select("stream_id", "frame_seq", F.posexplode("ids").alias("k", "id")).withColumn("pos", F.col("frame_seq") * 10 + F.col("k")).drop("k")
    ends = spark.createDataFrame([(1, 99, "stop"), (2, 99, "length")], "stream_id bigint, length bigint, finish_reason string")
    want = regions.watch(t, 90, 91, ends=ends).drop("at").collect()
    key = lambda r: (r.stream_id, r.kind, str(r.ids), str(r.finish_reason))
    assert sorted(map(key, got)) == sorted(map(key, want))


def test_unfinished_characters_wait(spark, tmp_path):
    v = tokenize.Vocabulary("bytes", {c: i for i, c in enumerate(tokenize.BYTE_CHARS)})
    raw = list("aé\U0001f600".encode())
    got = live(spark, tmp_path, P.Detokenized(v), [(1, 0, raw[:2], False, None), (1, 1, raw[2:5], False, None), (1, 2, raw[5:], True, "stop")], "live_text")
    assert "".join(r.text for r in got) == "aé\U0001f600"


def test_steps_of_translation_and_keyframes():
    v = tokenize.Vocabulary("bytes", {c: i for i, c in enumerate(tokenize.BYTE_CHARS)})
    p = P.Translated(v, v, lambda text, e: [i for w in text.split(" ") for i in e.piece(w)])
    p.render, p.encoder = tokenize.Detokenizer(v), tokenize.Encoder(v)
    state, out = p.step(None, list(b"ab cd"), False, None)
    assert out == [(list(b"ab"),)] and state[1] == "cd"
    assert p.step(state, list(b"e"), True, None)[1] == [(list(b"cde"),)]
    k = P.Keyframes(10)
    state, out = k.step(None, [5, -5], False, "key")
    assert k.step(state, [9, -2], False, None)[1] == [([10, -7],)]


def test_unknown_state_needs_a_processor():
    with pytest.raises(NotImplementedError):
        P.Framed().step(None, [], False, None)
