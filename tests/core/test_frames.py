import pytest
from pyspark.sql import functions as F

from quillwork.functions import wire
from quillwork.sources import frames

ROWS = [(1, [9707], False, None), (2, [1], False, None), (3, [], True, "stop"), (4, list(range(0, 70000, 997)) + [2**32 - 1], True, None), (5, [127, 128, 255, 256, 65535, 65536], False, "length"), (6, list(range(20)), True, "é")]


def hexes(spark):
    df = spark.createDataFrame(ROWS, "n int, ids array<bigint>, done boolean, reason string")
    args = F.col("ids"), F.col("done"), F.col("reason")
    sizes = wire.frame_sizes(*args)
    return df.select("n", "ids", "done", "reason", wire.msgpack_frame_hex(*args).alias("m"), wire.protobuf_frame_hex(*args).alias("p"), wire.protobuf_frame_hex(*args, always_done=True).alias("a"), *[v.alias(f"s_{k}") for k, v in sizes.items()]).collect()


def test_bytes_sizes_and_decoding(spark):
    got = {r.n: r for r in hexes(spark)}
    assert got[1].m == "82A369647391CD25EBA4646F6E65C2"
    assert (got[2].p, got[2].a) == ("000000030A0101", "000000050A01011000")
    for r in got.values():
        for text, read in ((r.m, frames.msgpack_frames), (r.p, frames.protobuf_frames), (r.a, frames.protobuf_frames)):
            (frame,), left = read(bytes.fromhex(text))
            assert (frame.ids, frame.done, frame.finish_reason, left) == (list(r.ids), r.done, r.reason, 0)
        assert (r.s_current, r.s_protobuf, r.s_protobuf_always_done) == (len(r.m) // 2, len(r.p) // 2, len(r.a) // 2)


def test_streams_end_at_done_or_inside_a_frame(spark):
    got = {r.n: r for r in hexes(spark)}
    whole = bytes.fromhex(got[1].m + got[3].m + got[2].m)
    found, _ = frames.msgpack_frames(whole)
    assert [f.done for f in found] == [False, True]
    assert frames.msgpack_frames(bytes.fromhex(got[1].m)[:-1])[1] == len(got[1].m) // 2 - 1
    with pytest.raises(ValueError):
        frames.protobuf_frames(bytes.fromhex(got[2].p)[:-1])
    assert frames.protobuf_frame(bytes.fromhex("210000000000000000" + "0A020102" + "2D00000000" + "2201FF")).ids == [1, 2]
    with pytest.raises(ValueError):
        frames.protobuf_frame(b"\x0b")
    with pytest.raises(ValueError):
        frames.msgpack_value(b"\x91" * 70 + b"\x00", 0)
    assert frames.typed_frames(b"\x02\x00\x00\x00\x01a" + b"\x03\x00\x00\x00\x05b") == [(2, b"a")]


def test_source_and_counts(spark, tmp_path):
    got = {r.n: r for r in hexes(spark)}
    (tmp_path / "one.bin").write_bytes(bytes.fromhex(got[1].m + got[4].m))
    (tmp_path / "two.bin").write_bytes(bytes.fromhex(got[5].m + got[3].m))
    frames.register(spark)
    direct = spark.read.format("frames").option("wire", "msgpack").load(str(tmp_path)).drop("stream")
    files = frames.read_files(spark, f"file://{tmp_path}", "msgpack").drop("stream")
    assert sorted(map(str, direct.collect())) == sorted(map(str, files.collect())) and files.count() == 4
    bodies = spark.createDataFrame([("a", bytearray(b'data: {"ids":[1,2],"done":false}\n\ndata: {"ids":[3],"done":true}\n\n'))], "stream string, content binary")
    assert frames.count_tokens(bodies, "sse").first().n_tokens == 3
    with pytest.raises(ValueError):
        frames.decode(bodies, "xml")
