import numpy as np
from pyspark.sql import functions as F

from quillwork.operators import latents as L


def test_against_numpy(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in rng.normal(size=12).astype(np.float32) * np.float32(10.0 ** (i % 7 - 3))]) for i in range(40)] + [(40, [0.0] * 12)]
    df = spark.createDataFrame(rows, "i int, x array<float>").withColumn("s", L.scales(F.col("x"), 3))
    df = df.select("i", "x", "s", L.quantize(F.col("x"), F.col("s"), 127, 3).alias("q"), L.quantize(F.col("x"), F.col("s"), 7, 3).alias("q4"), L.typed_bytes(F.col("x"), "fp16").alias("b"))
    df = df.select("*", L.dequantize(F.col("q"), F.col("s"), 127, 3).alias("y"), L.pack4(F.col("q4")).alias("p"), L.from_bytes(F.col("b"), "fp16").alias("h"))
    for r in df.select("*", L.unpack4(F.col("p"), F.lit(12)).alias("u"), L.unpack4(F.col("p"), F.lit(9)).alias("bad")).collect():
        x = np.array(r.x, np.float32).reshape(3, 4)
        s = np.abs(x).max(1).astype(np.float16).astype(np.float32)
        assert np.array_equal(np.array(r.s, np.float32), s)
        safe = np.where(s == 0, 1, s)[:, None]
        q = np.where(s[:, None] == 0, 0, np.clip(np.rint((x / safe).astype(np.float32) * np.float32(127)), -127, 127)).astype(int)
        assert list(r.q) == q.ravel().tolist()
        assert np.allclose(np.array(r.y), (q * s[:, None] / 127).ravel(), rtol=1e-6)
        assert list(r.u) == list(r.q4) and r.bad is None and max(map(abs, r.q4)) <= 7
        assert np.array_equal(np.array(r.h, np.float32), x.ravel().astype(np.float16).astype(np.float32))


def test_half_edges(spark):
    values = [0.0, 1e-9, 6e-8, 2.0**-14, 65504.0, 65519.0, 65520.0, 0.1, -0.3, 2049.0, 2051.0]
    got = spark.createDataFrame([(v,) for v in values], "v double").select(L.half(F.col("v")).alias("h")).collect()
    with np.errstate(over="ignore"):
        assert [r.h for r in got] == [float(np.float16(v)) for v in values]


def test_packing_and_deltas(spark):
    one = spark.createDataFrame([([7, -7, -1],)], "q array<int>").select(L.pack4(F.col("q")).alias("p")).first().p
    assert one == "970F"
    rows = [(0, 0, [1.0, 2.0], True), (0, 1, [-2.0, 2.0], False), (0, 2, [0.5, 4.0], True), (0, 3, [0.5, -4.0], False)]
    coded = L.delta_encode(spark.createDataFrame(rows, "stream int, seq int, x array<float>, keyframe boolean"), 127, 1)
    back = L.delta_decode(coded.select("stream", "seq", "keyframe", "scales", "data"), 127, 1).orderBy("seq").collect()
    full = {r.seq: list(r.q) for r in coded.collect()}
    assert all(list(r.q) == full[r.seq] or max(abs(a - b) for a, b in zip(r.q, full[r.seq])) > 0 for r in back)
    assert list(back[3].q)[0] == full[3][0]
    bad = spark.createDataFrame([(0, 0, [1.0], False), (0, 0, [1.0, 2.0], True)], "stream int, seq int, x array<float>, keyframe boolean")
    assert sorted(str(r.error) for r in L.check_frames(bad, 2, True).collect()) in (["first frame must be a keyframe", "seq"], ["None", "seq"])
