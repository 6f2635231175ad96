import pytest
from pyspark.sql import functions as F

from quillwork.functions import pretok
from quillwork.operators import guards, maps, synthetic


def test_patterns_compile_to_programs():
    gpt2 = r"""'(?:s|t|re|ve|m|ll|d)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
    assert maps.compile_pattern(gpt2) == pretok.GPT2["ops"]
    qwen = r"""(?i:'s|'t|'re|'ve|'m|'ll|'d)|[^\r\n\p{L}\p{N}]?\p{L}+|\p{N}| ?[^\s\p{L}\p{N}]+[\r\n]*|\s*[\r\n]+|\s+(?!\S)|\s+"""
    assert maps.compile_pattern(qwen) == pretok.QWEN["ops"]
    old = r"""'s|'t|'re| ?\p{L}+|\p{N}{1,3}|\s+"""
    assert maps.compile_pattern(old)[0] == {"op": "literals", "patterns": ["'s", "'t", "'re"]} and maps.compile_pattern(old)[2]["max_run"] == 3
    with pytest.raises(ValueError):
        maps.compile_pattern(r"\w+|\d")


def test_tool_calling_markers_are_promoted():
    special: dict[str, int] = {}
    got = maps.tool_calling("... <tool_call> ...", {"<tool_call>": 5, "</tool_call>": 6}, special)
    assert got["convention"] == "qwen25" and special == {"<tool_call>": 5, "</tool_call>": 6}
    assert maps.tool_calling("plain", {}, {}) is None and maps.tool_calling([{"template": "<tool_call>"}], {}, {}) is None


def test_registry_falls_back_by_tier():
    r = guards.Registry()
    for name, tier, why in (("big", 3, "no memory"), ("small", 1, None), ("mid", 2, None)):
        r.register(guards.Classifier(name, tier, lambda c: c, lambda why=why: why))
    assert r.resolve("mid") == (r.listed()[1], None)
    assert r.resolve("big")[0].model_id == "small" and r.resolve("big")[1] == "no memory" and r.resolve("nobody")[0].model_id == "small"
    with pytest.raises(ValueError):
        r.resolve("big", fallback=False)
    with pytest.raises(ValueError):
        r.register(r.listed()[0])
    assert r.unregister("mid") and not r.unregister("mid")


def test_synthetic_streams(spark):
    assert synthetic.stream(spark, "cyclic", 100).agg(F.count_distinct("id")).first()[0] == 10
    cut = synthetic.bursts(synthetic.stream(spark, "uniform", 1000)).orderBy("pos").collect()
    assert all(b.frame_seq - a.frame_seq in (0, 1) for a, b in zip(cut, cut[1:]))
    with pytest.raises(ValueError):
        synthetic.ids("other", F.col("pos"))
