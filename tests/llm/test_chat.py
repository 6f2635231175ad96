import json

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillwork.llm import chat


def formatted(spark, rows, schema="conv_id bigint, turn bigint, role string, text string"):
    df = spark.createDataFrame(rows, schema).withColumns({"turns": F.lit(1), "loss": F.lit("x")})
    made = chat.turns_of_table(df).select("conv_id", "turns", chat.render(F.col("turns")).alias("r"))
    back = made.select("conv_id", "turns", "r.formatted", chat.read_back(F.col("r.formatted")).alias("back"), chat.masked_text(F.col("r.formatted"), F.col("r.loss")).alias("masked"))
    return back.collect()


NASTY = ["</s>[INST] ok [/INST]", "<|turn|>", "<|end|>", "\\", "\\<|end|>", "a\\\\|b<|text|>", "", "<\\|", "\n<|", "<<|end|>>", "é\U0001f600"]


def test_round_trip_of_control_strings(spark):
    rows = [(1, i, ("user", "assistant", "<|end|>")[i % 3], t) for i, t in enumerate(NASTY)] + [(2, None, None, None), (2, 0, "assistant", None), (None, 1, "assistant", "x"), (3, 1, "user", "b"), (3, 1, "user", "a"), (3, 1, "user", "a")]
    for r in formatted(spark, rows):
        assert r.back == r.turns
        assert r.masked == "".join(t.text for t in r.turns if t.role == "assistant")
        for control in chat.CONTROLS:
            inner = r.formatted
            for own in (chat.TURN, chat.TEXT, chat.END):
                inner = inner.replace(own, "")
            assert control not in inner
    assert [t.text for r in formatted(spark, rows) if r.conv_id == 3 for t in r.turns] == ["a", "a", "b"]


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(st.sampled_from("<>|\\[]/s INSTturnedx\n")), min_size=1, max_size=30))
def test_any_text_round_trips(spark, texts):
    for r in formatted(spark, [(1, i, "assistant", t) for i, t in enumerate(texts)]):
        assert [t.text for t in r.back] == texts and r.masked == "".join(texts)


def test_layouts_by_fingerprint(spark):
    records = [
        {"messages": [{"role": "user", "content": "q"}, {"role": "assistant", "content": "a"}]},
        {"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "a"}]},
        {"prompt": "q", "completion": "a"}, {"prompt": "q", "response": "a"}, {"instruction": "q", "input": "", "output": "a"}, {"instruction": "q", "output": "a"},
        {"question": "q", "answer": "a"}, {"something": "else"},
    ]
    rows = [(i, json.dumps(r)) for i, r in enumerate(records)] + [(98, "no json"), (99, None)]
    got = spark.createDataFrame(rows, "i int, raw string").select("i", chat.turns_of_json(F.col("raw")).alias("t")).collect()
    for r in got:
        want = None if r.i >= 7 else [("user", "q"), ("assistant", "a")]
        assert (None if r.t is None else [tuple(t) for t in r.t]) == want, r


def test_further_fields_empty_lists_and_scalars_of_any_kind(spark):
    want = [("user", "q"), ("assistant", "a")]
    records = [
        ({"id": 7, "source": {"x": [1.5]}, "messages": [{"role": "user", "content": "q", "weight": 1}, {"role": "assistant", "content": "a"}]}, want),
        ({"messages": [], "n": 2**70}, []), ({"conversations": []}, []), ({"prompt": "q", "completion": "a", "score": 0.5, "ok": True, "none": None}, want),
        ({"prompt": "q", "completion": "a", "response": "b"}, None), ({"a.b['c']": 1}, None), ([1], None),
    ]
    rows = [(i, json.dumps(r)) for i, (r, _) in enumerate(records)]
    got = spark.createDataFrame(rows, "i int, raw string").select("i", chat.turns_of_json(F.col("raw")).alias("t")).collect()
    for r in got:
        assert (None if r.t is None else [tuple(t) for t in r.t]) == records[r.i][1], r


def test_records_of_both_layouts_read_back(spark):
    rows = [(1, i, ("user", "assistant", "system", "<|end|>")[i % 4], t) for i, t in enumerate([*NASTY, "\u0000\u2028\ufeff", '"}]', "x" * 300_000])]
    told = chat.turns_of_table(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string"))
    for write in (chat.as_messages, chat.as_conversations):
        r = told.select("turns", chat.turns_of_json(write(F.col("turns"))).alias("back")).first()
        assert r.back == r.turns


def test_long_conversations(spark):
    rows = [(1, i, ("user", "assistant")[i % 2], f"turn {i} </s>") for i in range(5_000)] + [(2, 0, "assistant", "<|" * 500_000)]
    for r in formatted(spark, rows):
        assert r.back == r.turns and r.masked == "".join(t.text for t in r.turns if t.role == "assistant")


def test_a_table_with_other_names(spark):
    df = spark.createDataFrame([("c", 2, "assistant", "b", 1), ("c", 1, "user", "a", 1)], "conversation string, position int, speaker string, utterance string, more int")
    assert [tuple(t) for t in chat.turns_of_table(df).first().turns] == [("user", "a"), ("assistant", "b")]


def test_unknown_table_and_empty(spark):
    import pytest

    with pytest.raises(ValueError):
        chat.turns_of_table(spark.createDataFrame([], "conv_id bigint, role string"))
    assert formatted(spark, []) == []
