import base64
import os
import random

import pyarrow as pa
import pytest
import regex
from pyspark.sql import functions as F

from quillwork.catalog.text import TOKENIZERS
from quillwork.functions import pretok
from quillwork.operators import tokenize as T

TEXTS = ["Hello, world! It's 2024 - ok?", "  two  spaces\n\n\nlines \t", "ÉCLAT d'été 12345 中文あx \U0001f600", "a\u0085b c", "", "'LL they'll DON'T", "x" * 300]
needs_files = pytest.mark.skipif(not os.path.exists(f"{TOKENIZERS}/byte_bpe_50k.tiktoken"), reason="no vocabulary files")


def pieces(spark, program):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "i int, t string").coalesce(1)
    return [list(r.p) for r in df.select(pretok.run(program, F.col("t")).alias("p"), "i").orderBy("i").collect()]


@pytest.mark.parametrize(
    ("program", "pattern"),
    [
        (pretok.GPT2, r"""'(?:s|t|re|ve|m|ll|d)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""),
        (pretok.QWEN, r"""(?i:'s|'t|'re|'ve|'m|'ll|'d)|[^\r\n\p{L}\p{N}]?\p{L}+|\p{N}| ?[^\s\p{L}\p{N}]+[\r\n]*|\s*[\r\n]+|\s+(?!\S)|\s+"""),
    ],
)
def test_programs_equal_their_patterns(spark, program, pattern):
    assert pieces(spark, program) == [regex.findall(pattern, t) for t in TEXTS]


def test_stages_and_gaps(spark):
    assert pieces(spark, {"version": 2, "stages": [{"stage": "cjk_isolate"}]})[2][1] == "中文あ"
    only = {"version": 2, "stages": [{"stage": "digits_isolate", "mode": "grouped", "max_run": 3}, {"stage": "alternation", "ops": [{"op": "letters"}]}]}
    assert [p for p in pieces(spark, only)[2] if p.isdigit()] == ["123", "45"]
    assert all("".join(p) == t for p, t in zip(pieces(spark, only), TEXTS))
    for bad in ({"version": 3}, {"version": 2, "stages": [{"stage": "?"}]}, {"version": 1, "ops": [{"op": "?"}]}):
        with pytest.raises(ValueError):
            pretok.run(bad, F.lit(""))


@needs_files
def test_encoding_equals_that_of_tiktoken(spark):
    import tiktoken

    path = f"{TOKENIZERS}/byte_bpe_50k.tiktoken"
    v = T.load_tiktoken(spark, f"file://{os.path.realpath(path)}", "b")
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    pattern = r"""'(?:s|t|re|ve|m|ll|d)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
    want = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    df = spark.createDataFrame([(t,) for t in TEXTS], "t string").select("t", T.encode(F.col("t"), v).alias("ids"))
    for r in df.select("t", "ids", T.detokenize(F.col("ids"), v).alias("back")).collect():
        assert list(r.ids) == want.encode_ordinary(r.t) and r.back == r.t
    assert T.rank_lines(v)[5] == f"{base64.b64encode(next(k for k, x in ranks.items() if x == 5)).decode()} 5"


GARDEN = T.Vocabulary("garden", {"rose": 21, "ro": 22, "rosebud": 23, "-": 24, "fern": 25, "f": 26, "fe": 27, "\t": 28}, encoder="text", special={"stop": 700}, byte_start=300, byte_end=555)


def test_longest_match_and_fallback_bytes(spark):
    ids = spark.createDataFrame([("rosebud-fern\t<|stop|>;rose",)], "t string").select(T.encode_longest(F.col("t"), GARDEN).alias("i")).first().i
    assert list(ids) == [23, 24, 25, 28, 700, 0, 21]
    d = T.Detokenizer(GARDEN)
    note = [300 + b for b in "\U0001f3b5".encode()]
    assert d.render(note[:3], partial=True) == "" and d.render(note[3:], partial=True) == "\U0001f3b5"
    assert d.render([300 + 0xC0, 21, 9999, 700]) == "\ufffdrose\ufffd"
    assert d.render([300 + 0xE1, 300 + 0x84]) == "\ufffd" and d.pending == b""
    assert d.render([300 + 0xC3, 24], partial=True) == "\ufffd-"


def test_readable_units():
    raw = "aé中\U0001f600".encode()
    assert T.readable(raw) == ("aé中\U0001f600", b"")
    for cut in range(len(raw)):
        text, rest = T.readable(raw[:cut])
        assert text.encode() + rest == raw[:cut]
    assert T.readable(b"\xe2\x28\xa1b") == ("\ufffdb", b"") and T.readable(b"\xff\x80") == ("\ufffd\ufffd", b"")


def test_merges_of_one_rank_before_lower_ones_that_they_make():
    v = T.Vocabulary("m", {}, ["ab ab", "a b", "b a", "a a"])
    e = T.Encoder(v)
    assert e.merge(list("ababab")) == ["abab", "ab"] and e.merge(list("aaa")) == ["aa", "a"] and e.merge(list("baab")) == ["ba", "ab"]
    assert e.merge([]) == [] and e.merge(["x"]) == ["x"] and e.merge(list("xyz")) == list("xyz")


def test_special_tokens_are_split_off(spark):
    v = T.Vocabulary("s", {c: i for i, c in enumerate(T.BYTE_CHARS)} | {"<|im_end|>": 300, "ab": 301}, ["a b"], program=pretok.GPT2, special={"[X]": 302})
    got = spark.createDataFrame([("ab[X]ab<|im_end|>",)], "t string").select(T.encode(F.col("t"), v).alias("i")).first().i
    assert list(got) == [301, 302, 301, 300]


def test_compare(spark):
    df = spark.createDataFrame([([1, 2], [1, 2]), ([1, 2], [1, 3]), ([1], [1, 2])], "a array<int>, b array<int>").select(T.compare(F.col("a"), F.col("b")).alias("c"))
    assert [tuple(r.c) for r in df.collect()] == [(True, None), (False, 1), (False, 1)]


def test_tokenizer_json():
    doc = {"model": {"type": "BPE", "vocab": {"a": 0, "b": 1, "ab": 2}, "merges": [["a", "b"]]}, "added_tokens": [{"content": "<s>", "id": 3, "special": True}], "pre_tokenizer": {"type": "Sequence", "pretokenizers": [{"type": "Digits", "individual_digits": True}, {"type": "ByteLevel"}]}}
    v = T.from_tokenizer_json(doc, "x")
    assert (v.merges, v.encoder, v.special, len(v.program["stages"])) == (["a b"], "byte_level", {"<s>": 3}, 2)
    doc["pre_tokenizer"] = {"type": "Bert"}
    with pytest.raises(ValueError):
        T.from_tokenizer_json(doc, "x")


def test_scan_and_queue_merge_alike():
    rng = random.Random(5)
    e = T.Encoder(T.Vocabulary("m", {}, ["ab ab", "a b", "b a", "a a", "aa aa", "ba b", "b b", "c ab"]))
    for _ in range(2000):
        parts = rng.choices("abc", k=rng.randrange(T.SCANNED))
        assert e.scanned(parts) == e.queued(parts)


def test_ids_in_slices_and_generations_of_the_table(monkeypatch):
    monkeypatch.setattr(T, "SLICE", 3)
    monkeypatch.setattr(T, "CACHE", 2)
    v = T.Vocabulary("s", {c: i for i, c in enumerate(T.BYTE_CHARS)} | {"ab": 301}, ["a b"])
    lists = pa.array([["ab", "c", "ab"], None, [], ["d", "abc", "", "ab", "c"], ["ab"]], pa.list_(pa.string()))
    e, c, d = T.Encoder(v), ord("c"), ord("d")
    want = [[301, c, 301], None, [], [d, 301, c, 301, c], [301]]
    assert e.lists(lists).to_pylist() == want and len(e.known) <= 2 and len(e.before) <= 2
    assert T.Encoder(v).lists(lists.slice(1, 3)).to_pylist() == want[1:4]


def test_texts_equal_those_of_render():
    v = T.Vocabulary("s", {c: i for i, c in enumerate(T.BYTE_CHARS)} | {"ab": 301, "<|end|>": 302, "\u4e2d": 303}, ["a b"])
    rows = [[301, 99], None, [], [0xC3, 0xA9], [0xC3], [0xC3, 302, 0xA9], [0xE1, 303], [9999, None, 301], [301]]
    lists = pa.array(rows, pa.list_(pa.int64()))
    for special in (False, True):
        want = [None if r is None else T.Detokenizer(v).render(r, special=special) for r in rows]
        assert T.Detokenizer(v).texts(lists, special).to_pylist() == want and T.Detokenizer(v).texts(lists.slice(2, 5), special).to_pylist() == want[2:7]


@needs_files
def test_translation_of_whole_texts(spark, tmp_path):
    from quillwork.catalog import text

    rng = random.Random(1)
    rows = [(i, t) for i, t in enumerate([*TEXTS, None])] + [(100 + i, " ".join(rng.choice(("word", "w\u00e9rd", "12", "\u4e2d\u6587", f"x{rng.random()}")) for _ in range(400))) for i in range(300)]
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in text.translate_ids(spark, str(tmp_path)).collect()}
    pattern = r"""'(?:s|t|re|ve|m|ll|d)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
    encoders = [T.Encoder(text.vocabulary(spark, name)) for name in ("byte_bpe_50k", "byte_bpe_multi_50k")]
    n = lambda e, t: sum(len(e.queued([T.BYTE_CHARS[b] for b in p.encode()])) for p in regex.findall(pattern, t))
    assert len(got) == len(rows)
    for i, t in rows:
        if t is not None:
            assert [got[i].n_ids, got[i].n_other] == [n(e, t) for e in encoders], t
    assert got[len(TEXTS)].n_ids == got[len(TEXTS)].n_other


def test_table_of_pieces_is_bounded():
    e = T.Encoder(T.Vocabulary("m", {"a": 0}, ["a b"]))
    for k in range(400_000):
        e.piece(f"{k:x}")
    for k in range(300):
        e.piece(f"{k:x}" * 2000)
    kept = [e.known, getattr(e, "before", {})]
    assert sum(map(len, kept)) <= 300_000 and sum(len(p) for known in kept for p in known) < 2_000_000
