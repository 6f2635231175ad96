"""Queries on pre-tokenizing, tokenizing and translation."""

from __future__ import annotations

import os

from pyspark.sql import Window
from pyspark.sql import functions as F

from quillwork.functions import pretok
from quillwork.operators import tokenize
from quillwork.plans.batches import bounded_batches
from quillwork.plans.materialize import materialize
from quillwork.plans.spread import spread
from quillwork.plans.streams import joined, read

#: Folder of the public vocabulary files; a parameter, as they aren't part of this repository.
TOKENIZERS = os.environ.get("QUILLWORK_TOKENIZERS", "/opt/tokenizers")
#: Bytes of an Arrow batch where two Python stages run in each task.
BATCH_BYTES = 4_000_000
_loaded: dict[str, tokenize.Vocabulary] = {}


def vocabulary(spark, name: str = "byte_bpe_50k") -> tokenize.Vocabulary:
    if name not in _loaded:
        _loaded[name] = tokenize.load_tiktoken(spark, f"file://{os.path.realpath(TOKENIZERS)}/{name}.tiktoken", name)
    return _loaded[name]


def _pieces(spark, sf_dir, pieces):
    docs = spread(read(spark, sf_dir, "documents")).select("doc_id", pieces.alias("p"))
    return docs.select("doc_id", F.size("p").alias("n_pieces"), F.sha2(F.array_join("p", "\u0001"), 256).alias("pieces_sha256"))


def _stage(spark, sf_dir, **s):
    return _pieces(spark, sf_dir, pretok.run({"version": 2, "stages": [s]}, F.col("text")))


def pretok_digits(spark, sf_dir):
    return _stage(spark, sf_dir, stage="digits_isolate", mode="grouped", max_run=3)


def pretok_digit_triples(spark, sf_dir):
    return _stage(spark, sf_dir, stage="digit_triples_isolate")


def pretok_punct(spark, sf_dir):
    return _stage(spark, sf_dir, stage="punctuation_contiguous")


def pretok_cjk(spark, sf_dir):
    return _stage(spark, sf_dir, stage="cjk_isolate")


def pretok_letters(spark, sf_dir):
    return _pieces(spark, sf_dir, pretok.pieces_by("|".join(f"(?:{pretok.branch(o)})" for o in ({"op": "letters", "lead_other": True}, {"op": "numbers", "max_run": 3})))(F.col("text")))


def pretok_gpt2(spark, sf_dir):
    return _pieces(spark, sf_dir, pretok.run(pretok.GPT2, F.col("text")))


def pretok_qwen(spark, sf_dir):
    return _pieces(spark, sf_dir, pretok.run(pretok.QWEN, F.col("text")))


def pretok_cased(spark, sf_dir):
    return _pieces(spark, sf_dir, pretok.run(pretok.CASED, F.col("text")))


def metaspace_pieces(spark, sf_dir):
    return _pieces(spark, sf_dir, pretok.metaspace_split(F.col("text")))


def metaspace_normalize(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", F.sha2(pretok.metaspace_normalize(F.col("text"), "first"), 256).alias("text_sha256"))


def byte_level_chars(spark, sf_dir):
    return read(spark, sf_dir, "benchmark").select("item_id", tokenize.byte_level(F.col("text")).alias("chars"))


def _words(spark, sf_dir):
    words = read(spark, sf_dir, "documents").select("doc_id", F.explode(F.split("text", "[ \n]+")).alias("word")).filter("word <> ''")
    counts = words.groupBy("word").count()
    top = counts.orderBy(F.col("count").desc(), "word").limit(500)
    return words, top.select("word", (F.row_number().over(Window.orderBy(F.col("count").desc(), "word")) + 255).alias("id"))


def vocab_lookup_byte_fallback(spark, sf_dir):
    """Ids of words; those outside the 500 most frequent become their bytes."""
    words, top = _words(spark, sf_dir)
    found = words.join(F.broadcast(top), "word", "left").withColumn("n_ids", F.when(F.col("id").isNotNull(), 1).otherwise(F.octet_length("word")))
    return found.groupBy("doc_id").agg(F.sum("n_ids").alias("n_ids"), F.count("id").alias("n_known"))


def longest_match_encode(spark, sf_dir):
    _, top = _words(spark, sf_dir)
    v = tokenize.Vocabulary("words", {r.word: r.id for r in top.collect()})
    return read(spark, sf_dir, "benchmark").select("item_id", joined(tokenize.encode_longest(F.col("text"), v)).alias("ids"))


def bpe_encode(spark, sf_dir):
    ids = tokenize.encode(F.col("text"), vocabulary(spark))
    return spread(read(spark, sf_dir, "documents")).select("doc_id", ids.alias("ids")).select("doc_id", F.size("ids").alias("n_ids"), F.sha2(joined(F.col("ids")), 256).alias("ids_sha256"))


def bpe_roundtrip(spark, sf_dir):
    v = vocabulary(spark)
    docs = spread(read(spark, sf_dir, "documents")).select("doc_id", "text", tokenize.encode(F.col("text"), v).alias("ids"))
    return docs.select("doc_id", (tokenize.detokenize(F.col("ids"), v) == F.col("text")).alias("same_text"))


def translate_ids(spark, sf_dir):
    a, b = vocabulary(spark), vocabulary(spark, "byte_bpe_multi_50k")
    docs = spread(read(spark, sf_dir, "documents")).select("doc_id", tokenize.encode_and_render(F.col("text"), a).alias("a"))
    docs = docs.select("doc_id", F.col("a.ids").alias("ids"), tokenize.encode(F.col("a.text"), b).alias("other"))
    out = docs.select("doc_id", F.size("ids").alias("n_ids"), F.size("other").alias("n_other"), F.round(F.size("other") / F.greatest(F.size("ids"), F.lit(1)), 6).alias("ratio"))
    with bounded_batches(spark, BATCH_BYTES):
        return materialize(out, "translated")


def translation_table_stats(spark, sf_dir):
    a, b = vocabulary(spark), vocabulary(spark, "byte_bpe_multi_50k")
    return tokenize.coverage(tokenize.translation_table(spark, a, b), len(a.vocab))


def derive_merges(spark, sf_dir):
    """Merges of a vocabulary of word beginnings, ranked by length and text."""
    words = read(spark, sf_dir, "benchmark").select(F.explode(F.split("text", " ")).alias("w")).filter("w <> ''").distinct()
    heads = words.select(F.explode(F.sequence(F.lit(1), F.length("w"))).alias("n"), "w").select(F.expr("substring(w, 1, n)").alias("token"))
    chars = words.select(F.explode(F.split("w", "")).alias("token"))
    tokens = heads.union(chars).filter("token <> ''").distinct()
    ranked = tokens.withColumn("rank", (F.row_number().over(Window.orderBy(F.length("token"), "token")) - 1).cast("long"))
    return tokenize.derive_merges(ranked)


def _sql(pattern: str) -> str:
    return f"SELECT doc_id, len(p)::INT AS n_pieces, sha256(array_to_string(p, chr(1))) AS pieces_sha256 FROM (SELECT doc_id, list_filter({pattern}, lambda x: x <> '') AS p FROM documents)"


def _all(pattern: str) -> str:
    return _sql("regexp_extract_all(text, '" + pattern.replace("'", "''") + "')")


QUERIES = {
    f.__name__: f
    for f in (pretok_digits, pretok_digit_triples, pretok_punct, pretok_cjk, pretok_letters, pretok_gpt2, pretok_qwen, pretok_cased, metaspace_pieces, metaspace_normalize, byte_level_chars,
              vocab_lookup_byte_fallback, longest_match_encode, bpe_encode, bpe_roundtrip, translate_ids, translation_table_stats, derive_merges)
}
_CHARS = "[" + ", ".join("'" + c.replace("'", "''") + "'" for c in tokenize.BYTE_CHARS) + "]"
_TOP = """words AS (SELECT doc_id, word FROM (SELECT doc_id, unnest(regexp_split_to_array(text, '[ \\n]+')) AS word FROM documents) WHERE word <> ''),
top AS (SELECT word, row_number() OVER (ORDER BY count(*) DESC, word) + 255 AS id FROM words GROUP BY word ORDER BY count(*) DESC, word LIMIT 500)"""
ORACLES = {
    "pretok_digits": _all(r"(?s)\p{N}{1,3}|\P{N}+"),
    "pretok_digit_triples": _sql("string_split(regexp_replace(text, '([0-9]{3})', chr(2) || '\\1' || chr(2), 'g'), chr(2))"),
    "pretok_punct": _all(f"(?s)[{pretok.PUNCT}]+|[^{pretok.PUNCT}]+"),
    "pretok_cjk": _all(f"(?s)[{pretok.CJK}]+|[^{pretok.CJK}]+"),
    "pretok_letters": _all(r"[^\r\n\p{L}\p{N}]?\p{L}+|\p{N}{1,3}"),
    "metaspace_pieces": _sql(f"list_transform(list_filter(regexp_split_to_array(text, '[{pretok.WS}]+'), lambda x: x <> ''), lambda x: '{pretok.META}' || x)"),
    "metaspace_normalize": f"SELECT doc_id, sha256(CASE WHEN starts_with(t, '{pretok.META}') THEN t ELSE '{pretok.META}' || t END) AS text_sha256 FROM (SELECT doc_id, replace(text, ' ', '{pretok.META}') AS t FROM documents)",
    "byte_level_chars": f"SELECT item_id, array_to_string(list_transform(regexp_extract_all(hex(text), '..'), lambda h: ({_CHARS})[1 + 16 * (instr('0123456789ABCDEF', h[1]) - 1) + instr('0123456789ABCDEF', h[2]) - 1]), '') AS chars FROM benchmark",
    "vocab_lookup_byte_fallback": f"WITH {_TOP} SELECT doc_id, sum(CASE WHEN id IS NULL THEN strlen(word) ELSE 1 END)::BIGINT AS n_ids, count(id) AS n_known FROM words LEFT JOIN top USING (word) GROUP BY doc_id",
    "derive_merges": """WITH w AS (SELECT DISTINCT unnest(string_split(text, ' ')) AS w FROM benchmark), t AS (SELECT DISTINCT token FROM (SELECT unnest(list_transform(range(1, length(w) + 1), lambda n: w[1:n])) AS token FROM w
      UNION ALL SELECT unnest(string_split(w, '')) FROM w) WHERE token <> ''), v AS (SELECT token, row_number() OVER (ORDER BY length(token), token) - 1 AS rank FROM t),
      c AS (SELECT token, rank, k, token[1:k] AS l, token[k + 1:] AS r FROM (SELECT token, rank, unnest(range(1, length(token))) AS k FROM v)),
      b AS (SELECT c.rank, c.token, l AS "left", r AS "right", row_number() OVER (PARTITION BY c.token ORDER BY greatest(a.rank, b.rank), k) AS n FROM c JOIN v a ON a.token = l JOIN v b ON b.token = r WHERE a.rank < c.rank AND b.rank < c.rank)
      SELECT rank, token, "left", "right" FROM b WHERE n = 1""",
}
