import pytest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture
def documents(spark):
    """Makes a documents table from (doc_id, text, source) rows, with columns whose names the operators use themselves."""

    def make(rows):
        full = [(i, t, "en", s, None if t is None else len(t)) for i, t, s in rows]
        df = spark.createDataFrame(full, SCHEMA)
        from pyspark.sql import functions as F

        clash = ("size", "key", "n", "sid", "shard", "slot", "score", "words", "pos", "item", "_key", "_doc", "row", "rank")
        return df.withColumns({c: F.lit("clash") for c in clash})

    return make


@pytest.fixture(scope="session")
def odd_texts():
    """Null, empty, blank, one word, beyond ASCII, very long, and equal texts."""
    long = " ".join(f"w{i % 977}" for i in range(60_000))
    return [
        (1, None, "b"), (2, "", "b"), (3, " \t\n ", None), (4, "One", "a"), (5, "één ÉÉN \U0001f600 x y", "a"),
        (6, long, "a"), (7, "the same text here again", "c"), (8, "the same text here again", "c"), (8, "the same text here again", "c"),
        (None, "no id at all here", None), (9, "x" * 300_000, "c"), (10, "line one\nline two\nline two", "a"),
    ]
