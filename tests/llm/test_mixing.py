import re

from pyspark.sql import functions as F

from quillwork.llm import mixing

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows):
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len(WORD.findall(t or ""))
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: 1 + i % 3 for i, s in enumerate(names)}
    target, free, left = {}, set(names), float(sum(sizes.values()))
    while free:
        w = sum(weight[s] for s in free)
        over = [s for s in free if weight[s] * left / w > 3 * sizes[s]]
        if not over:
            target |= {s: weight[s] * left / w for s in free}
            break
        for s in over:
            target[s] = 3.0 * sizes[s]
            left -= target[s]
            free.discard(s)
    return sizes, target


def check(rows, documents, **how):
    got = mixing.mix(documents(rows), **how).collect()
    assert len(got) == len(rows)
    sizes, target = brute(rows)
    taken = {}
    for r in got:
        assert r.source_size == sizes[r.source]
        assert abs(r.target - target[r.source]) < 1e-6 * max(1, target[r.source])
        assert 0 <= r.taken <= 3 * r.size
        taken[r.source] = taken.get(r.source, 0) + r.taken
    for s, t in target.items():
        assert taken[s] == int(t + 0.5)
    return got


def test_odd_rows(documents, odd_texts):
    check(odd_texts, documents)


def test_caps_and_many_buckets(documents):
    rows = [(i, "a b c " * (i % 7), "abcdefg"[min(6, i % 11)]) for i in range(400)] + [(1000, "one", "z"), (1001, "one two", "y")]
    first = check(rows, documents, rows_per_bucket=8)
    again = mixing.mix(documents(rows), rows_per_bucket=1000).collect()
    assert sorted((r.doc_id, r.taken) for r in first) == sorted((r.doc_id, r.taken) for r in again)


def test_hot_source_and_equal_rows(documents):
    check([(5, "same words here", "hot")] * 60 + [(i, "x y", f"s{i}") for i in range(30)], documents, rows_per_bucket=4)


def test_empty(documents):
    assert mixing.mix(documents([])).collect() == []
    assert mixing.compose(documents([])).collect() == []


def test_no_words_at_all(documents):
    got = mixing.mix(documents([(1, None, "a"), (2, "", "b")])).collect()
    assert [(r.taken, r.target) for r in got] == [(0, 0.0), (0, 0.0)]


def composed(rows, documents, **how):
    docs = documents(rows)
    mixed = mixing.mix(docs, **how)
    out = mixing.compose(docs, **how)
    assert out.columns == docs.columns
    times = F.when(F.col("size") == 0, 1).otherwise(F.col("epochs") + (F.col("part") > 0).cast("int"))
    want = mixed.withColumn("times", times).groupBy("doc_id", "source", "size").agg(F.sum("times").alias("n")).filter("n > 0").collect()
    got = out.withColumn("size", mixing.spaced_count(F.col("text"))).groupBy("doc_id", "source", "size").agg(F.count("*").alias("n")).collect()
    assert sorted(map(str, got)) == sorted(map(str, want))


def test_compose_keeps_columns_and_counts(documents, odd_texts):
    composed(odd_texts, documents)


def test_compose_cuts_where_the_mix_does(documents):
    composed([(i, "a b c " * (i % 7), "abcdefg"[min(6, i % 11)]) for i in range(400)] + [(1000, "one", "z")], documents, rows_per_bucket=8)


def test_compose_splits_equal_rows(documents):
    composed([(5, "same words here", "hot")] * 60 + [(i, "x y", f"s{i}") for i in range(30)] + [(i, "y " * 9, "t") for i in range(30)], documents)
