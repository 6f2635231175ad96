import hashlib
import re

from quillwork.llm import decontaminate

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(t):
    return WORD.findall((t or "").translate(LOWER))


def brute(rows, items, width=10):
    windows = {}
    for item, t in items:
        w = words(t)
        k = min(width, len(w))
        for i in range(len(w) - k + 1 if w else 0):
            windows.setdefault(tuple(w[i : i + k]), set()).add(item)
    lengths = {len(w) for w in windows}
    out = []
    for i, t, _ in rows:
        w = words(t)
        hit, found = set(), set()
        for k in lengths:
            for s in range(len(w) - k + 1):
                if (named := windows.get(tuple(w[s : s + k]))) is not None:
                    hit |= set(range(s, s + k))
                    found |= named
        told = hashlib.sha256(",".join(sorted(str(x) for x in found)).encode()).hexdigest()
        out.append((i, len(w), len(hit), len(found), told, bool(hit)))
    return sorted(out, key=str)


ITEMS = [
    (1, "Alpha beta gamma, delta epsilon zeta eta theta iota kappa lambda mu"), (2, "short one"), (3, None), (4, ""), (5, "..."), (6, "solo"),
    (7, "the the the the the the the the the the the the"), (10, "alpha beta gamma delta epsilon zeta eta theta iota kappa"), (2, "short one"), (11, "ÉCLAT d'été 12"),
]


def items_of(spark):
    from pyspark.sql import functions as F

    return spark.createDataFrame(ITEMS, "item_id bigint, text string").withColumns({c: F.lit(1) for c in ("words", "term", "count", "key")})


def compare(rows, spark, documents):
    got = decontaminate.report(documents(rows), items_of(spark)).drop("key").collect()
    assert sorted((tuple(r) for r in got), key=str) == brute(rows, ITEMS)


def test_report(spark, documents, odd_texts):
    passage = "alpha beta gamma delta epsilon zeta eta theta iota kappa"
    rows = odd_texts + [
        (20, f"before {passage} after", "a"), (21, passage.upper().replace(" ", "-"), "a"), (22, passage[6:], "b"), (23, "a Short, ONE is here and solo", "b"),
        (24, "the " * 40, "c"), (25, f"{passage} lambda mu {passage}", "c"), (25, f"{passage} lambda mu {passage}", "c"), (None, passage, None), (None, "short two one", None),
        (26, "ÉCLAT D'été 12", "a"), (27, "alpha gamma beta delta epsilon zeta eta theta iota kappa", "a"),
    ]
    compare(rows, spark, documents)


def test_empty_tables(spark, documents):
    compare([], spark, documents)
    none = spark.createDataFrame([], "item_id bigint, text string")
    got = decontaminate.report(documents([(1, "a b", "s")]), none).collect()
    assert [(r.n_words, r.n_hit, r.contaminated) for r in got] == [(2, 0, False)]


def test_clean(spark, documents):
    docs = documents([(1, "nothing here", "a"), (2, "a short one", "a"), (3, None, "a"), (2, "other text", "a")])
    out = decontaminate.clean(docs, items_of(spark))
    assert out.columns == docs.columns
    assert sorted((r.doc_id, r.text or "") for r in out.collect()) == [(1, "nothing here"), (2, "other text"), (3, "")]


def test_proximity(spark, documents):
    docs = documents([(1, "beta x alpha gamma, far away delta", "a"), (2, "alpha beta", "a"), (3, "alpha " + "x " * 30 + "gamma beta", "a")])
    items = spark.createDataFrame([(1, "alpha beta gamma")], "item_id bigint, text string")
    _, hits = decontaminate.matches(docs, items, width=3, slop=2)
    keys = {r.key for r in hits.collect()}
    want = docs.filter("doc_id = 1").select(decontaminate.row_key().alias("k")).first().k
    assert keys == {want}
