import random
import re

import pytest

from quillwork.llm import jaccard
from quillwork.llm.components import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sets_of(rows, width):
    out = []
    for _, t, _ in rows:
        w = WORD.findall((t or "").translate(LOWER))
        out.append({tuple(w[k : k + width]) for k in range(max(1, len(w) - width + 1))} if w else set())
    return out


def brute(rows, width, percent):
    sets = sets_of(rows, width)
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            x, y = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                parent[find(a)] = find(b)
    least = {}
    for i, (d, _, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return sorted(((d, len(sets[i]), least.get(find(i))) for i, (d, _, _) in enumerate(rows)), key=str)


def compare(rows, documents, width=3, percent=90):
    got = jaccard.joined(documents(rows), width, percent).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == brute(rows, width, percent)


def texts(seed, n_words=(20, 120)):
    """Chains and clusters of near copies over shared passages and a small vocabulary."""
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(60)]
    passage = [f"p{i}" for i in range(40)]
    rows, doc = [], 0
    for _ in range(14):
        base = [rng.choice(vocabulary) for _ in range(rng.randrange(*n_words))] + (passage if rng.random() < 0.5 else [])
        for _ in range(rng.randrange(1, 8)):
            rows.append((doc, " ".join(base), "a"))
            doc += 1
            for _ in range(rng.randrange(3)):
                base[rng.randrange(len(base))] = rng.choice(vocabulary)
            if rng.random() < 0.3:
                base = base[:-1]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize(("width", "percent"), [(3, 90), (2, 70)])
def test_against_brute_force(documents, width, percent):
    compare(texts(width), documents, width, percent)


def test_odd_rows(documents, odd_texts):
    compare(odd_texts + [(30, "ONE", "a"), (31, "two words", "a"), (32, "Two  words", "b")], documents)


def test_one_cluster_of_near_copies(documents):
    rng = random.Random(3)
    base = [f"w{i}" for i in range(150)]
    rows = []
    for i in range(40):
        copy = list(base)
        for _ in range(rng.randrange(5)):
            copy[rng.randrange(150)] = f"new{rng.randrange(10**6)}"
        rows.append((100 - i, " ".join(copy), "a"))
    compare(rows, documents)


def test_empty(documents):
    assert jaccard.joined(documents([])).collect() == []


def test_one_of_each_component_stays(documents, odd_texts):
    rows = odd_texts + [(1000 + d, t, s) for d, t, s in texts(9)[:30]]
    docs = documents(rows)
    out = jaccard.deduplicate(docs, 5, 80)
    assert out.columns == docs.columns
    told = brute(rows, 5, 80)
    sizes = sets_of(rows, 5)
    empty = sum(not s for s in sizes)
    linked = {c for _, n, c in told if n and c is not None}
    nameless = sum(1 for (d, _, c), in zip(told) if d is None and c is None)
    assert out.count() == empty + len(linked) + nameless
    assert linked <= {r.doc_id for r in out.collect()}


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, 90), (90, 95), (7, 7), (3, 1)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {i: 1 for i in range(2, 41)} | {100: 90, 95: 90}
