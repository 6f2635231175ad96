import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from quillwork.llm import suffixes

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def held(i):
    return zlib.crc32(("" if i is None else str(i)).encode()) % 5 == 1


def check(rows, documents):
    got = suffixes.score(documents(rows)).collect()
    words = [WORD.findall((t or "").translate(LOWER)) + [None] for _, t, _ in rows]
    counts = Counter(w for (i, _, _), ws in zip(rows, words) if not held(i) for w in ws)
    total = sum(counts.values())
    divisor = total + 0.5 * (len(counts) + 1)
    want = [
        (i, held(i), len(ws), sum(counts[w] > 0 for w in ws), total, round(sum(math.log10((counts[w] + 0.5) / divisor) for w in ws), 4))
        for (i, _, _), ws in zip(rows, words)
    ]
    assert sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4)) for r in got), key=str) == sorted(want, key=str)
    assert all(r.score <= 1e-9 and np.isfinite(r.score) for r in got)
    return got


def text(i):
    """Words follow each other with a rule, so contexts tell much."""
    out = []
    for k in range(60):
        out += [["x", "then", "left"], ["y", "then", "right"]][(i * 7 + k * k // 3) % 2] + [f"does{(i * k) % 5}"]
    return " ".join(out)


@pytest.mark.parametrize("head", [1e-6, 5e-3])
def test_counts_and_scores(documents, odd_texts, monkeypatch, head):
    monkeypatch.setattr(suffixes, "HEAD", head)  # the larger value sends most words through the shuffle join
    got = check(odd_texts + [(100 + i, text(i), "a") for i in range(60)], documents)
    regular = [r for r in got if r.doc_id is not None and r.doc_id >= 100 and r.held_out]
    assert regular and all(r.score > r.base_score for r in regular)


def test_states_are_distributions(documents):
    from pyspark.sql import functions as F

    docs = documents([(i, text(i), "a") for i in range(60)]).select(F.lit(False).alias("held_out"), "text")
    tree = suffixes.learn(docs)
    assert len(tree.states) > 1 and tree.states[1].count()
    root = {r.key: (r.c + 0.5) / tree.divisor for r in tree.words.collect()}
    suffix_of, last, listed, scale = {}, {}, {}, {}
    for level, (states, steps) in enumerate(zip(tree.states, tree.transitions)):
        scale |= {r.key: r.scale for r in states.collect()}
        for r in steps.collect():
            suffix_of[r.key], last[r.key] = r.suffix, last[r.suffix] if level else r.suffix
            if r.deep:
                listed.setdefault(r.prefix, {})[last[r.key]] = 10**r.lp

    def p(context, symbol):
        while context is not None and context not in scale:
            context = suffix_of.get(context)
        if context is None:
            return root[symbol]
        own = listed[context]
        return own[symbol] if symbol in own else 10 ** scale[context] * p(suffix_of.get(context), symbol)

    for context in scale:
        beyond = 1 - sum(root.values())  # of words that training lacks
        up = context
        while up is not None:
            beyond *= 10 ** scale.get(up, 0)
            up = suffix_of.get(up)
        assert abs(sum(p(context, x) for x in root) + beyond - 1) < 1e-6


def test_empty_and_only_held_out(documents):
    assert suffixes.score(documents([])).collect() == []
    lone = next(i for i in range(50) if held(i))
    got = suffixes.score(documents([(lone, "a b", "s")])).collect()
    assert [(r.n_tokens, r.n_known, r.train_tokens) for r in got] == [(3, 0, 0)]


def test_keys_are_ordered_whatever_their_low_bits():
    rng = np.random.default_rng(3)
    spread = rng.integers(0, 1 << 63, 5_000, dtype=np.uint64) * np.uint64(2)
    close = np.uint64(1 << 40) + rng.integers(0, 700, 5_000, dtype=np.uint64)  # alike but for the bits that hold places
    for keys in (spread, np.tile(spread[:50], 40), close, np.r_[spread, close], np.full(9, 2**64 - 1, np.uint64), spread[:1], spread[:0]):
        assert np.array_equal(suffixes.order_of(keys), np.argsort(keys, kind="stable"))
        order, begin, counts = suffixes.distinct(keys)
        values, times = np.unique(keys, return_counts=True)
        assert np.array_equal(keys[order[begin]], values) and np.array_equal(counts, times)
        for parts in (3, 48, 204, 70_000):
            found = dict(suffixes.by_part(keys, parts))
            assert sorted(np.concatenate([*found.values(), []]).tolist()) == list(range(len(keys)))
            assert all(((keys[at] >> np.uint64(40)) % np.uint64(parts) == part).all() and (np.diff(at) > 0).all() for part, at in found.items())


def test_short_rows_share_a_batch():
    rows = [(k % 7, 1, k, b"x" * 100) for k in range(30_000)]
    batches = list(suffixes.as_batches(iter(rows)))
    assert len(batches) == 3 and [tuple(r.values()) for b in batches for r in b.to_pylist()] == rows
    assert list(suffixes.as_batches(iter([]))) == []
