import math
import random
import zlib
from collections import Counter, defaultdict

import pytest

from quillwork.llm import suffixes


def held(i):
    return zlib.crc32(str(i).encode()) % 5 == 1


def brute(rows):
    """Scores by dictionaries over contexts of any length whose suffix is a state and whose last symbol is listed after the others."""
    words = [t.split() + [None] for _, t in rows]
    train = [ws for (i, _), ws in zip(rows, words) if not held(i)]
    counts = Counter(w for ws in train for w in ws)
    total = sum(counts.values()) + 0.5 * (len(counts) + 1)
    states = {}

    def contexts(ws, k):
        for i, x in enumerate(ws):
            before = ("^", *ws[:i])[-k:]
            if len(before) == k:
                yield before, x

    def log_p(context, x):
        while context and context not in states:
            context = context[1:]
        if not context:
            return math.log10((counts[x] + 0.5) / total)
        scale, listed = states[context]
        return listed[x] if x in listed else scale + log_p(context[1:], x)

    k, steps = 0, set()
    while True:
        k += 1
        n, after = Counter(), defaultdict(Counter)
        for ws in train:
            for c, x in contexts(ws, k):
                n[c] += 1
                after[c][x] += 1
        new, last_steps, steps = {}, steps, set()
        for c in n:
            listed = {x: m for x, m in after[c].items() if m >= suffixes.MIN_COUNT}
            if not listed or k > 1 and (c[1:] not in states or c not in last_steps):
                continue
            steps |= {(*c, x) for x in listed}
            q = {x: 10 ** log_p(c[1:], x) for x in listed}
            rest, rest_q = n[c] - sum(listed.values()), max(1 - sum(q.values()), 1e-9)
            gain = sum(m * math.log(m / (n[c] * q[x])) for x, m in listed.items()) + (rest * math.log(rest / (n[c] * rest_q)) if rest else 0)
            if gain > 0.5 * (len(listed) + 1) * math.log(n[c]):
                p = {x: (m + len(listed) * q[x]) / (n[c] + len(listed)) for x, m in listed.items()}
                new[c] = math.log10(max(1 - sum(p.values()), 1e-9) / rest_q), {x: math.log10(v) for x, v in p.items()}
        if not new:
            break
        states |= new
    out = {i: sum(log_p(("^", *ws[:j])[-k:], x) for j, x in enumerate(ws)) for (i, _), ws in zip(rows, words)}
    return out, Counter(map(len, states))


@pytest.fixture(scope="module")
def rows():
    """More than 200,000 training words, among them phrases that occur six to eight times, and a source with a memory of four symbols."""
    r = random.Random(5)
    phrases = [[f"q{k}", f"r{k}", f"s{k % 9}", f"t{k}"] for k in range(300)]
    texts = [[f"w{int(r.paretovariate(0.8)) % 3000}" for _ in range(4500)] for _ in range(70)]
    for k, phrase in enumerate(phrases):
        for _ in range(6 + k % 3):
            t = r.choice(texts)
            at = r.randrange(len(t))
            t[at:at] = phrase
    table, pick = {}, random.Random(9)
    for t in texts[:12]:  # what follows depends on the last symbol, more on two, most on four
        z = [0, 0, 0, 0]
        for _ in range(4000):
            far = r.choice([1, 2, 3, 4])
            z.append(table.setdefault(tuple(z[-far:]), pick.randrange(4)))
        t += [f"z{x}" for x in z]
    return [(i, " ".join(t)) for i, t in enumerate(texts)]


@pytest.mark.parametrize(("head", "least"), [(1e-9, 4), (1e-3, 4), (1e-3, 2)])
def test_scores_are_those_of_a_tree_of_any_depth(documents, rows, monkeypatch, head, least):
    monkeypatch.setattr(suffixes, "HEAD", head)  # the larger value sends all but the commonest keys through the shuffle
    monkeypatch.setattr(suffixes, "MIN_COUNT", least)
    want, states = brute(rows)
    assert states[1] > 300 and states[2] > 100 and states[4] > 50
    got = {r.doc_id: r for r in suffixes.score(documents([(i, t, "a") for i, t in rows])).collect()}
    assert got[0].train_tokens > 200_000
    assert {i: round(r.score, 3) for i, r in got.items()} == pytest.approx({i: round(x, 3) for i, x in want.items()}, abs=0.002)
