import itertools
import math
import random
import re
import subprocess
import sys
import zlib

import numpy as np
import pyarrow as pa
import pytest

from quillwork.llm import labelled, quality, toxicity

PROSE = [a + b for a in ("re", "mon", "ta", "li", "so", "pe") for b in ("nder", "st", "lar", "vi", "mant", "ch")]


def corpus(kind, n=240):
    rng = random.Random(5)
    rows, labels = [], []
    for i in range(n):
        words = [rng.choice(PROSE) for _ in range(rng.randrange(30, 90))]
        bad = rng.random() < 0.3
        if kind == "toxic" and bad:
            for _ in range(max(2, len(words) // 25)):
                words[rng.randrange(len(words))] = rng.choice(["blorgface", "snurkhead", "dreckling"])
        if kind == "quality" and bad:
            words = [w.upper() + "!!" for w in words] if i % 2 else [words[0]] * len(words)
        lines = [" ".join(words[k : k + 12]) for k in range(0, len(words), 12)]
        rows.append((i, "\n".join(lines), "a"))
        labels.append((i, 0 if kind == "quality" and bad else 1, int(kind == "toxic" and bad)))
    return rows, labels


@pytest.mark.parametrize(("kind", "module", "folds", "out", "threshold"), [("toxic", toxicity, 5, 0, 0.5), ("quality", quality, 4, 2, 0.7)])
def test_held_out_accuracy(spark, documents, odd_texts, kind, module, folds, out, threshold):
    rows, labels = corpus(kind)
    odd = [(None if i is None else 1000 + i, t, s) for i, t, s in odd_texts]
    table = spark.createDataFrame(labels + [(None, 1, 1), (5000, None, None), (3, 1, 1), (3, 0, 0)], "doc_id bigint, quality int, toxic int")
    got = module.classify(documents(rows + odd), table).collect()
    assert len(got) == len(rows) + len(odd)
    truth = {i: (q if kind == "quality" else t) for i, q, t in labels}
    right = total = 0
    for r in got:
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= threshold)
        assert r.held_out == (zlib.crc32(("" if r.doc_id is None else str(r.doc_id)).encode()) % folds == out)
        if r.held_out and r.doc_id in truth and r.doc_id < 1000:
            right, total = right + (r.predicted == truth[r.doc_id]), total + 1
    assert total > 20 and right / total > 0.95


def test_without_labels_or_documents(spark, documents):
    none = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    assert [r.score for r in toxicity.classify(documents([(1, "a", "s")]), none).collect()] == [0.0]
    assert [r.score for r in quality.classify(documents([(1, "a", "s")]), none).collect()] == [0.7]
    for m in (toxicity, quality):
        assert m.classify(documents([]), none).collect() == []


def test_rejecting_keeps_columns(spark, documents):
    rows, labels = corpus("toxic")
    docs = documents(rows)
    kept = toxicity.reject(docs, spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int"))
    assert kept.columns == docs.columns
    clean = {i for i, _, t in labels if not t}
    ids = {r.doc_id for r in kept.collect()}
    assert len(clean - ids) <= 3 and len(ids - clean) <= 8


def enumerated(emit, trans):
    """P(good) of each line of one chain, over all labellings."""
    weights = {}
    for y in itertools.product((0, 1), repeat=len(emit)):
        weights[y] = np.exp(sum(e * v for e, v in zip(emit, y)) + sum(trans[a, b] for a, b in zip(y, y[1:])))
    z = sum(weights.values())
    return [sum(w for y, w in weights.items() if y[k]) / z for k in range(len(emit))]


def test_marginals_are_those_of_enumeration():
    rng = np.random.default_rng(1)
    emit, trans = rng.normal(size=5), rng.normal(size=(2, 2))
    good, joint = quality.marginals(np.r_[emit, 0.3], trans, np.array([0, 5, 6]))
    assert np.allclose(good[:5], enumerated(emit, trans)) and abs(joint.sum() - 4) < 1e-9


def quality_model():
    rows, labels = corpus("quality")
    return quality.train([(t, q) for (_, t, _), (_, q, _) in zip(rows, labels)])


def test_document_quality_by_enumeration():
    model = quality_model()
    text = "REnder!! so\n\nta li so pe\nest est est\nlast line here|"
    data = np.frombuffer(text.encode(), np.uint8)
    places = quality.line_places(data, np.array([0, len(data)]))
    x = quality.line_features(data, *places, 0, len(places[0]))
    good = np.array(enumerated(((x - model["mean"]) / model["dev"]) @ model["w"], model["trans"]))
    weight = np.array([len(line) + 1 for line in text.split("\n")])
    q = (good * weight).sum() / weight.sum()
    assert np.isclose(quality.document_features(pa.array([text]), model)[0, 0], np.log(q / (1 - q)))


def test_blocks_of_lines_change_nothing(monkeypatch):
    model = quality_model()
    rng = random.Random(3)
    texts = ["\n".join(" ".join(rng.choices(PROSE, k=rng.randrange(6))) for _ in range(rng.randrange(1, 60))) for _ in range(20)] + ["", "\n\n"]
    whole = quality.document_features(pa.array(texts), model)
    assert np.allclose(whole, np.concatenate([quality.document_features(pa.array([t]), model) for t in texts]))
    monkeypatch.setattr(quality, "LINES", 7)
    monkeypatch.setattr(quality, "CHUNK", 50)
    assert np.allclose(whole, quality.document_features(pa.array(texts), model), rtol=1e-4, atol=1e-5)


def test_millions_of_lines_in_little_memory():
    code = """
import resource, numpy as np, pyarrow as pa
from quillwork.llm import quality
n = quality.N_FEATURES
model = {"mean": np.zeros(n), "dev": np.ones(n), "w": np.linspace(-1, 1, n), "trans": np.eye(2)}
before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
assert np.isfinite(quality.document_features(pa.array([chr(10) * 4_000_000], pa.large_string()), model)).all()
print((resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) // 1024)
"""
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=300)
    assert int(out.stdout) < 500, out.stderr


def test_toxicity_score_by_single_compressions():
    rows, labels = corpus("toxic")
    model = toxicity.train([(t, x) for (_, t, _), (_, _, x) in zip(rows, labels)])
    plain, toxic = toxicity.compressor(model["ordinary"]), toxicity.compressor(model["toxic"])
    texts = [rows[0][1], rows[1][1], "", "One", rows[2][1] * 3, " ".join(PROSE[:17]), " ".join(PROSE[:16])]
    got = toxicity.Scorer(model)(pa.array(texts))
    for text, score in zip(texts, got):
        words = text.encode().split()
        starts = [*range(0, max(len(words) - 16, 0), 8), max(len(words) - 16, 0)] if words else []
        saved = []
        folded = re.sub(rb"[\x09-\x0D]", b" ", text.lower().encode())
        spans = [m.span() for m in re.finditer(rb"[^ ]+", folded)]
        for s in starts:
            window = folded[spans[s][0] : spans[min(s + 16, len(words)) - 1][1]]
            saved.append(len(plain.compress(window)) - len(toxic.compress(window)))
        n = len(saved)
        x = [math.sqrt(sum(v >= t for v in saved) + 0.375) - math.sqrt(p * n + 0.375) for t, p in zip(model["thresholds"], model["expected"])]
        x += [sum(saved) / math.sqrt(max(n, 1)), math.log1p(n)]
        mean, dev, w = model["calibration"]
        odds = sum((v - m) / d * k for v, m, d, k in zip(x, mean, dev, w)) + w[-1]
        assert math.isclose(score, 1 / (1 + math.exp(-max(-30, min(30, odds)))), rel_tol=1e-9)
    assert got[2] < 0.5


def test_long_labelled_texts_and_absent_documents_count(spark, documents):
    rows = [(i, f"word{i} " * (20_000 if i % 2 else 3), "a") for i in range(20)]
    told = spark.createDataFrame([(i, 1, i % 2) for i in range(20)] + [(i, 1, 1) for i in range(1000, 3000)], "doc_id bigint, quality int, toxic int")
    found = labelled.sample(documents(rows), told, "toxic", 5, 0, 50, 10_000_000)
    assert sorted(found) == sorted((t, i % 2) for i, t, _ in rows if zlib.crc32(str(i).encode()) % 5)
    few = labelled.sample(documents(rows), told, "toxic", 5, 0, 3, 10_000_000)
    assert few == found[:3]
    bounded = labelled.sample(documents(rows), told, "toxic", 5, 0, 50, 200_000)
    assert bounded == found[: len(bounded)] and sum(len(t) for t, _ in bounded[1:]) <= 200_000
    repeated = labelled.sample(documents(rows[:4] * 3), told, "toxic", 5, 0, 5, 10_000_000)
    assert len(repeated) == 5


def test_equal_rows_get_equal_scores(spark, documents):
    rows, labels = corpus("toxic", 80)
    table = spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    for module in (toxicity, quality):
        got = module.classify(documents(rows + rows[:5] * 2), table).collect()
        for i in range(5):
            assert len({r.score for r in got if r.doc_id == i}) == 1 and sum(r.doc_id == i for r in got) == 3
