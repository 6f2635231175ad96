"""Quality by a linear-chain conditional random field over lines.

Every line of a text is good or bad.  A line's features are the shares of
character classes, word lengths and repetitions in it, and the same of the lines
before and after.  The chain's weights are fitted by penalised maximum likelihood
on labelled documents, whose lines carry their document's label.  Forward-backward
gives each line's probability of being good; their mean, weighted by line length,
is the document's quality, and a logistic step calibrated on the training
documents maps it to the score, such that even odds stand at the threshold.

Training takes at most ``SAMPLE_ROWS`` labelled documents, whole, and at most
``SAMPLE_CHARS`` characters in all, a line counting ``LINE_COST`` more.  Without
examples of both labels the score is the threshold.  Every text is scored whole, null
as empty; an empty text is one empty line.  A text of many lines is worked on in
blocks of ``LINES`` lines, with the chain's messages carried over from block to block.
Equal rows get equal scores; columns named like the result's are replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillwork.llm import labelled
from quillwork.llm.packed import append_columns, batch_bytes, pieces, span_hashes, word_spans
from quillwork.llm.words import fold_of

FOLDS, HELD_OUT, THRESHOLD = 4, 2, 0.7
SAMPLE_ROWS, SAMPLE_CHARS, LINE_COST = 6_000, 40_000_000, 100
STEPS, PENALTY = 120, 1e-3
LINES, CHUNK = 16_384, 1 << 20


def _class(chars: bytes) -> np.ndarray:
    out = np.zeros(256, np.uint8)
    out[list(chars)] = 1
    return out


UPPER, LOWER, DIGIT = bytes(range(65, 91)), bytes(range(97, 123)), bytes(range(48, 58))
COMMON = b" .,;:'\"-()?"
CLASSES = [_class(UPPER), _class(LOWER), _class(DIGIT), _class(COMMON), _class(bytes(range(128, 256))), _class(b"|"), _class(b"!?"),
           _class(bytes(b for b in range(33, 127) if b not in UPPER + LOWER + DIGIT + COMMON + b"|!?"))]
OWN = len(CLASSES) + 5
N_FEATURES = 3 * OWN + 1


def line_places(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start and end of each line in data, where each row's lines start, with the end); a row has one line at least."""
    n_rows = len(offsets) - 1
    breaks = np.flatnonzero(data == 10)
    count = np.diff(np.searchsorted(breaks, offsets)) + 1
    first = np.concatenate([[0], np.cumsum(count)])
    starts, ends = np.empty(first[-1], np.int64), np.empty(first[-1], np.int64)
    head, last = np.zeros(first[-1], bool), np.zeros(first[-1], bool)
    head[first[:-1]], last[first[1:] - 1] = True, True
    starts[head], starts[~head] = offsets[:n_rows], breaks + 1
    ends[last], ends[~last] = offsets[1:], breaks
    return starts, ends, first


def own_features(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The features of some consecutive lines by themselves; data is read between the first start and the last end."""
    n = len(starts)
    out = np.zeros((n, OWN), np.float32)
    if not n:
        return out
    origin = starts[0]
    data, starts, ends = data[origin : ends[-1]], starts - origin, ends - origin
    length = ends - starts
    for at in range(0, len(data), CHUNK):
        part = data[at : at + CHUNK]
        i, j = np.searchsorted(ends, at, side="right"), np.searchsorted(starts, at + len(part), side="left")
        a, b = np.clip(starts[i:j] - at, 0, len(part)), np.clip(ends[i:j] - at, 0, len(part))
        for k, table in enumerate(CLASSES):
            sums = np.concatenate([[0], np.cumsum(table[part], dtype=np.int64)])
            out[i:j, k] += sums[b] - sums[a]
    out[:, : len(CLASSES)] /= np.maximum(length, 1)[:, None]
    w_start, w_end, line = word_spans(data, np.append(starts, len(data)))
    hashes = span_hashes(data, w_start, w_end)
    n_words = np.bincount(line, minlength=n)
    same, pairs = np.zeros(len(hashes), bool), np.zeros(len(hashes), bool)
    same[1:] = (hashes[1:] == hashes[:-1]) & (line[1:] == line[:-1])
    pairs[2:] = (hashes[2:] == hashes[:-2]) & (line[2:] == line[:-2])
    k, words = len(CLASSES), np.maximum(n_words, 1)
    out[:, k] = np.bincount(line, same, minlength=n) / words
    out[:, k + 1] = np.bincount(line, pairs, minlength=n) / words
    out[:, k + 2] = np.minimum(np.bincount(line, w_end - w_start, minlength=n) / words, 40) / 10
    out[:, k + 3] = np.log1p(n_words)
    out[:, k + 4] = length == 0
    return out


def line_features(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, first: np.ndarray, i: int, j: int) -> np.ndarray:
    """The features of lines i to j: their own, those of the lines before and after in the same row, and a constant."""
    low, high = max(i - 1, 0), min(j + 1, len(starts))
    own = own_features(data, starts[low:high], ends[low:high])
    out = np.zeros((j - i, N_FEATURES), np.float32)
    out[:, :OWN], out[:, -1] = own[i - low : j - low], 1
    begins, ends_ = np.zeros(len(own), bool), np.zeros(len(own), bool)
    begins[first[(first >= low) & (first < high)] - low] = True
    closes = first[1:] - 1
    ends_[closes[(closes >= low) & (closes < high)] - low] = True
    here = np.arange(i - low, j - low)
    has = here[~begins[here]]
    out[has - (i - low), OWN : 2 * OWN] = own[has - 1]
    has = here[~ends_[here]]
    out[has - (i - low), 2 * OWN : 3 * OWN] = own[has + 1]
    return out


def steps_of(emit: np.ndarray, trans: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """A 2 x 2 factor for each line, from the state before to its own; that of a row's first line doesn't look back."""
    top = np.maximum(emit, 0)
    own = np.stack([np.exp(-top), np.exp(emit - top)], 1)
    out = np.exp(trans - trans.max())[None] * own[:, None, :]
    out[begins] = own[begins][:, None, :]
    return out


def scan(steps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Running products of steps from the left, and of the steps after each from the right, inside stretches of equal length.

    Shapes (stretches, length, 2, 2); all are scaled, which no result depends on.
    """
    left, right = np.empty_like(steps), np.empty_like(steps)
    left[:, 0] = steps[:, 0]
    right[:, -1] = np.eye(2)
    for b in range(1, steps.shape[1]):
        x = left[:, b - 1] @ steps[:, b]
        left[:, b] = x / x.max((1, 2), keepdims=True)
    for b in range(steps.shape[1] - 2, -1, -1):
        x = steps[:, b + 1] @ right[:, b + 1]
        right[:, b] = x / x.max((1, 2), keepdims=True)
    return left, right


def unit(v: np.ndarray) -> np.ndarray:
    return v / v.sum(-1, keepdims=True)


def forward(steps: np.ndarray, alpha: np.ndarray) -> np.ndarray:
    """alpha carried over all steps."""
    return messages(steps, alpha, np.ones(2))[0][-1] if len(steps) else alpha


def messages(steps: np.ndarray, alpha: np.ndarray, beta: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Forward and backward messages of each line, scaled; alpha stands before the first line, beta behind the last."""
    n = len(steps)
    size = min(128, max(1, n // 8))
    rows = -(-n // size)
    padded = np.concatenate([steps, np.ones((rows * size - n, 2, 2))]).reshape(rows, size, 2, 2)
    if rows * size > n:
        padded.reshape(-1, 2, 2)[n:] = np.eye(2)
    left, right = scan(padded)
    before, behind = np.empty((rows, 2)), np.empty((rows, 2))
    a, b = unit(alpha), unit(beta)
    for r in range(rows):
        before[r] = a
        a = unit(a @ left[r, -1])
    whole = padded[:, 0] @ right[:, 0]
    for r in range(rows - 1, -1, -1):
        behind[r] = b
        b = unit(whole[r] @ b)
    fore = np.einsum("ri,rbij->rbj", before, left).reshape(-1, 2)[:n]
    back = np.einsum("rbij,rj->rbi", right, behind).reshape(-1, 2)[:n]
    return unit(fore), unit(back)


def marginals(emit: np.ndarray, trans: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(P(good) of each line, expected transition counts) of all chains at once.

    emit: score of good against bad; trans: 2 x 2 scores, from and to.
    """
    begins = np.zeros(len(emit), bool)
    begins[first[:-1]] = True
    steps = steps_of(emit, trans, begins)
    fore, back = messages(steps, np.ones(2), np.ones(2))
    good = unit(fore * back)[:, 1]
    i = np.flatnonzero(~begins)
    joint = fore[i - 1][:, :, None] * steps[i] * back[i][:, None, :]
    return good, (joint / joint.sum((1, 2), keepdims=True)).sum(0)


def train(examples: list[tuple[str, int]]) -> dict:
    y_doc = np.array([y for _, y in examples], float)
    if not len(y_doc) or y_doc.min() == y_doc.max():
        return {}
    column = pa.array([t for t, _ in examples], pa.large_string())
    data, offsets = batch_bytes(column)
    starts, ends, first = line_places(data, offsets)
    z = line_features(data, starts, ends, first, 0, len(starts))
    mean, dev = z.mean(0, dtype=np.float64), z.std(0, dtype=np.float64) + 1e-6
    mean[-1], dev[-1] = 0, 1
    z -= mean.astype(np.float32)
    z /= dev.astype(np.float32)
    y = np.repeat(y_doc, np.diff(first))
    inner = np.ones(len(y), bool)
    inner[first[1:] - 1] = False
    i = np.flatnonzero(inner)
    seen = np.array([[np.sum((1 - y[i]) * (1 - y[i + 1])), np.sum((1 - y[i]) * y[i + 1])], [np.sum(y[i] * (1 - y[i + 1])), np.sum(y[i] * y[i + 1])]])
    w, trans = np.zeros(z.shape[1]), np.zeros((2, 2))
    m_w, v_w, m_t, v_t = np.zeros_like(w), np.zeros_like(w), np.zeros_like(trans), np.zeros_like(trans)
    # Adam on the penalised likelihood; it is convex.
    for step in range(1, STEPS + 1):
        good, expected = marginals((z @ w.astype(np.float32)).astype(np.float64), trans, first)
        g_w = z.T @ (good - y).astype(np.float32) / len(y) + PENALTY * w
        g_t = (expected - seen) / len(y) + PENALTY * trans
        rate = 0.2 / (1 + step / 40)
        for m, v, g, target in ((m_w, v_w, g_w, w), (m_t, v_t, g_t, trans)):
            m[...] = 0.9 * m + 0.1 * g
            v[...] = 0.99 * v + 0.01 * g * g
            target -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    model = {"mean": mean, "dev": dev, "w": w, "trans": trans}
    del z
    model["calibration"] = labelled.logistic(document_features(column, model), y_doc)
    return model


def emissions(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, first: np.ndarray, i: int, j: int, model: dict) -> np.ndarray:
    x = line_features(data, starts, ends, first, i, j)
    return ((x - model["mean"]) / model["dev"]) @ model["w"]


def weighted_good(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, first: np.ndarray, model: dict) -> np.ndarray:
    """Each row's sums of line weights times P(good), and of line weights.

    Rows of many lines are worked on in blocks of LINES lines: one pass forward keeps
    the message before each block, one pass backward finishes block by block.
    """
    n_rows = len(first) - 1
    out = np.zeros((n_rows, 2))
    cuts = list(range(0, len(starts), LINES)) + [len(starts)]
    heads = np.searchsorted(first[:-1], cuts)
    blocks, befores = list(zip(cuts, cuts[1:])), []
    alpha = np.ones(2)

    def steps(k: int) -> np.ndarray:
        i, j = blocks[k]
        begins = np.zeros(j - i, bool)
        begins[first[:-1][heads[k] : heads[k + 1]] - i] = True
        return steps_of(emissions(data, starts, ends, first, i, j, model), model["trans"], begins)

    known = {}
    for k in range(len(blocks)):
        befores.append(alpha)
        known = {k: steps(k)}
        alpha = forward(known[k], alpha)
    beta = np.ones(2)
    for k in range(len(blocks) - 1, -1, -1):
        i, j = blocks[k]
        here = known.pop(k) if k in known else steps(k)
        fore, back = messages(here, befores[k], beta)
        good = unit(fore * back)[:, 1]
        weight = (ends[i:j] - starts[i:j] + 1).astype(np.float64)
        row = np.searchsorted(first, np.arange(i, j), side="right") - 1
        low, high = row[0], row[-1] + 1
        out[low:high, 0] += np.bincount(row - low, weight * good)
        out[low:high, 1] += np.bincount(row - low, weight)
        beta = here[0] @ back[0]
    return out


def document_features(column: pa.Array, model: dict) -> np.ndarray:
    """Log odds of the length-weighted mean probability of good lines, for each text."""
    data, offsets = batch_bytes(column)
    sums = weighted_good(data, *line_places(data, offsets), model)
    q = np.clip(sums[:, 0] / sums[:, 1], 1e-4, 1 - 1e-4)
    return np.log(q / (1 - q))[:, None]


def score(docs: DataFrame, labels: DataFrame, name: str = "score") -> DataFrame:
    """docs with the score as column `name`."""
    model = train(labelled.sample(docs, labels, "quality", FOLDS, HELD_OUT, SAMPLE_ROWS, SAMPLE_CHARS, LINE_COST))
    shift = float(np.log(THRESHOLD / (1 - THRESHOLD)))

    def scores(batch: pa.RecordBatch) -> list:
        if not model:
            return [np.full(len(batch), THRESHOLD)]
        out = [np.zeros(0)]
        for piece in pieces(batch, "text"):
            odds = labelled.decide(document_features(piece.column("text"), model), model["calibration"])
            out.append(1 / (1 + np.exp(-np.clip(odds + shift, -30, 30))))
        return [np.concatenate(out)]

    return append_columns(docs, [T.StructField(name, T.DoubleType())], scores)


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted for each row of docs."""
    return score(docs.select("doc_id", "text"), labels).select(
        "doc_id",
        (fold_of(F.col("doc_id"), FOLDS) == HELD_OUT).alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )
