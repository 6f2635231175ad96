"""Bounded samples of labelled documents, and logistic calibration."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillwork.llm.words import fold_of
from quillwork.plans.materialize import discard, materialize


def sample(docs: DataFrame, labels: DataFrame, label: str, folds: int, held_out: int, rows: int, chars: int, line_cost: int = 0) -> list[tuple[str, int]]:
    """(text, label) of documents outside the held-out fold, in the order of a hash of the id, whole texts of any length.

    The sample ends after ``rows`` documents, or before the one with which it would
    exceed ``chars`` characters (each line counting ``line_cost`` more); the first is
    always taken.  That bounds what reaches the driver.  Labels are joined with the
    documents before anything is bounded, so only documents that are there, have a
    text and are labelled in one way count.
    """
    told = labels.filter(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id")
    told = told.agg(F.min(label).alias("_y"), F.max(label).alias("_z")).filter("_y = _z").select("doc_id", "_y")
    cost = F.length("text").cast("long")
    if line_cost:
        cost = cost + line_cost * (F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) + 1)
    mine = docs.filter(F.col("text").isNotNull() & (fold_of(F.col("doc_id"), folds) != held_out)).withColumn("_cost", cost)
    order = ["_h", "doc_id", "_cost"]
    found = mine.select("doc_id", "_cost").join(told, "doc_id").withColumn("_h", F.xxhash64(F.lit(7), "doc_id"))
    found = materialize(found, "labelled")
    share = (1.1 * rows + 200) / max(found.count(), 1)
    # The sample's share of the hashes and some more, so that tasks don't send a full sample each.
    near = found if share >= 1 else found.filter(F.col("_h") <= int((share - 0.5) * 2**64))
    picked = near.orderBy(*order).limit(rows).select(*order).collect()
    ends = np.cumsum([r["_cost"] for r in picked])
    n = max(int(np.searchsorted(ends, chars, side="right")), min(1, len(picked)))
    if not n:
        return []
    last = F.struct(*[F.lit(picked[n - 1][c]).alias(c) for c in order])
    wanted = near.filter(F.struct(*order) <= last).distinct()  # at most `rows` rows of numbers
    texts = mine.select("doc_id", "_cost", "text").join(F.broadcast(wanted), ["doc_id", "_cost"])
    out = texts.orderBy(*order, "text").limit(n).select("text", "_y").collect()
    discard(found)
    return [(r[0], int(r[1])) for r in out]


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.05, steps: int = 40) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(mean, deviation, weights with the intercept last) by damped Newton steps on standardised features."""
    mean, dev = x.mean(0), x.std(0) + 1e-9
    z = np.c_[(x - mean) / dev, np.ones(len(x))]
    w = np.zeros(z.shape[1])
    penal = np.full(len(w), ridge)
    penal[-1] = 1e-6

    def loss(v: np.ndarray) -> float:
        return float(np.logaddexp(0, np.where(y > 0, -1, 1) * (z @ v)).sum() + (penal * v * v).sum() / 2)

    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z.T * (p * (1 - p))) @ z + np.diag(penal) + 1e-9 * np.eye(len(w)), z.T @ (p - y) + penal * w)
        size = 1.0
        while size > 1e-4 and loss(w - size * step) > loss(w):
            size /= 2
        w = w - size * step
        if size * np.abs(step).max() < 1e-6:
            break
    return mean, dev, w


def decide(x: np.ndarray, model: tuple[np.ndarray, np.ndarray, np.ndarray]) -> np.ndarray:
    """Log odds."""
    mean, dev, w = model
    return ((x - mean) / dev) @ w[:-1] + w[-1]
