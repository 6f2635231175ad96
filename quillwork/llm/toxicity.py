"""Toxicity by compression distance.

Two dictionaries are trained by zstandard, one on ordinary and one on toxic text.  A
text, A-Z lowered, is cut into overlapping windows of ``WINDOW_WORDS`` words.  Each is
compressed twice: with the ordinary dictionary alone, and with the toxic one before
it, so that the lengths differ only by what the toxic dictionary adds.  A document is
described by how many windows save at least as many bytes as three thresholds ask
for, each against the number expected of ordinary text, by the mean saving and by the
number of windows; a logistic model calibrated on the training documents turns that
into a score.

Most windows of a toxic document are ordinary, so the toxic dictionary is trained
again, ``ROUNDS`` times, on the windows of toxic documents that saved more than all
but a hundredth of the ordinary windows.  Savings used for choosing windows,
thresholds and calibration come from dictionaries trained on the other half of the
training documents (by a checksum of the text), as a window that is in a dictionary
saves most of its length.

Training takes at most ``SAMPLE_ROWS`` labelled documents, whole, and at most
``SAMPLE_CHARS`` characters in all.  Where zstandard has too little text to train on,
the end of that text is the dictionary.  Without a toxic or without an ordinary
example the score is 0.  Every text is scored whole; null, empty and blank texts have
no window and get the score of no evidence.  Equal rows get equal scores; columns
named like the result's are replaced.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillwork.llm import labelled
from quillwork.llm.packed import append_columns, batch_bytes, pieces, word_spans
from quillwork.llm.words import fold_of
from quillwork.plans.materialize import release

FOLDS, HELD_OUT, THRESHOLD = 5, 0, 0.5
SAMPLE_ROWS, SAMPLE_CHARS = 9_000, 16_000_000
WINDOW_WORDS, STEP_WORDS = 16, 8
#: Bytes of the ordinary dictionary, of the first toxic one and of the later ones at most, and at most one byte for so many of text.
ORDINARY_BYTES, FIRST_BYTES, TOXIC_BYTES = 250_000, 32_768, 4_096
ORDINARY_SHARE, FIRST_SHARE, TOXIC_SHARE = 1, 4, 8
#: Bytes of the segments that zstandard takes into an ordinary and into a toxic dictionary; short ones hold little but what recurs.
ORDINARY_SEGMENT, TOXIC_SEGMENT, MATCH = 64, 16, 8
#: zstandard trains no smaller ones.
LEAST_BYTES = 256
ROUNDS = 3
CHOICE, QUANTILES = 0.99, (0.9, 0.98, 0.998)
#: Windows that are compressed at once.
MOST_WINDOWS = 1 << 16
#: A-Z lowered, white space to blanks.
FOLDED = np.arange(256, dtype=np.uint8)
FOLDED[65:91] += 32
FOLDED[9:14] = 32


def windows(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(folded bytes; start, end and row of each window); the last window of a text is as long as the others."""
    data, offsets = batch_bytes(column)
    starts, ends, rows = word_spans(data, offsets)
    n_rows = len(offsets) - 1
    first = np.searchsorted(rows, np.arange(n_rows + 1))
    words = np.diff(first)
    count = np.where(words > WINDOW_WORDS, -(-(words - WINDOW_WORDS) // STEP_WORDS) + 1, np.minimum(words, 1))
    row = np.repeat(np.arange(n_rows), count)
    place = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
    a = first[row] + np.minimum(place * STEP_WORDS, np.maximum(words[row] - WINDOW_WORDS, 0))
    b = np.minimum(a + WINDOW_WORDS, first[row + 1]) - 1
    return FOLDED[data], starts[a], ends[b], row


def dictionary(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, size: int, share: int, segment: int) -> bytes:
    """A dictionary that zstandard trains on the given windows, each with the blank before it."""
    size = min(size, max(LEAST_BYTES, int((ends - starts).sum()) // share))
    raw = memoryview(data)
    samples = [bytes(raw[max(i - 1, 0) : j]) for i, j in zip(starts.tolist(), ends.tolist()) if j - i >= MATCH]
    try:
        return zstandard.train_dictionary(size, samples, k=segment, d=MATCH).as_bytes()
    except zstandard.ZstdError:  # too little text
        return b"".join(samples)[-size:]


def compressor(content: bytes) -> zstandard.ZstdCompressor:
    how = zstandard.ZstdCompressionParameters(
        window_log=19, hash_log=17, chain_log=17, search_log=5, min_match=4, target_length=32, strategy=zstandard.STRATEGY_GREEDY,
        write_content_size=False, write_checksum=False, write_dict_id=False,
    )
    held = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    held.precompute_compress(compression_params=how)
    return zstandard.ZstdCompressor(dict_data=held, compression_params=how)


def lengths(how: zstandard.ZstdCompressor, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Compressed length of each window."""
    if not len(starts):
        return np.zeros(0, np.int64)
    places = np.stack([starts, ends - starts], 1).astype(np.uint64)
    out = np.empty(len(starts), np.int64)
    for i in range(0, len(out), MOST_WINDOWS):
        made = how.multi_compress_to_buffer(zstandard.BufferWithSegments(data, places[i : i + MOST_WINDOWS].tobytes()))
        out[i : i + MOST_WINDOWS] = np.fromiter(map(len, made), np.int64, len(made))
    return out


def describe(saved: np.ndarray, row: np.ndarray, n_rows: int, thresholds: list[int], expected: list[float]) -> np.ndarray:
    """The features of each row from the bytes that each window saves."""
    count = np.bincount(row, minlength=n_rows)
    out = np.zeros((n_rows, len(thresholds) + 2))
    for k, (least, share) in enumerate(zip(thresholds, expected)):
        # Square roots of counts vary alike whatever the counts.
        out[:, k] = np.sqrt(np.bincount(row, saved >= least, minlength=n_rows) + 0.375) - np.sqrt(share * count + 0.375)
    out[:, -2] = np.bincount(row, saved, minlength=n_rows) / np.sqrt(np.maximum(count, 1))
    out[:, -1] = np.log1p(count)
    return out


def train(examples: list[tuple[str, int]]) -> dict:
    y = np.array([label == 1 for _, label in examples], float)
    texts = pa.RecordBatch.from_arrays([pa.array([t for t, _ in examples], pa.large_string())], names=["text"])
    found, at, n = [], 0, 0
    for piece in pieces(texts, "text"):  # of bounded size, as spans of words take several times the text
        data, starts, ends, row = windows(piece.column("text"))
        found.append((data, starts + at, ends + at, row + n))
        at, n = at + len(data), n + len(piece)
    if not found:
        return {}
    data, starts, ends, row = (np.concatenate(x) for x in zip(*found))
    toxic = y[row] > 0
    if not toxic.any() or toxic.all():
        return {}
    half = np.array([zlib.crc32(t.encode("utf-8", "surrogatepass")) & 1 for t, _ in examples])[row]
    both = all((half[toxic == kind] == h).any() for kind in (False, True) for h in (0, 1))
    sides = [(half == h, half != h) for h in (0, 1)] if both else [(half >= 0, half >= 0)]
    plain_of = lambda use: dictionary(data, starts[use], ends[use], ORDINARY_BYTES, ORDINARY_SHARE, ORDINARY_SEGMENT)
    toxic_of = lambda use, size, share: dictionary(data, starts[use], ends[use], size, share, TOXIC_SEGMENT)
    plain = [plain_of(~toxic & learnt) for learnt, _ in sides]
    base, saved = np.zeros(len(row), np.int64), np.zeros(len(row), np.int64)
    for ordinary, (_, told) in zip(plain, sides):
        base[told] = lengths(compressor(ordinary), data, starts[told], ends[told])
    chosen = toxic
    for turn in range(ROUNDS + 1):
        size = (TOXIC_BYTES, TOXIC_SHARE) if turn else (FIRST_BYTES, FIRST_SHARE)
        for ordinary, (learnt, told) in zip(plain, sides):
            if (chosen & learnt).any():
                added = toxic_of(chosen & learnt, *size)
                saved[told] = base[told] - lengths(compressor(added + ordinary), data, starts[told], ends[told])
        if turn < ROUNDS:
            better = toxic & (saved > max(0.0, float(np.quantile(saved[~toxic], CHOICE))))
            chosen = better if better.any() else chosen
    thresholds: list[int] = []
    for q in QUANTILES:
        thresholds.append(max(int(np.quantile(saved[~toxic], q)) + 1, thresholds[-1] + 1 if thresholds else 1))
    expected = [float((saved[~toxic] >= t).mean()) for t in thresholds]
    features = describe(saved, row, len(examples), thresholds, expected)
    ordinary = plain_of(~toxic)
    return {
        "ordinary": ordinary, "toxic": toxic_of(chosen, TOXIC_BYTES, TOXIC_SHARE) + ordinary,
        "thresholds": thresholds, "expected": expected, "calibration": labelled.logistic(features, y),
    }


class Scorer:
    """Scores of texts by a trained model."""

    def __init__(self, model: dict) -> None:
        self.model = model
        self.ordinary, self.toxic = compressor(model["ordinary"]), compressor(model["toxic"])

    def __call__(self, column: pa.Array) -> np.ndarray:
        data, starts, ends, row = windows(column)
        saved = lengths(self.ordinary, data, starts, ends) - lengths(self.toxic, data, starts, ends)
        x = describe(saved, row, len(column), self.model["thresholds"], self.model["expected"])
        return 1 / (1 + np.exp(-np.clip(labelled.decide(x, self.model["calibration"]), -30, 30)))


def score(docs: DataFrame, labels: DataFrame, name: str = "score") -> DataFrame:
    """docs with the score as column `name`; a text passes through Python once."""
    examples = labelled.sample(docs, labels, "toxic", FOLDS, HELD_OUT, SAMPLE_ROWS, SAMPLE_CHARS)
    release(docs.sparkSession)  # what collecting the sample took, before training takes its own
    model = train(examples)
    del examples
    release(docs.sparkSession)
    scorers: list[Scorer] = []

    def scores(batch: pa.RecordBatch) -> list:
        if not model:
            return [np.zeros(len(batch))]
        if not scorers:
            scorers.append(Scorer(model))
        return [np.concatenate([np.zeros(0), *(scorers[0](piece.column("text")) for piece in pieces(batch, "text"))])]

    return append_columns(docs, [T.StructField(name, T.DoubleType())], scores)


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted for each row of docs."""
    return score(docs.select("doc_id", "text"), labels).select(
        "doc_id",
        (fold_of(F.col("doc_id"), FOLDS) == HELD_OUT).alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )


def reject(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs without the rows that are scored toxic."""
    return score(docs, labels, "_toxic").filter(F.col("_toxic") < THRESHOLD).drop("_toxic")
