"""Language-model scores by a probabilistic suffix tree over words.

Symbols are words, A-Z lowered, and one end a text; the start of a text is a symbol
too, before the first.  Contexts are the symbols before a position, one of them or
more.  The tree grows from its root level by level: a context of k symbols is examined
if it occurs MIN_COUNT times at least, its suffix of k - 1 symbols is a state, and its
first k - 1 symbols were examined, so that its own count is known.  It becomes a state if a divergence test retains it: the log-likelihood that its
next-symbol distribution gains over that of its longest retained suffix must exceed
what its parameters cost (half a logarithm of its count each).  Growth ends with the
first level that retains nothing, so contexts are as long as the corpus asks for.  (A
context with one sure successor gains nothing by more symbols, so growth ends inside
passages that many texts share.)

A state lists the symbols that follow it MIN_COUNT times at least.  Its distribution
mixes their counts with its parent's distribution; symbols it doesn't list keep the
parent's probabilities, scaled so that all sum to 1.  The root is the smoothed
distribution of single symbols.  A position is scored by the state of the longest
suffix.

MIN_COUNT is all that bounds the tree, so it grows with the corpus.  Counts are made
by numpy inside workers: each emits its keys as packed arrays, dealt by ranges of the
key, and what meets in one part of the key space is summed up there.  States and
transitions are tables, made level by level; none is held whole by a worker or the
driver.

A score is a sum of independent lookups: a state adds its scale wherever its context
occurs, and a listed transition adds what it differs from that scale and from the
parent's probability.  Workers hold the values of the most frequent keys, those that
are a share HEAD of the tokens, however large the corpus; all other lookups are dealt to the parts of the key
space as packed arrays and their sums come back.  The head, and bit maps that leave
out keys which no table has, change the cost, not the result.

Null texts are empty: they have the end alone.  Equal rows are separate texts.
Without training texts all counts are 0 and only the smoothing speaks.  Other columns
than doc_id and text are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillwork.llm.packed import batch_bytes, mix64, pieces, span_hashes, word_spans
from quillwork.llm.words import fold_of
from quillwork.plans.batches import bounded_batches
from quillwork.plans.materialize import discard, materialize, release

FOLDS, HELD_OUT = 5, 1
MIN_COUNT = 4
#: Workers hold the values of keys that make up such a share of all tokens; there are 1 / HEAD of words and of each level at most.
HEAD = 5e-7
#: From this level on a pass over the texts counts as many levels as were counted before it; so few contexts are left by then.
DEEP = 5
#: Parts of the key space for each partition of a shuffle.
PARTS = 4
#: Bytes of the batches of texts and packed arrays that a worker gets.
BATCH_BYTES = 8 << 20
#: Bytes of packed rows that a worker hands on at once.
ROW_BYTES = 1 << 20
END_HASH = np.uint64(0)
START_HASH = np.uint64(0x5DEECE66D1234567)
#: 64-bit words of a bit map at most: 8 MB.
MAP_WORDS = 1 << 20


def symbols(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each symbol, the end included; where each row starts, with the end)."""
    data, offsets = batch_bytes(batch.column("text"))
    starts, ends, rows = word_spans(data, offsets)
    n_rows = len(offsets) - 1
    counts = np.bincount(rows, minlength=n_rows)
    first = np.concatenate([[0], np.cumsum(counts + 1)])
    out = np.empty(first[-1], np.uint64)
    last = first[1:] - 1
    is_word = np.ones(len(out), bool)
    is_word[last] = False
    out[is_word] = np.maximum(span_hashes(data, starts, ends), np.uint64(1))
    out[last] = END_HASH
    return out, first


def joined(prefix: np.ndarray, suffix: np.ndarray) -> np.ndarray:
    """Key of the symbols of which prefix leaves out the last and suffix the first."""
    return mix64((prefix ^ (prefix >> np.uint64(32))) * np.uint64(0xDA942042E4DD58B5) + suffix)


def climb(hashes: np.ndarray, first: np.ndarray, depth: int, known: Callable, deep: Callable) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(level, position, prefix, suffix, key) of the transitions at each level, up to depth.

    A transition from k symbols is made of two from k - 1 symbols that known(level,
    keys) leaves, the second from a state, as deep(level, keys) tells.
    """
    before = np.empty(len(hashes), np.uint64)
    before[1:] = hashes[:-1]
    starts = first[:-1]
    before[starts] = START_HASH
    use = known(0, hashes) & known(0, before)
    at = np.flatnonzero(use)
    prefix, suffix = before[at], hashes[at]
    for level in range(1, depth + 1):
        key = joined(prefix, suffix)
        yield level, at, prefix, suffix, key
        left = known(level, key)
        at, key = at[left], key[left]
        # Neighbours in one text: no transition at a first symbol has one before it there.
        pair = np.flatnonzero(at[1:] == at[:-1] + 1) + 1
        if not len(pair):
            return
        is_first = np.zeros(len(hashes), bool)
        is_first[starts] = True
        pair = pair[~is_first[at[pair]]]
        pair = pair[deep(level, key[pair])]
        at, prefix, suffix = at[pair], key[pair - 1], key[pair]


class Bits:
    """Bit maps of listed keys, and of those that are transitions from states; other keys may share a bit."""

    def __init__(self, types: int) -> None:
        words = min(MAP_WORDS, 1 << max(6, types // 2).bit_length())
        self.listed, self.from_state = np.zeros(words, np.uint64), np.zeros(words, np.uint64)

    def add(self, keys: DataFrame) -> None:
        """keys: (key, deep)."""
        word = F.expr(f"shiftright(key, 6) & {len(self.listed) - 1}L").alias("w")
        bit = "shiftleft(1L, cast(key & 63L as int))"
        found = keys.groupBy(word).agg(F.expr(f"bit_or({bit})").alias("a"), F.expr(f"bit_or(if(deep, {bit}, 0L))").alias("b")).toArrow()
        at = found.column("w").to_numpy()
        for bits, name in ((self.listed, "a"), (self.from_state, "b")):
            bits[at] |= found.column(name).to_numpy().astype(np.int64).view(np.uint64)

    @staticmethod
    def has(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
        word = bits[(keys >> np.uint64(6)) & np.uint64(len(bits) - 1)]
        return (word >> (keys & np.uint64(63))) & np.uint64(1) > 0


def n_parts(spark: SparkSession) -> int:
    return PARTS * int(spark.conf.get("spark.sql.shuffle.partitions"))


def dealt(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Packed rows dealt by keys over the shuffle's partitions, each in order."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys).sortWithinPartitions(*order)


def by_part(keys: np.ndarray, parts: int) -> Iterator[tuple[int, np.ndarray]]:
    """(part, places of its keys)."""
    part = ((keys >> np.uint64(40)) % np.uint64(parts)).astype(np.min_scalar_type(parts))  # numbers of 16 bits are sorted by their digits
    order = np.argsort(part, kind="stable")
    ends = np.searchsorted(part[order], np.arange(parts + 1, dtype=part.dtype))
    for k in np.flatnonzero(np.diff(ends)):
        yield int(k), order[ends[k] : ends[k + 1]]


def order_of(keys: np.ndarray) -> np.ndarray:
    """Places of hashed keys in ascending order, equal ones as they come.

    Sorts the keys' high bits with their places in the low ones, as numbers are sorted
    much faster than places are; where that isn't the keys' order, places are.
    """
    low = np.uint64((1 << int(len(keys)).bit_length()) - 1)
    order = (keys & ~low) | np.arange(len(keys), dtype=np.uint64)
    order.sort()
    order = (order & low).astype(np.int64)
    ranked = keys[order]
    return np.argsort(keys, kind="stable") if (ranked[1:] < ranked[:-1]).any() else order


def distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order of the keys, where each distinct one begins in it, how often it occurs)."""
    order = order_of(keys)
    ranked = keys[order]
    begin = np.flatnonzero(np.concatenate([[len(keys) > 0], ranked[1:] != ranked[:-1]]))
    return order, begin, np.diff(np.append(begin, len(keys)))


def packed(*arrays: np.ndarray) -> bytes:
    return b"".join(a.tobytes() for a in arrays)


def unpacked(data: bytes, *kinds: type) -> list[np.ndarray]:
    n = len(data) // sum(np.dtype(k).itemsize for k in kinds)
    out, at = [], 0
    for k in kinds:
        out.append(np.frombuffer(data, k, n, at))
        at += n * np.dtype(k).itemsize
    return out


def stretches(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[tuple, Iterator[tuple]]]:
    """Consecutive rows with equal keys, as (key, rows without the keys)."""
    rows = (row for batch in batches for row in zip(*(batch.column(i).to_pylist() for i in range(batch.num_columns))))
    n = len(keys)
    for key, same in groupby(rows, key=lambda r: r[:n]):
        yield key, (r[n:] for r in same)


def as_rows(found: list[tuple[int, int, int | None, bytes]]) -> pa.RecordBatch:
    types = [pa.int32(), pa.int32(), pa.int64(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in found], t) for i, t in enumerate(types)], names=["part", "kind", "uid", "data"])


def as_batches(rows: Iterator[tuple[int, int, int | None, bytes]]) -> Iterator[pa.RecordBatch]:
    """Rows in batches of about ROW_BYTES, as a batch costs more than a short row."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row[3])
        if size >= ROW_BYTES:
            yield as_rows(held)
            held, size = [], 0
    if held:
        yield as_rows(held)


def counted(docs: DataFrame, levels: range, bits: Bits | None) -> DataFrame:
    """A table (level, key, prefix, suffix, c) of the transitions from contexts of so many symbols that occur MIN_COUNT times at least.

    Level 0 stands for single symbols, all of them, with the symbol as prefix.  Without
    bits, all transitions are counted; bits know the levels below the first.
    """
    spark = docs.sparkSession
    parts, shared = n_parts(spark), spark.sparkContext.broadcast(bits)
    least, top, low = MIN_COUNT, levels[-1], max(levels[0], 1)

    def emit(level: int, prefix: np.ndarray, suffix: np.ndarray, key: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
        names = ["level", "part", "data"]
        rows = [(level, part, packed(prefix[i], suffix[i], counts[i].astype(np.uint32))) for part, i in by_part(key, parts)]
        types = [pa.int32(), pa.int32(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yes = lambda keys: np.ones(len(keys), bool)
        known = lambda level, keys: yes(keys) if not bits or level >= low else Bits.has(shared.value.listed, keys)
        deep = lambda level, keys: yes(keys) if not bits or level >= low else Bits.has(shared.value.from_state, keys)
        for whole in batches:
            for batch in pieces(whole, "text"):
                hashes, first = symbols(batch)
                if 0 in levels:
                    values, counts = np.unique(hashes, return_counts=True)
                    yield emit(0, values, values, joined(values, values), counts)
                for level, _, prefix, suffix, key in climb(hashes, first, top, known, deep):
                    if level in levels and len(key):
                        order, begin, counts = distinct(key)
                        at = order[begin]
                        yield emit(level, prefix[at], suffix[at], key[at], counts)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (level, _), rows in stretches(batches, ["level", "part"]):
            prefix, suffix, counts = (np.concatenate(x) for x in zip(*(unpacked(r[0], np.uint64, np.uint64, np.uint32) for r in rows)))
            key = joined(prefix, suffix)
            order, begin, _ = distinct(key)
            total = np.add.reduceat(counts[order].astype(np.int64), begin)
            at = order[begin]
            if level:
                often = total >= least
                at, total = at[often], total[often]
            columns = [pa.array(np.full(len(at), level, np.int32)), *(pa.array(x[at].view(np.int64)) for x in (key, prefix, suffix)), pa.array(total)]
            yield pa.RecordBatch.from_arrays(columns, names=["level", "key", "prefix", "suffix", "c"])

    rows = docs.filter("not held_out").mapInArrow(count, "level int, part int, data binary")
    out = dealt(rows, ["level", "part"], ["level", "part"]).mapInArrow(add, "level int, key bigint, prefix bigint, suffix bigint, c bigint")
    out = materialize(out, "lm-counts")
    shared.destroy()
    release(spark)
    return out


def grow(found: DataFrame, model: DataFrame) -> tuple[DataFrame, DataFrame]:
    """States (key, n, kinds, scale) among the contexts of found(key, prefix, suffix, c), and its transitions (key, prefix, suffix, c, lp, v, deep).

    model(key, c, lp, deep): the contexts and suffixes, how often they occur, log10 of the
    last symbol's probability after the others, and whether those are a state.  lp and
    deep are the same one level deeper, v what a lookup adds.
    """
    known = found.join(model.filter("deep").select(F.col("key").alias("suffix"), F.col("lp").alias("lq")), "suffix")
    known = materialize(known.select("key", "prefix", "suffix", "c", "lq"), "lm-known")
    q = F.pow(F.lit(10.0), "lq")
    sums = known.groupBy("prefix").agg(
        F.count("*").alias("kinds"), F.sum("c").alias("listed"), F.sum(q).alias("listed_q"), F.sum(F.col("c") * F.log(F.col("c") / q)).alias("gain")
    )
    sums = sums.join(model.select(F.col("key").alias("prefix"), F.col("c").alias("n")), "prefix")
    sums = sums.withColumn("rest", F.greatest(F.col("n") - F.col("listed"), F.lit(0))).withColumn("rest_q", F.greatest(1 - F.col("listed_q"), F.lit(1e-9)))
    gain = F.col("gain") - F.col("listed") * F.log("n") + F.when(F.col("rest") > 0, F.col("rest") * F.log(F.col("rest") / (F.col("n") * F.col("rest_q")))).otherwise(0.0)
    kept = sums.filter(gain > 0.5 * (F.col("kinds") + 1) * F.log(F.greatest("n", F.lit(2))))
    sum_p = (F.col("listed") + F.col("kinds") * F.col("listed_q")) / (F.col("n") + F.col("kinds"))
    scale = F.log10(F.greatest(1 - sum_p, F.lit(1e-9)) / F.col("rest_q"))
    kept = materialize(kept.select(F.col("prefix").alias("key"), "n", "kinds", scale.alias("scale")), "lm-states")
    all_ = known.join(kept.withColumnRenamed("key", "prefix"), "prefix", "left")
    p = F.log10((F.col("c") + F.col("kinds") * q) / (F.col("n") + F.col("kinds")))
    value = F.coalesce(p - F.col("scale") - F.col("lq"), F.lit(0.0))
    all_ = all_.select("key", "prefix", "suffix", "c", F.coalesce(p, "lq").alias("lp"), value.alias("v"), F.col("kinds").isNotNull().alias("deep"))
    out = materialize(all_, "lm-transitions")
    discard(known)
    return kept, out


@dataclass
class Tree:
    """The tables of a tree: words(key, c), and a level each states(key, n, kinds, scale) and transitions(key, prefix, suffix, c, lp, v, deep)."""

    words: DataFrame
    total: int
    types: int
    start_scale: float
    states: list[DataFrame]
    transitions: list[DataFrame]
    bits: Bits

    @property
    def divisor(self) -> float:
        return float(self.total + 0.5 * (self.types + 1))

    def values(self) -> DataFrame:
        """(level, key, c, v): what a lookup of each key adds, of words besides the root's part."""
        made = [self.words.select("key", "c", F.lit(0.0).alias("v")), *(t.select("key", "c", "v") for t in self.transitions)]
        out = []
        for level, keys in enumerate(made):
            if level < len(self.states):  # a state adds its scale wherever its context occurs
                keys = keys.join(self.states[level].select("key", "scale"), "key", "left")
                keys = keys.select("key", "c", (F.col("v") + F.coalesce("scale", F.lit(0.0))).alias("v"))
            out.append(keys.filter("v != 0" if level else "true").select(F.lit(level).alias("level"), "key", "c", "v"))
        return reduce(DataFrame.unionAll, out)

    def discard(self) -> None:
        for t in (self.words, *self.states, *self.transitions):
            discard(t)


def learn(docs: DataFrame) -> Tree:
    """The tree of the texts of docs(held_out, text) that aren't held out."""
    spark = docs.sparkSession
    found = counted(docs, range(0, 2), None)
    words = materialize(found.filter("level = 0").select(F.col("prefix").alias("key"), "c"), "lm-words")
    total, types = words.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    n_texts = words.filter("key = 0").agg(F.coalesce(F.sum("c"), F.lit(0))).first()[0]
    start = int(START_HASH.view(np.int64))
    tree = Tree(words, int(total), int(types), 0.0, [], [], Bits(types))
    texts = spark.range(1).select(F.lit(start).cast("long").alias("key"), F.lit(n_texts).cast("long").alias("c"), F.lit(0.0).alias("lp"), F.lit(True).alias("deep"))
    root = F.log10((F.col("c") + 0.5) / F.lit(tree.divisor))
    model = words.filter(F.col("c") >= MIN_COUNT).select("key", "c", root.alias("lp"), F.lit(True).alias("deep")).unionAll(texts)
    tree.bits.add(model)
    levels = range(0, 2)
    while True:
        for level in levels:
            if level:
                kept, out = grow(found.filter(F.col("level") == level).drop("level"), model)
                release(spark)
                if level == 1:
                    tree.start_scale = float(sum(r.scale for r in kept.filter(F.col("key") == start).collect()))
                if kept.limit(1).count() == 0:
                    discard(out)
                    discard(found)
                    return tree
                tree.states.append(kept)
                tree.transitions.append(out)
                model = out.select("key", "c", "lp", "deep")
                tree.bits.add(model)
        discard(found)
        levels = range(levels[-1] + 1, (levels[-1] + 1) * (2 if levels[-1] + 1 >= DEEP else 1) + (levels[-1] + 1 < DEEP))
        found = counted(docs, levels, tree.bits)


class Slots:
    """Values of some keys, found by two places each; keys beyond two a place are left out, the rarest first."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray, *values: np.ndarray) -> None:
        size = 1 << max(1, int(len(keys) - 1).bit_length())
        self.mask = np.uint64(size - 1)
        place = (keys & self.mask).astype(np.int64)
        order = np.lexsort((-counts, place))
        nth = np.arange(len(order)) - np.searchsorted(place[order], place[order])
        order, nth = order[nth < 2], nth[nth < 2]
        at = place[order] * 2 + nth
        self.keys = np.zeros(2 * size, np.uint64)
        self.used = np.zeros(2 * size, bool)
        self.values = [np.zeros(2 * size) for _ in values]
        self.keys[at], self.used[at] = keys[order], True
        for mine, given in zip(self.values, values):
            mine[at] = given[order]

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place of each key, whether it is there)."""
        at = (keys & self.mask).astype(np.int64) * 2
        at += self.keys[at] != keys
        return at, (self.keys[at] == keys) & self.used[at]


class Reader:
    """What workers know when they score: frequent keys, and which other keys there are."""

    def __init__(self, tree: Tree, table: DataFrame, rest: np.ndarray) -> None:
        self.depth, self.start = len(tree.transitions), tree.start_scale
        self.unknown = float(np.log10(0.5) - np.log10(tree.divisor))
        self.bits, self.rest = tree.bits, rest
        is_word = F.col("level") == 0
        found = []
        for word in (True, False):
            frequent = table.filter((is_word == word) & (F.col("c") >= F.lit(max(1.0, HEAD * tree.total)))).select("key", "c", "v")
            key, c, v = (x.to_numpy() for x in frequent.toArrow().columns)
            found.append((key.astype(np.int64).view(np.uint64), c.astype(np.float64), v.astype(np.float64)))
        (key, c, v), grams = found
        self.words = Slots(key, c, np.log10((c + 0.5) / tree.divisor), v)
        self.grams = Slots(*grams[:2], grams[2])

    def read(self, hashes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(known, base and score of each row as far as the frequent keys tell; row and key of each lookup that is left)."""
        n = np.diff(first)
        row = np.repeat(np.arange(len(n)), n)
        at, here = self.words.find(hashes)
        base = np.where(here, self.words.values[0][at], self.unknown)
        score = base + np.where(here, self.words.values[1][at], 0.0)
        score[first[:-1]] += self.start
        known_words, other = here, np.flatnonzero(~here)
        other = other[Bits.has(self.rest, hashes[other])]
        rows, keys = [row[other]], [hashes[other]]
        known = lambda level, k: Bits.has(self.bits.listed, k)
        for _, at, _, _, key in climb(hashes, first, self.depth, known, lambda level, k: Bits.has(self.bits.from_state, k)):
            slot, here = self.grams.find(key)
            score[at[here]] += self.grams.values[0][slot[here]]
            left = np.flatnonzero(~here)
            left = left[Bits.has(self.rest, key[left])]
            rows.append(row[at[left]])
            keys.append(key[left])
        add = lambda x: np.bincount(row, x, minlength=len(n))
        return add(known_words).astype(np.int64), add(base), add(score), np.concatenate(rows), np.concatenate(keys)


def score(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score for each row of docs."""
    spark = docs.sparkSession
    told = docs.select("doc_id", (fold_of(F.col("doc_id"), FOLDS) == HELD_OUT).alias("held_out"), "text")
    with bounded_batches(spark, BATCH_BYTES):
        tree = learn(told)
    table = materialize(tree.values(), "lm-values")
    total = tree.total
    rest = Bits(tree.types)
    rest.add(table.select("key", F.lit(False).alias("deep")))
    reader = spark.sparkContext.broadcast(Reader(tree, table, rest.listed))
    tree.discard()
    release(spark)
    parts = n_parts(spark)

    row_type = "part int, kind int, uid bigint, data binary"

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """For each piece of the texts its lookups by part (kind 1), and its rows with what the frequent keys tell (kind 2)."""
        uid = TaskContext.get().partitionId() << 40
        for whole in batches:
            for batch in pieces(whole, "text", 2 << 20):
                hashes, first = symbols(batch)
                known, base, sums, rows, keys = reader.value.read(hashes, first)
                columns = [batch.column("doc_id"), batch.column("held_out"), *map(pa.array, (np.diff(first), known, base, sums))]
                told_ = pa.RecordBatch.from_arrays(columns, names=["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"])
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, told_.schema) as out:
                    out.write_batch(told_)
                lookups = [(part, 1, uid, packed(keys[i], rows[i].astype(np.uint32))) for part, i in by_part(keys, parts)]
                yield as_rows([*lookups, (uid % parts, 2, uid, sink.getvalue().to_pybytes())])
                uid += len(batch)

    def values(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The table by part (kind 0)."""
        for batch in batches:
            level, key, c, v = (batch.column(x).to_numpy() for x in ("level", "key", "c", "v"))
            word = level == 0
            more = np.where(word, np.log10(c + 0.5) - np.log10(0.5), 0.0)
            key = key.view(np.uint64)
            yield as_rows([(part, 0, None, packed(key[i], v[i], more[i], word[i])) for part, i in by_part(key, parts)])

    def looked(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        """The sums of each piece's lookups in a part (kind 1); other rows pass."""
        for (part,), rows in stretches(batches, ["part"]):
            held, table_ = [], None
            for kind, uid, data in rows:
                if kind == 0:
                    held.append(unpacked(data, np.uint64, np.float64, np.float64, np.bool_))
                elif kind == 2:
                    yield part, kind, uid, data
                elif held:
                    if table_ is None:
                        table_ = [np.concatenate(x) for x in zip(*held)]
                        table_ = [x[np.argsort(table_[0])] for x in table_]
                    key, v, more, word = table_
                    asked, row = unpacked(data, np.uint64, np.uint32)
                    at = np.searchsorted(key, asked)
                    at[at == len(key)] = 0
                    hit = key[at] == asked
                    at, row = at[hit], row[hit]
                    doc = np.flatnonzero(np.bincount(row))
                    add = lambda x: np.bincount(row, x[at])[doc].astype(np.float64)  # noqa: B023, E731
                    yield part, kind, uid, packed(doc.astype(np.uint32), add(word).astype(np.uint32), add(more), add(more + v))

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return as_batches(looked(batches))

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The rows of each piece, with the sums of its lookups."""
        for _, rows in stretches(batches, ["uid"]):
            sums, own = [], None
            for _, kind, data in rows:
                if kind == 2:
                    own = pa.ipc.open_stream(data).read_next_batch()
                else:
                    sums.append(unpacked(data, np.uint32, np.uint32, np.float64, np.float64))
            columns = own.columns
            if sums:
                doc, *added = (np.concatenate(x) for x in zip(*sums))
                columns[3:] = [pa.array(c.to_numpy() + np.bincount(doc, x, len(own)).astype(c.to_numpy().dtype)) for c, x in zip(columns[3:], added)]
            yield pa.RecordBatch.from_arrays(columns, names=own.schema.names)

    asked = table.mapInArrow(values, row_type).unionAll(told.mapInArrow(read, row_type))
    sums = dealt(asked, ["part"], ["part", "kind", "uid"]).mapInArrow(look, row_type)
    kind = docs.schema["doc_id"].dataType.simpleString()
    scored = dealt(sums.select("uid", "part", "kind", "data"), ["uid"], ["uid"])
    scored = scored.mapInArrow(gather, f"doc_id {kind}, held_out boolean, n_tokens bigint, n_known bigint, base_score double, score double")
    with bounded_batches(spark, BATCH_BYTES):
        scored = materialize(scored, "lm-scores")
    reader.destroy()
    discard(table)
    release(spark)
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), "base_score", "score")
