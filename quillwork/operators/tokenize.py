"""Tokenizing, detokenizing and translating between vocabularies.

A vocabulary is a bounded lookup that travels to each worker once.  Pieces recur,
so a worker keeps the ids of those it has seen in a table of bounded size; texts
are never shuffled for that.  Only distinct pieces become Python objects; all others,
and the ids, stay in Arrow's buffers.
"""

from __future__ import annotations

import base64
import heapq
import re
from collections import ChainMap
from collections.abc import Iterable, Mapping
from contextlib import suppress
from dataclasses import dataclass, field
from itertools import chain, groupby, pairwise

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillwork.functions import pretok

#: Pieces whose ids a worker keeps, and as many that it used before those; longer pieces than CACHED_CHARS are merged anew each time.
CACHE, CACHED_CHARS = 150_000, 64
#: Parts up to which a scan for the lowest rank beats a queue.
SCANNED = 48
#: Pieces whose distinct ones are Python objects at a time.
SLICE = 1 << 18
REPLACEMENT = "�"


def byte_chars() -> list[str]:
    """The printable character that stands for each byte: itself where it is printable, else one from U+0100 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(rest)) for b in range(256)]


BYTE_CHARS = byte_chars()
CHAR_BYTES = {c: b for b, c in enumerate(BYTE_CHARS)}


def byte_level(text: Column) -> Column:
    """A text as byte-level characters."""
    table = F.array(*map(F.lit, BYTE_CHARS))
    codes = F.regexp_extract_all(F.hex(text), F.lit(".."), 0)
    return F.array_join(F.transform(codes, lambda h: F.element_at(table, F.conv(h, 16, 10).cast("int") + 1)), "")


@dataclass
class Vocabulary:
    """A tokenizer map: tokens by their text, merges in order of rank, special tokens, encoder and pre-tokenizer."""

    id: str
    vocab: dict[str, int]
    merges: list[str] = field(default_factory=list)
    encoder: str = "byte_level"
    program: Mapping | None = None
    pattern: str | None = None
    special: dict[str, int] = field(default_factory=dict)
    byte_start: int = -1
    byte_end: int = -2

    def specials(self) -> dict[str, int]:
        """Declared special tokens and those of the form <|name|>."""
        return {t: i for t, i in self.vocab.items() if re.fullmatch(r"<\|[^|]+\|>", t)} | self.special

    def pieces(self, text: Column) -> Column:
        """Pieces of a text, special tokens apart."""
        names = sorted(self.specials(), key=len, reverse=True)
        if self.encoder == "metaspace":
            cut = lambda t: pretok.pieces_by(f"(?s){pretok.META}?[^{pretok.META}]+|{pretok.META}")(pretok.metaspace_normalize(t))
        elif self.program:
            cut = lambda t: pretok.run(self.program, t)
        elif self.pattern:
            cut = pretok.pieces_by(self.pattern)
        else:
            raise ValueError(f"{self.id} has neither a program nor a pattern")
        if not names:
            return cut(text)
        one = "|".join(pretok.quoted(n) for n in names)
        spans = F.regexp_extract_all(text, F.lit(f"(?s)(?:{one})|(?:(?!{one}).)+"), 0)
        return F.flatten(F.transform(spans, lambda s: F.when(s.isin(*names), F.array(s)).otherwise(cut(s))))


class Encoder:
    """Merges of one piece after the other."""

    def __init__(self, v: Vocabulary) -> None:
        self.v, self.special = v, v.specials()
        self.ranks = {tuple(m.split(" ")): i for i, m in enumerate(v.merges)}
        self.known: dict[str, list[int]] = {}
        self.before: dict[str, list[int]] = {}

    def merge(self, parts: list[str]) -> list[str]:
        """Merges by rank: all places of the lowest rank at hand, from the left, then those of the lowest there is by then."""
        return self.scanned(parts) if len(parts) <= SCANNED else self.queued(parts)

    def scanned(self, parts: list[str]) -> list[str]:
        parts, get, none = list(parts), self.ranks.get, len(self.v.merges)
        ranks = [get(pair, none) for pair in pairwise(parts)]
        while ranks and (rank := min(ranks)) < none:
            for _ in range(ranks.count(rank)):
                if rank not in ranks:  # it overlapped the place before
                    break
                k = ranks.index(rank)
                parts[k] += parts.pop(k + 1)
                del ranks[k]
                if k:
                    ranks[k - 1] = get((parts[k - 1], parts[k]), none)
                if k < len(ranks):
                    ranks[k] = get((parts[k], parts[k + 1]), none)
        return parts

    def queued(self, parts: list[str]) -> list[str]:
        n = len(parts)
        text: list[str | None] = list(parts)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        rank_at = lambda k: self.ranks.get((text[k], text[after[k]])) if after[k] < n else None
        queue = [(r, k) for k in range(n) if (r := rank_at(k)) is not None]
        heapq.heapify(queue)
        while queue:
            rank, places = queue[0][0], []
            while queue and queue[0][0] == rank:
                places.append(heapq.heappop(queue)[1])
            for k in places:
                if text[k] is None or rank_at(k) != rank:  # changed by a merge since
                    continue
                gone = after[k]
                text[k], text[gone], after[k] = text[k] + text[gone], None, after[gone]
                if after[k] < n:
                    before[after[k]] = k
                for i in (before[k], k):
                    if i >= 0 and (r := rank_at(i)) is not None:
                        heapq.heappush(queue, (r, i))
        return [t for t in text if t is not None]

    def piece(self, piece: str) -> list[int]:
        if (ids := self.known.get(piece)) is not None:
            return ids
        if (ids := self.before.get(piece)) is not None:
            pass
        elif piece in self.special:
            ids = [self.special[piece]]
        else:
            start = [BYTE_CHARS[b] for b in piece.encode()] if self.v.encoder == "byte_level" else list(piece)
            ids = []
            for token in self.merge(start):
                if (i := self.v.vocab.get(token)) is not None:
                    ids.append(i)
                elif self.v.byte_start >= 0:
                    ids += [self.v.byte_start + b for b in token.encode()]
        if len(piece) <= CACHED_CHARS:
            if len(self.known) >= CACHE:
                self.known, self.before = {}, self.known
            self.known[piece] = ids
        return ids

    def lists(self, pieces: pa.Array) -> pa.Array:
        """The ids of each list of pieces; null for null."""
        flat, starts = pieces.flatten(), _starts(pieces)
        counts, ids = [], [pa.array([], pa.int64())]
        for k in range(0, len(flat), SLICE):
            part = flat.slice(k, SLICE).dictionary_encode()
            found = [self.piece(p) for p in part.dictionary.to_pylist()]
            sizes = np.fromiter(map(len, found), np.int64, len(found))
            values = pa.array(np.fromiter(chain.from_iterable(found), np.int64, int(sizes.sum())))
            ids.append(pa.ListArray.from_arrays(pa.array(_summed(sizes), pa.int32()), values).take(part.indices).flatten())
            counts.append(sizes[part.indices.to_numpy()])
        ends = _summed(np.concatenate(counts) if counts else np.zeros(0, np.int64))
        return pa.ListArray.from_arrays(pa.array(ends[starts], pa.int32()), pa.concat_arrays(ids), mask=pieces.is_null())


def _summed(sizes: np.ndarray) -> np.ndarray:
    """0 and the running sums."""
    return np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])


def _starts(lists: pa.Array) -> np.ndarray:
    """Where each list starts, and the last ends, in lists.flatten()."""
    return _summed(lists.value_lengths().fill_null(0).to_numpy())


def _lazily(make):
    """A value made once in each worker."""
    held: list = []

    def get():
        if not held:
            held.append(make())
        return held[0]

    return get


def encode(text: Column, v: Vocabulary) -> Column:
    """Ids of a text by byte-pair merges."""
    if not v.merges:
        raise ValueError(f"{v.id} has no merges; use encode_longest")
    encoder = _lazily(lambda: Encoder(v))

    def run(pieces: pa.Array) -> pa.Array:
        return encoder().lists(pieces)

    return F.arrow_udf(run, T.ArrayType(T.LongType()))(v.pieces(text))


def encode_and_render(text: Column, v: Vocabulary) -> Column:
    """struct(ids, text): ids by byte-pair merges and what they stand for, each text being encoded once."""
    if not v.merges:
        raise ValueError(f"{v.id} has no merges; use encode_longest")
    made = _lazily(lambda: (Encoder(v), Detokenizer(v)))

    def run(pieces: pa.Array) -> pa.Array:
        e, d = made()
        ids = e.lists(pieces)
        return pa.StructArray.from_arrays([ids, d.texts(ids)], ["ids", "text"])

    return F.arrow_udf(run, "ids array<bigint>, text string")(v.pieces(text))


def longest_match(text: str, fragments: Mapping[str, int], special: Mapping[str, int], longest: int) -> list[int]:
    out, at = [], 0
    while at < len(text):
        name = next((s for s in special if text.startswith(s, at)), None)
        if name is not None:
            out.append(special[name])
            at += len(name)
            continue
        size = next((n for n in range(min(longest, len(text) - at), 0, -1) if text[at : at + n] in fragments), 0)
        out.append(fragments[text[at : at + size]] if size else 0)
        at += size or 1
    return out


def encode_longest(text: Column, v: Vocabulary) -> Column:
    """Ids by the longest fragment at each place; an unknown character is id 0."""
    special = dict(v.special) | {f"<|{n}|>": i for n, i in v.special.items() if not n.startswith("<")}
    fragments = {t: i for t, i in v.vocab.items() if t}
    longest = max(map(len, fragments), default=1)

    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else longest_match(t, fragments, special, longest))

    return F.pandas_udf(run, T.ArrayType(T.LongType()))(text)


def pick(v: Vocabulary):
    """The encoder that a vocabulary has the data for."""
    return encode if v.merges and v.encoder in ("byte_level", "metaspace") else encode_longest


#: A run of ASCII, as many bytes as a lead byte asks for or fewer at the end, or a byte that leads nothing.
UNITS = re.compile(rb"(?s)[\x00-\x7F]+|[\xC2-\xDF].|[\xE0-\xEF]..|[\xF0-\xF4]...|(?P<begun>[\xC2-\xF4].{0,2}\Z)|[\x80-\xC1\xF5-\xFF]")


def readable(raw: bytes) -> tuple[str, bytes]:
    """(text, bytes of a character that isn't complete); a unit that isn't UTF-8 is one replacement character."""
    out = []
    for unit in UNITS.finditer(raw):
        if unit["begun"]:
            return "".join(out), unit["begun"]
        try:
            out.append(unit[0].decode())
        except UnicodeDecodeError:
            out.append(REPLACEMENT)
    return "".join(out), b""


def token_parts(v: Vocabulary) -> dict[int, bytes | str]:
    """What each id stands for: bytes that join with their neighbours, or text that is complete."""
    if v.encoder == "byte_level":
        parts = {i: bytes(map(CHAR_BYTES.get, t)) if CHAR_BYTES.keys() >= set(t) else t.encode() for t, i in v.vocab.items()}
    else:
        parts = {i: t.replace(pretok.META, " ") for t, i in v.vocab.items() if not re.fullmatch(r"<0x[0-9A-Fa-f]{2}>", t)}
    return parts | {i: bytes([i - v.byte_start]) for i in range(v.byte_start, v.byte_end + 1)}


class Detokenizer:
    """Text from ids: runs of byte parts are decoded together, what is left of an unfinished character stays in `pending`."""

    def __init__(self, v: Vocabulary, pending: bytes = b"") -> None:
        self.parts, self.pending = token_parts(v), pending
        self.tables: dict[bool, tuple[pa.Array, pa.Array]] = {}  # ids of byte parts and those parts; by whether special tokens count
        self.hidden = dict.fromkeys(set(v.specials().values()) - set(range(v.byte_start, v.byte_end + 1)), "")

    def render(self, ids: Iterable[int], partial: bool = False, special: bool = False) -> str:
        """partial: more ids will follow; special: special tokens are written too."""
        parts = ChainMap({} if special else self.hidden, self.parts)
        out = []
        for raw, run in groupby((parts.get(i, REPLACEMENT) for i in ids), lambda part: isinstance(part, bytes)):
            if raw:
                text, self.pending = readable(b"".join([self.pending, *run]))
                out.append(text)
            else:
                out += [self.rest(), *run]
        return "".join(out if partial else [*out, self.rest()])

    def rest(self) -> str:
        """What is pending, as it stands."""
        rest, self.pending = bytes(self.pending), b""
        return rest.decode(errors="replace")

    def texts(self, lists: pa.Array, special: bool = False) -> pa.Array:
        """The text of each list of ids, null for null: lists of byte parts that are UTF-8 by way of one buffer, others by render()."""
        if special not in self.tables:
            raw = {i: p for i, p in self.parts.items() if isinstance(p, bytes) and (special or i not in self.hidden)}
            self.tables[special] = pa.array(list(raw), pa.int64()), pa.array(list(raw.values()), pa.large_binary())
        keys, parts = self.tables[special]
        flat, starts = lists.flatten(), _starts(lists)
        joined = parts.take(pc.index_in(flat.cast(pa.int64()), keys))
        other = _summed(joined.is_null().to_numpy(zero_copy_only=False))[starts]
        at = np.frombuffer(joined.buffers()[1], np.int64, len(joined) + 1)[starts] if len(joined) else starts
        data = memoryview(joined.buffers()[2] or b"")
        out = []
        for k, there in enumerate(lists.is_valid().to_pylist()):
            text = None
            if there:
                with suppress(UnicodeDecodeError):
                    if other[k] == other[k + 1]:
                        text = str(data[at[k] : at[k + 1]], "utf-8")
                if text is None:
                    text = self.render(flat.slice(starts[k], starts[k + 1] - starts[k]).to_pylist(), special=special)
            out.append(text)
        return pa.array(out, pa.string())


def detokenize(ids: Column, v: Vocabulary, special: bool = False) -> Column:
    made = _lazily(lambda: Detokenizer(v))

    def run(rows: pa.Array) -> pa.Array:
        return made().texts(rows, special)

    return F.arrow_udf(run, T.StringType())(ids)


def translate(ids: Column, source: Vocabulary, target: Vocabulary) -> Column:
    """Ids of one vocabulary as those of another, by way of the text."""
    return pick(target)(detokenize(ids, source), target)


def safe_prefix(text: str) -> int:
    """Length of the part that later text can't change: up to and with the last white space."""
    return max((k + 1 for k, c in enumerate(text) if c in " \t\n\r\x0b\x0c   　"), default=0)


def translation_table(spark: SparkSession, source: Vocabulary, target: Vocabulary) -> DataFrame:
    """(id, ids): each ordinary token of one vocabulary in another; tokens with empty text are left out."""
    d, special = Detokenizer(source), set(source.specials().values())
    rows = [(i, d.render([i])) for i in source.vocab.values() if i not in special]
    texts = spark.createDataFrame(rows, "id long, text string").filter("text <> ''")
    return texts.select("id", pick(target)(F.col("text"), target).alias("ids"))


def coverage(table: DataFrame, size: int) -> DataFrame:
    return table.agg(F.count("*").alias("entries"), F.count_if(F.size("ids") == 1).alias("one_to_one"), F.count_if(F.size("ids") > 1).alias("one_to_many"), F.round(F.count("*") * 100.0 / size, 3).alias("percent"))


def compare(a: Column, b: Column) -> Column:
    """struct(equal, diverges_at): whether two id lists agree, and else where they first don't, from 0."""
    differs = F.array_position(F.zip_with(a, b, lambda x, y: ~x.eqNullSafe(y)), True)
    return F.struct(a.eqNullSafe(b).alias("equal"), F.when(~a.eqNullSafe(b), differs - 1).alias("diverges_at"))


def tiktoken_ranks(spark: SparkSession, path: str) -> DataFrame:
    """(token, rank) from lines of base64 and rank; tokens in byte-level characters."""
    lines = spark.read.text(path).filter("value <> ''")
    parts = F.split("value", " ")
    return lines.select(byte_level(F.unbase64(F.get(parts, F.lit(0)))).alias("token"), F.get(parts, F.lit(1)).cast("long").alias("rank"))


def derive_merges(vocab: DataFrame) -> DataFrame:
    """(rank, token, left, right): for each token the split whose halves are both known and earlier, the later half being as early as can be."""
    cuts = vocab.filter(F.length("token") > 1).select("token", "rank", F.explode(F.sequence(F.lit(1), F.length("token") - 1)).alias("k"))
    halves = cuts.select("token", "rank", F.expr("substring(token, 1, k)").alias("left"), F.expr("substring(token, k + 1)").alias("right"), "k")
    one = vocab.select(F.col("token").alias("left"), F.col("rank").alias("left_rank"))
    two = vocab.select(F.col("token").alias("right"), F.col("rank").alias("right_rank"))
    known = halves.join(one, "left").join(two, "right").filter((F.col("left_rank") < F.col("rank")) & (F.col("right_rank") < F.col("rank")))
    worst = F.greatest("left_rank", "right_rank")
    best = known.groupBy("rank", "token").agg(F.min(F.struct(worst.alias("worst"), "k", "left", "right")).alias("b"))
    return best.select("rank", "token", "b.left", "b.right")


def load_tiktoken(spark: SparkSession, path: str, name: str, program: Mapping = pretok.GPT2, special: dict[str, int] | None = None) -> Vocabulary:
    """A vocabulary from a rank file; its size, known from the file, bounds what reaches the driver."""
    ranks = tiktoken_ranks(spark, path)
    vocab = {r.token: r.rank for r in ranks.collect()}
    merges = [f"{r.left} {r.right}" for r in derive_merges(ranks).orderBy("rank").collect()]
    return Vocabulary(name, vocab, merges, "byte_level", program, special=special or {})


def from_tokenizer_json(doc: Mapping, name: str) -> Vocabulary:
    """A vocabulary from a tokenizer.json document with a BPE model; anything its pre-tokenizer tree has that isn't known raises."""
    model = doc["model"]
    if model.get("type") != "BPE":
        raise ValueError(f"model type {model.get('type')!r} isn't supported")
    merges = [m if isinstance(m, str) else " ".join(m) for m in model["merges"]]
    special = {t["content"]: t["id"] for t in doc.get("added_tokens", []) if t.get("special")}
    stages, encoder = [], "metaspace"
    tree = doc.get("pre_tokenizer") or {}
    for node in tree.get("pretokenizers", [tree] if tree else []):
        kind = node.get("type")
        if kind == "ByteLevel":
            encoder = "byte_level"
            if node.get("use_regex", True):
                stages.append({"stage": "alternation", "ops": GPT2_OPS})
        elif kind == "Digits":
            stages.append({"stage": "digits_isolate", "mode": "individual" if node.get("individual_digits") else "grouped"})
        elif kind == "Punctuation":
            stages.append({"stage": "punctuation_contiguous"})
        elif kind == "Metaspace":
            encoder = "metaspace"
        else:
            raise ValueError(f"pre-tokenizer {kind!r} isn't supported")
    bytes_ = [model["vocab"].get(f"<0x{b:02X}>") for b in range(256)]
    start = bytes_[0] if None not in bytes_ else -1
    program = {"version": 2, "stages": stages} if encoder == "byte_level" else None
    return Vocabulary(name, dict(model["vocab"]), merges, encoder, program, special=special, byte_start=start, byte_end=start + 255 if start >= 0 else -2)


GPT2_OPS = pretok.GPT2["ops"]


def rank_lines(v: Vocabulary) -> list[str]:
    """The lines of a rank file for a byte-level vocabulary."""
    return [f"{base64.b64encode(bytes(CHAR_BYTES[c] for c in t)).decode()} {i}" for t, i in sorted(v.vocab.items(), key=lambda x: x[1])]
