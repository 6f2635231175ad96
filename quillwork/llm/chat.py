"""Chat formatting by schema fingerprints.

Records come in many layouts: a messages list, a prompt with a completion, an
instruction with input and output, a from/value conversation list, or one row a
turn.  A layout's fingerprint is the SHA-256 of its sorted nested field paths.
A registry maps fingerprints to declarative mappings, each a list of turns whose
roles and texts are column expressions, so adding a layout adds an entry, not
code.  Only paths that some layout names are hashed, so further fields don't matter.
JSON records are fingerprinted row by row, by their keys and those of the first object
in each list; typed tables by their schema.

The template writes every turn as ``<|turn|>role<|text|>text<|end|>``.  Roles and
texts are escaped so that no control string, neither the template's nor one of
the other well-known ones, survives in them: ``\\`` doubles, and a ``\\`` follows
the first character of each control string.  Removing each ``\\`` and keeping the
character after it undoes that exactly.

Turns are ordered by turn number (null first), ties by role, then text.  Null
roles and texts are empty.  Equal rows are separate turns.  A record whose layout
nobody registered keeps a null list of turns, so nothing is guessed or dropped.
Only DataFrame functions are used.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
#: Control strings of common chat templates, escaped besides our own.
CONTROLS = ("<|", "<s>", "</s>", "<<SYS>>", "<</SYS>>", "[INST]", "[/INST]", "<start_of_turn>", "<end_of_turn>")
TRAINED_ROLES = ("assistant",)


def escape(text: Column) -> Column:
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for control in CONTROLS:
        out = F.replace(out, F.lit(control), F.lit(control[0] + "\\" + control[1:]))
    return out


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def paths_of(kind: T.DataType, prefix: str = "") -> list[str]:
    """Nested field paths of a type; arrays are written as []."""
    if isinstance(kind, T.StructType):
        return [p for f in kind.fields for p in paths_of(f.dataType, f"{prefix}.{f.name}" if prefix else f.name)]
    if isinstance(kind, T.ArrayType):
        return paths_of(kind.elementType, f"{prefix}[]")
    return [prefix]


def fingerprint(paths: list[str]) -> str:
    return hashlib.sha256("\n".join(sorted(set(paths))).encode()).hexdigest()


def json_paths(raw: Column) -> Column:
    """Nested field paths of a JSON record: its keys, and for lists of objects the keys of the first; null if it isn't an object."""
    first = lambda k: F.call_function("get_json_object", raw, F.concat(F.lit("$['"), k, F.lit("'][0]")))
    inner = lambda k: F.transform(F.json_object_keys(first(k)), lambda n: F.concat(k, F.lit("[]."), n))
    return F.flatten(F.transform(F.json_object_keys(raw), lambda k: F.coalesce(inner(k), F.array(k))))


def json_fingerprint(raw: Column) -> Column:
    """Fingerprint of the paths that some layout names; fields that none does don't matter."""
    known = F.array(*map(F.lit, sorted({p for paths, _ in LAYOUTS.values() for p in paths})))
    return F.sha2(F.array_join(F.array_sort(F.array_intersect(known, json_paths(raw))), "\n"), 256)


def turn_of(role: Column, text: Column) -> Column:
    return F.struct(F.coalesce(role, F.lit("")).alias("role"), F.coalesce(text, F.lit("")).alias("text"))


def _listed(path: str, role: str, text: str, names: dict[str, str] | None = None) -> Callable[[Column], Column]:
    names = names or {}

    def turns(raw: Column) -> Column:
        items = F.from_json(F.get_json_object(raw, f"$.{path}"), f"array<struct<`{role}`:string,`{text}`:string>>")

        def one(m: Column) -> Column:
            r = m[role]
            for old, new in names.items():
                r = F.when(m[role] == old, F.lit(new)).otherwise(r)
            return turn_of(r, m[text])

        return F.transform(items, one)

    return turns


def _fixed(*pairs: tuple[str, tuple[str, ...]]) -> Callable[[Column], Column]:
    """Turns from named fields; fields of one turn are joined by an empty line, absent ones left out."""

    def turns(raw: Column) -> Column:
        parts = [
            turn_of(F.lit(role), F.array_join(F.filter(F.array(*[F.get_json_object(raw, f"$.{f}") for f in fields]), lambda x: x.isNotNull() & (x != "")), "\n\n"))
            for role, fields in pairs
        ]
        return F.array(*parts)

    return turns


_MESSAGES = _listed("messages", "role", "content")
_CONVERSATIONS = _listed("conversations", "from", "value", {"human": "user", "gpt": "assistant"})
#: JSON layouts: nested field paths, whose fingerprint is the key, and the mapping to turns.
LAYOUTS: dict[str, tuple[tuple[str, ...], Callable[[Column], Column]]] = {
    "messages": (("messages[].role", "messages[].content"), _MESSAGES),
    "no_messages": (("messages",), _MESSAGES),
    "conversations": (("conversations[].from", "conversations[].value"), _CONVERSATIONS),
    "no_conversations": (("conversations",), _CONVERSATIONS),
    "prompt_completion": (("prompt", "completion"), _fixed(("user", ("prompt",)), ("assistant", ("completion",)))),
    "prompt_response": (("prompt", "response"), _fixed(("user", ("prompt",)), ("assistant", ("response",)))),
    "instruction": (("instruction", "input", "output"), _fixed(("user", ("instruction", "input")), ("assistant", ("output",)))),
    "instruction_only": (("instruction", "output"), _fixed(("user", ("instruction",)), ("assistant", ("output",)))),
    "question_answer": (("question", "answer"), _fixed(("user", ("question",)), ("assistant", ("answer",)))),
}
#: Typed tables: nested field paths, and which of them hold conversation, order, role and text.
TABLES = {fingerprint(list(paths)): paths for paths in (("conv_id", "turn", "role", "text"), ("conversation", "position", "speaker", "utterance"))}


def turns_of_json(raw: Column) -> Column:
    """Canonical turns of JSON records, by the fingerprint of each; null where no layout is registered."""
    print_ = json_fingerprint(raw)
    out = F.lit(None).cast("array<struct<role:string,text:string>>")
    for paths, mapping in LAYOUTS.values():
        out = F.when(print_ == fingerprint(list(paths)), mapping(raw)).otherwise(out)
    return out


def as_messages(turns: Column) -> Column:
    """A JSON record of turns in the layout "messages"."""
    return F.to_json(F.struct(F.transform(turns, lambda t: F.struct(t["role"].alias("role"), t["text"].alias("content"))).alias("messages")))


def as_conversations(turns: Column) -> Column:
    """A JSON record of turns in the layout "conversations"."""
    name = lambda r: F.when(r == "user", "human").when(r == "assistant", "gpt").otherwise(r)
    return F.to_json(F.struct(F.transform(turns, lambda t: F.struct(name(t["role"]).alias("from"), t["text"].alias("value"))).alias("conversations")))


def turns_of_table(rows: DataFrame) -> DataFrame:
    """One row a conversation, (conv_id, turns), from a table with one row a turn.

    The mapping is selected by the fingerprint of those columns' paths that some
    layout names; other columns don't matter.
    """
    known = {p for paths in TABLES.values() for p in paths}
    paths = [p for p in paths_of(rows.schema) if p in known]
    if (found := TABLES.get(fingerprint(paths))) is None:
        raise ValueError(f"no mapping for a table with the paths {sorted(paths)}")
    conv, turn, role, text = map(F.col, found)
    one = F.struct(turn.alias("turn"), F.coalesce(role, F.lit("")).alias("role"), F.coalesce(text, F.lit("")).alias("text"))
    grouped = rows.groupBy(conv.alias("conv_id")).agg(F.array_sort(F.collect_list(one)).alias("_t"))
    return grouped.select("conv_id", F.transform("_t", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns"))


def render(turns: Column, trained: tuple[str, ...] = TRAINED_ROLES) -> Column:
    """struct(formatted, loss): the text, and the spans (start from 0, length) under the loss mask, in code points."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("loss"))
    pieces = F.transform(turns, lambda t: F.struct(t["role"].isin(*trained).alias("on"), F.concat(F.lit(TURN), escape(t["role"]), F.lit(TEXT)).alias("head"), escape(t["text"]).alias("body")))

    def put(s: Column, p: Column) -> Column:
        begin, length = s["at"] + F.length(p["head"]), F.length(p["body"])
        span = F.array(F.struct(begin.alias("start"), length.alias("length")))
        return F.struct(
            (begin + length + len(END)).alias("at"),
            F.when(p["on"], F.concat(s["loss"], span)).otherwise(s["loss"]).alias("loss"),
        )

    return F.struct(
        F.array_join(F.transform(pieces, lambda p: F.concat(p["head"], p["body"], F.lit(END))), "").alias("formatted"),
        F.aggregate(pieces, start, put)["loss"].alias("loss"),
    )


def read_back(formatted: Column) -> Column:
    """The turns of a formatted conversation."""
    parts = F.filter(F.split(formatted, r"<\|end\|>"), lambda p: p != "")

    def one(p: Column) -> Column:
        body = F.substring(p, len(TURN) + 1, 2**31 - 1)
        return F.struct(
            unescape(F.substring_index(body, TEXT, 1)).alias("role"),
            unescape(F.substring(body, F.instr(body, TEXT) + len(TEXT), F.lit(2**31 - 1))).alias("text"),
        )

    return F.transform(parts, one)


def masked_text(formatted: Column, loss: Column) -> Column:
    """What lies under the loss mask, unescaped."""
    return F.array_join(F.transform(loss, lambda s: unescape(F.substring(formatted, s["start"] + 1, s["length"]))), "")
