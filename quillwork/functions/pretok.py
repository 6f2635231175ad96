"""Pre-tokenizer programs compiled to regular expressions.

A program is either a list of alternation ops (version 1) or of stages (version
2).  Ops become the branches of one alternation, in their order; a last branch
takes what no other matches as one piece.  Stages run over all pieces of the one
before.  Everything is compiled on the driver, where unknown ops, stages and
versions raise.
"""

from __future__ import annotations

import re
from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The white-space code points of Unicode.
WS = r"\t\n\x{0b}\f\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
PUNCT = r"\p{P}!-/:-@\[-`{-~"
CJK = r"\x{4e00}-\x{9fa5}\x{3040}-\x{309f}\x{30a0}-\x{30ff}"
META = "▁"


def quoted(text: str) -> str:
    return re.sub(r"([^A-Za-z0-9_\s])", r"\\\1", text)


def alternatives(patterns: list[str]) -> str:
    return "|".join(quoted(p) for p in sorted(patterns, key=len, reverse=True))


def _letters(op: Mapping) -> str:
    body = r"[\p{L}\p{M}]+" if op.get("body") in ("l_m", "letters_marks") else r"\p{L}+"
    if op.get("lead_other"):
        lead = r"[^\r\n\p{L}\p{P}\p{S}]?" if op.get("lead_other_class") == "l_p_s" else r"[^\r\n\p{L}\p{N}]?"
        return lead + body
    return (" ?" if op.get("lead_space") else "") + body


def _cased(op: Mapping) -> str:
    upper, lower = r"[\p{Lu}\p{Lt}\p{Lm}\p{Lo}\p{M}]", r"[\p{Ll}\p{Lm}\p{Lo}\p{M}]"
    run = upper + "+" + lower + "*" if op.get("kind") == "upper" else upper + "*" + lower + "+"
    tail = f"(?i:{alternatives(op['trailing_ci'])})?" if op.get("trailing_ci") else ""
    return (r"[^\r\n\p{L}\p{N}]?" if op.get("lead_other") else "") + run + tail


def _punct(op: Mapping) -> str:
    body = r"[\p{P}\p{S}]+" if op.get("charset") == "p_s" else rf"[^{WS}\p{{L}}\p{{N}}]+"
    tail = ""
    if op.get("trailing_chars") is not None:
        tail = "[" + "".join(quoted(c) for c in op["trailing_chars"]) + "]*"
    elif op.get("trailing_newlines"):
        tail = r"[\r\n]*"
    return (" ?" if op.get("lead_space") else "") + body + tail


OPS = {
    "literals_ci": lambda op: f"(?i:{alternatives(op.get('patterns', []))})",
    "literals": lambda op: f"(?:{alternatives(op.get('patterns', []))})",
    "letters": _letters,
    "letters_cased": _cased,
    "numbers": lambda op: (" ?" if op.get("lead_space") else "") + (rf"\p{{N}}{{1,{op['max_run']}}}" if op.get("max_run") else r"\p{N}+"),
    "punct_run": _punct,
    "punct_ascii_letters": lambda op: r"[!-/:-@\[-`{-~][A-Za-z]+",
    "newline_block": lambda op: rf"[{WS}]*[\r\n]+",
    "trailing_ws": lambda op: rf"[{WS}]+(?![^{WS}])",
    "ws_run": lambda op: rf"[{WS}]+",
}


def branch(op: Mapping) -> str:
    if op.get("op") not in OPS:
        raise ValueError(f"unknown pre-tokenizer op {op.get('op')!r}")
    return OPS[op["op"]](op)


def alternation(ops: list[Mapping]) -> str:
    """One pattern for a list of ops, with the branch for unmatched spans last."""
    one = "|".join(f"(?:{branch(op)})" for op in ops)
    return f"(?s){one}|(?:(?!{one}).)+"


def pieces_by(pattern: str):
    return lambda text: F.regexp_extract_all(text, F.lit(pattern), 0)


def stage(s: Mapping):
    kind = s.get("stage") or s.get("op")
    if kind == "alternation":
        return pieces_by(alternation(s["ops"]))
    if kind == "digits_isolate":
        run = 1 if s.get("mode") == "individual" else s.get("max_run") or 0
        return pieces_by(rf"(?s)\p{{N}}{{1,{run}}}|\P{{N}}+" if run else r"(?s)\p{N}+|\P{N}+")
    if kind == "digit_triples_isolate":
        return lambda text: F.filter(F.split(F.regexp_replace(text, "([0-9]{3})", "\u0000$1\u0000"), "\u0000"), lambda p: p != "")
    if kind == "punctuation_contiguous":
        return pieces_by(f"(?s)[{PUNCT}]+|[^{PUNCT}]+")
    if kind == "cjk_isolate":
        return pieces_by(f"(?s)[{CJK}]+|[^{CJK}]+")
    raise ValueError(f"unknown pre-tokenizer stage {kind!r}")


def metaspace_split(text: Column) -> Column:
    return F.transform(F.filter(F.split(text, f"[{WS}]+"), lambda p: p != ""), lambda p: F.concat(F.lit(META), p))


def run(program: Mapping, text: Column) -> Column:
    """Pieces of a text by a program."""
    version = program.get("version", 1)
    if version == 1:
        ops = program.get("ops") or []
        if len(ops) == 1 and ops[0].get("op") == "metaspace_split":
            return metaspace_split(text)
        return pieces_by(alternation(ops))(text)
    if version == 2:
        out = F.array(text)
        for s in program.get("stages") or []:
            out = F.flatten(F.transform(out, stage(s)))
        return F.filter(out, lambda p: p != "")
    raise ValueError(f"unknown pre-tokenizer program version {version!r}")


def metaspace_normalize(text: Column, prepend: str = "always") -> Column:
    """Spaces to U+2581, with one in front never, always or unless the text starts with a space (first)."""
    if prepend not in ("never", "always", "first"):
        raise ValueError(f"unknown prepend mode {prepend!r}")
    out = F.replace(text, F.lit(" "), F.lit(META))
    if prepend == "always":
        return F.concat(F.lit(META), out)
    return F.when(out.startswith(META), out).otherwise(F.concat(F.lit(META), out)) if prepend == "first" else out


CONTRACTIONS = ["'s", "'t", "'re", "'ve", "'m", "'ll", "'d"]
GPT2 = {"version": 1, "ops": [{"op": "literals", "patterns": CONTRACTIONS}, {"op": "letters", "lead_space": True}, {"op": "numbers", "lead_space": True}, {"op": "punct_run", "lead_space": True}, {"op": "trailing_ws"}, {"op": "ws_run"}]}
QWEN = {"version": 1, "ops": [{"op": "literals_ci", "patterns": CONTRACTIONS}, {"op": "letters", "lead_other": True}, {"op": "numbers", "max_run": 1}, {"op": "punct_run", "lead_space": True, "trailing_newlines": True}, {"op": "newline_block"}, {"op": "trailing_ws"}, {"op": "ws_run"}]}
CASED = {"version": 1, "ops": [{"op": "letters_cased", "kind": "title", "lead_other": True, "trailing_ci": CONTRACTIONS}, {"op": "letters_cased", "kind": "upper", "lead_other": True, "trailing_ci": CONTRACTIONS}, {"op": "numbers", "max_run": 3}, {"op": "punct_run", "lead_space": True, "trailing_chars": "\r\n/"}, {"op": "newline_block"}, {"op": "trailing_ws"}, {"op": "ws_run"}]}
