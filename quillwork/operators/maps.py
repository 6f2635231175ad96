"""Compiling tokenizer maps: patterns to programs, encodings, tool-calling markers."""

from __future__ import annotations

import re
from collections.abc import Mapping

_CONTRACTIONS = r"'(?:[a-z]{1,2})"


def branches(pattern: str) -> list[str]:
    """Top-level alternatives of a pattern."""
    out, depth, start, in_class, k = [], 0, 0, False, 0
    while k < len(pattern):
        c = pattern[k]
        if c == "\\":
            k += 2
            continue
        if in_class:
            in_class = c != "]"
        elif c == "[":
            in_class = True
        elif c in "()":
            depth += 1 if c == "(" else -1
        elif c == "|" and not depth:
            out.append(pattern[start:k])
            start = k + 1
        k += 1
    return [*out, pattern[start:]]


def _literals(body: str) -> list[str] | None:
    """Literal alternatives such as 's|'t or '(?:s|t|re)."""
    if found := re.fullmatch(r"'\(\?:([a-z|]+)\)", body):
        return ["'" + x for x in found[1].split("|")]
    if found := re.fullmatch(r"'\[([a-z]+)\]((?:\|'[a-z]+)*)", body):
        return ["'" + x for x in found[1]] + [x for x in found[2].split("|") if x]
    return body.split("|") if re.fullmatch(r"'[a-z]+(?:\|'[a-z]+)*", body) else None


#: Shapes of branches: a pattern of the pattern, and the op it stands for.
_SHAPES: tuple[tuple[str, dict], ...] = (
    (r"\[\^\\r\\n\\p\{L\}\\p\{N\}\]\?\+?\\p\{L\}\+", {"op": "letters", "lead_other": True}),
    (r"\[\^\\r\\n\\p\{L\}\\p\{P\}\\p\{S\}\]\?\[?\\p\{L\}(?:\\p\{M\})?\]?\+", {"op": "letters", "lead_other": True, "lead_other_class": "l_p_s", "body": "l_m"}),
    (r" \?\\p\{L\}\+", {"op": "letters", "lead_space": True}),
    (r"\\p\{L\}\+", {"op": "letters"}),
    (r" \?\\p\{N\}\+", {"op": "numbers", "lead_space": True}),
    (r"\\p\{N\}\+", {"op": "numbers"}),
    (r"\\p\{N\}", {"op": "numbers", "max_run": 1}),
    (r" \?\[\^\\s\\p\{L\}\\p\{N\}\]\+\+?\[\\r\\n\]\*\+?", {"op": "punct_run", "lead_space": True, "trailing_newlines": True}),
    (r" \?\[\^\\s\\p\{L\}\\p\{N\}\]\+\[\\r\\n/\]\*", {"op": "punct_run", "lead_space": True, "trailing_chars": "\r\n/"}),
    (r" \?\[\^\\s\\p\{L\}\\p\{N\}\]\+", {"op": "punct_run", "lead_space": True}),
    (r" \?\[\\p\{P\}\\p\{S\}\]\+\[\\r\\n\]\*", {"op": "punct_run", "lead_space": True, "charset": "p_s", "trailing_newlines": True}),
    (r"\\s\*\[\\r\\n\]\+?", {"op": "newline_block"}),
    (r"\\s\+\(\?!\\S\)", {"op": "trailing_ws"}),
    (r"\\s\+(?:\$)?", {"op": "ws_run"}),
)


def compile_pattern(pattern: str) -> list[dict]:
    """Ops of a pre-tokenizer pattern; a branch of unknown shape raises, so nothing is compiled to something near."""
    ops: list[dict] = []
    for b in branches(pattern):
        inner = re.fullmatch(r"\(\?i:(.*)\)", b)
        if (words := _literals(inner[1] if inner else b)) is not None:
            kind = "literals_ci" if inner else "literals"
            if ops and ops[-1].get("op") == kind:
                ops[-1]["patterns"] += words
            else:
                ops.append({"op": kind, "patterns": words})
            continue
        if found := re.fullmatch(r"\\p\{N\}\{1,(\d+)\}\+?", b):
            ops.append({"op": "numbers", "max_run": int(found[1])})
            continue
        op = next((dict(op) for shape, op in _SHAPES if re.fullmatch(shape, b)), None)
        if op is None:
            raise ValueError(f"pattern branch {b!r} has no op")
        ops.append(op)
    return ops


# Special tokens of the public encodings.
SPECIALS = {
    "r50k_base": {"<|endoftext|>": 50256},
    "p50k_base": {"<|endoftext|>": 50256},
    "cl100k_base": {"<|endoftext|>": 100257, "<|fim_prefix|>": 100258, "<|fim_middle|>": 100259, "<|fim_suffix|>": 100260, "<|endofprompt|>": 100276},
    "o200k_base": {"<|endoftext|>": 199999, "<|endofprompt|>": 200018},
}

# Markers of tool calls, by the text of a chat template that shows them.
CALLING = (
    {"convention": "llama3", "signature": "<|python_tag|>", "start": "<|python_tag|>", "end": "<|eom_id|>", "args_format": "python_args", "result_format": "json"},
    {"convention": "qwen25", "signature": "<tool_call>", "start": "<tool_call>", "end": "</tool_call>", "args_format": "json", "result_format": "json"},
    {"convention": "deepseek_v3", "signature": "<｜tool▁calls▁begin｜>", "start": "<｜tool▁calls▁begin｜>", "end": "<｜tool▁calls▁end｜>", "args_format": "json", "result_format": "json"},
)


def tool_calling(template: str | list[Mapping] | None, vocab: Mapping[str, int], special: dict[str, int], convention: str | None = None) -> dict | None:
    """Tool-calling block of a chat template, or of a named convention; its markers become special tokens.

    None where neither shows, or a marker has no id.
    """
    told = template if isinstance(template, str) else "\n".join(t["template"] for t in template or [])
    for entry in CALLING:
        if convention != entry["convention"] if convention else entry["signature"] not in told:
            continue
        ids = {m: special.get(m, vocab.get(m)) for m in (entry["start"], entry["end"])}
        if None in ids.values():
            continue
        special.update(ids)
        return {"convention": entry["convention"], "markers": {"start": entry["start"], "end": entry["end"]}, "args_format": entry["args_format"], "result_format": entry["result_format"]}
    return None
