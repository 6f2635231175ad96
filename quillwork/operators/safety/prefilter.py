"""Pattern and entropy scanning, redaction and the gate, as column expressions.

Offsets count code points from 0.  A rule's spans follow from its matches and the
pieces between them, so scanning stays inside the JVM; one row in, one row out.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillwork.functions.bind import let
from quillwork.operators.safety import rules as R

MATCH = "array<struct<start:int,end:int,rank:double,order:int,category:string,rule:string,value:string,confidence:double>>"


def may_match(text: Column, lower: Column, rule: R.Rule) -> Column:
    """False only where a rule can't match; a search for fixed texts."""
    if words := R.NEEDS.get(rule.name):
        return reduce(or_, (F.contains(text, F.lit(w)) for w in words))
    if words := R.NEEDS_LOWER.get(rule.name):
        return reduce(or_, (F.contains(lower, F.lit(w)) for w in words))
    return text.rlike(R.NEEDS_PATTERN.get(rule.name) or R.java(rule.pattern))


def spans(text: Column, pattern: str, may: Column | None = None) -> Column:
    """array<struct<start, end, value>> of a pattern's matches, none of them empty; may: a cheaper test for texts without any."""
    found = F.regexp_extract_all(text, F.lit(pattern), 0)
    between = F.split(text, pattern, -1)
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int,value:string>>").alias("out"))

    def step(s: Column, x: Column) -> Column:
        begin = s["at"] + F.length(x["gap"])
        end = begin + F.length(x["value"])
        return F.struct(end.alias("at"), F.concat(s["out"], F.array(F.struct(begin.alias("start"), end.alias("end"), x["value"].alias("value")))).alias("out"))

    pairs = F.zip_with(F.slice(between, F.lit(1), F.size(found)), found, lambda g, v: F.struct(g.alias("gap"), v.alias("value")))
    empty = F.array().cast("array<struct<start:int,end:int,value:string>>")
    # Texts without a match, nearly all of them, pay for one search.
    return F.when(text.rlike(pattern) if may is None else may, F.aggregate(pairs, start, step)["out"]).otherwise(empty)


def luhn(value: Column) -> Column:
    """Whether the digits of value, 13 to 19 of them, pass the Luhn check."""
    digits = F.regexp_replace(value, "[^0-9]", "")
    each = F.transform(F.split(F.reverse(digits), ""), lambda d, i: _luhn_digit(d.cast("int"), i))
    return F.length(digits).between(13, 19) & (F.aggregate(each, F.lit(0), lambda a, d: a + F.coalesce(d, F.lit(0))) % 10 == 0)


def _luhn_digit(d: Column, i: Column) -> Column:
    twice = d * 2
    return F.when(i % 2 == 0, d).otherwise(F.when(twice > 9, twice - 9).otherwise(twice))


def entropy(value: Column) -> Column:
    """Shannon entropy in bits a character."""

    def of(chars: Column) -> Column:
        terms = F.transform(F.array_sort(F.array_distinct(chars)), lambda c: F.size(F.filter(chars, lambda x: x == c)) / F.size(chars))
        return F.aggregate(terms, F.lit(0.0), lambda a, p: a - p * F.log2(p))

    return let(F.filter(F.split(value, ""), lambda c: c != ""), of)


def _match(s: Column, order: int, category: str, name: str, confidence: Column) -> Column:
    return F.struct(
        s["start"].alias("start"), s["end"].alias("end"), (-confidence).alias("rank"), F.lit(order).alias("order"), F.lit(category).alias("category"),
        F.lit(name).alias("rule"), s["value"].alias("value"), confidence.alias("confidence"),
    )


def _named(order: int, rule: R.Rule):
    return lambda s: _match(s, order, rule.category, rule.name, F.lit(rule.confidence))


def _rated(order: int, name: str):
    return lambda s: _match(s, order, "high_entropy", name, F.least(F.lit(0.95), 0.7 + (s["h"] - 4.0) * 0.15))


def scan(text: Column, *how, **options) -> Column:
    """Matches by start, end and falling confidence; of equal spans the most confident.

    Takes min_confidence, min_entropy, categories and blocked, the host's own rules.
    """
    return let(F.struct(text.alias("text"), F.lower(text).alias("lower")), lambda t: _scan(t["text"], t["lower"], *how, **options))


def _scan(
    text: Column,
    lower: Column,
    min_confidence: float = R.MIN_CONFIDENCE,
    min_entropy: float = R.MIN_ENTROPY,
    categories: tuple[str, ...] = ("secrets", "pii", "high_entropy", "dangerous_action", "blocked_action"),
    blocked: tuple[R.Rule, ...] = (),
) -> Column:
    used = [r for r in R.RULES if r.category in categories and r.confidence >= min_confidence]
    used += [r for r in blocked if "blocked_action" in categories and r.confidence >= min_confidence]
    parts = []
    for i, r in enumerate(used):
        found = spans(text, R.java(r.pattern), may_match(text, lower, r))
        if r.name == "credit_card_candidate":
            found = F.filter(found, lambda s: luhn(s["value"]))
        parts.append(F.transform(found, _named(i, r)))
    named = F.flatten(F.array(*parts)) if parts else F.array().cast(MATCH)
    if "high_entropy" not in categories:
        return _distinct_spans(named)
    entropic = []
    for i, (pattern, name) in enumerate(((R.BASE64_RUN, "entropy_base64"), (R.HEX_RUN, "entropy_hex"))):
        runs = F.filter(spans(text, R.java(pattern)), lambda s: (F.length(s["value"]) >= R.MIN_ENTROPY_LENGTH))
        scored = F.transform(runs, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["value"].alias("value"), entropy(s["value"]).alias("h")))
        strong = F.filter(scored, lambda s: s["h"] >= min_entropy)
        rated = F.transform(strong, _rated(100 + i, name))
        entropic.append(F.filter(rated, lambda m: m["confidence"] >= min_confidence))
    opaque = F.flatten(F.array(*entropic))
    return let(F.struct(named.alias("n"), opaque.alias("o")), lambda x: _distinct_spans(F.concat(x["n"], _uncovered(x["o"], x["n"]))))


def _uncovered(opaque: Column, named: Column) -> Column:
    """Entropy runs that no confident match covers; a hexadecimal run may be covered by a base64 run, too."""

    def covers(m: Column, e: Column) -> Column:
        return (m["start"] <= e["start"]) & (m["end"] >= e["end"]) & (m["confidence"] >= R.COVERING)

    free = F.filter(opaque, lambda e: ~F.exists(named, lambda m: covers(m, e)))
    long_runs = lambda f: F.filter(f, lambda m: m["rule"] == "entropy_base64")
    return let(free, lambda f: F.filter(f, lambda e: (e["rule"] == "entropy_base64") | ~F.exists(long_runs(f), lambda m: covers(m, e))))


def _distinct_spans(matches: Column) -> Column:
    def first(ordered: Column) -> Column:
        before = lambda i: F.get(ordered, i - 1)
        return F.filter(ordered, lambda m, i: (i == 0) | (before(i)["start"] != m["start"]) | (before(i)["end"] != m["end"]))

    return let(F.array_sort(matches), first)


def redact(text: Column, matches: Column) -> Column:
    """struct(redacted, count): spans replaced from the right, those that overlap one already replaced left out."""
    backwards = F.reverse(matches)
    start = F.struct(text.alias("out"), F.lit(2**31 - 1).alias("limit"), F.lit(0).alias("count"))

    def step(s: Column, m: Column) -> Column:
        ok = m["end"] <= s["limit"]
        new = F.concat(F.substring(s["out"], F.lit(1), m["start"]), F.lit("[REDACTED:"), m["rule"], F.lit("]"), F.substring(s["out"], m["end"] + 1, F.lit(2**31 - 1)))
        return F.struct(F.when(ok, new).otherwise(s["out"]).alias("out"), F.when(ok, m["start"]).otherwise(s["limit"]).alias("limit"), (s["count"] + ok.cast("int")).alias("count"))

    return F.aggregate(backwards, start, step, lambda s: F.struct(s["out"].alias("redacted"), s["count"].alias("count")))


def gate(text: Column, matches: Column, action: Column) -> Column:
    """struct(clean, categories, text, sent): what passes for an action of redact, send_anyway or cancel."""
    clean = F.size(matches) == 0
    passed = F.when(clean | (action == "send_anyway"), text).when(action == "redact", redact(text, matches)["redacted"])
    return F.struct(
        clean.alias("clean"), F.array_sort(F.array_distinct(F.transform(matches, lambda m: m["category"]))).alias("categories"), passed.alias("text"), passed.isNotNull().alias("sent")
    )
