"""Safety classifiers: a registry by tier with fallback, and readers of their outputs."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

# Category names of the guard's codes S1 to S14, in order.
GUARD_CATEGORIES = (
    "violent_crimes", "non_violent_crimes", "sex_crimes", "child_exploitation", "defamation", "specialized_advice", "privacy", "intellectual_property", "indiscriminate_weapons",
    "hate", "self_harm", "sexual_content", "elections", "code_interpreter_abuse",
)


@dataclass(frozen=True)
class Classifier:
    """A scorer of a text column; capability() returns why it can't run here, or None."""

    model_id: str
    tier: int
    score: Callable[[Column], Column]
    capability: Callable[[], str | None] = lambda: None


class Registry:
    def __init__(self) -> None:
        self._known: dict[str, Classifier] = {}

    def register(self, classifier: Classifier) -> None:
        if classifier.model_id in self._known:
            raise ValueError(f"{classifier.model_id!r} is registered already")
        self._known[classifier.model_id] = classifier

    def unregister(self, model_id: str) -> bool:
        return self._known.pop(model_id, None) is not None

    def listed(self) -> list[Classifier]:
        return sorted(self._known.values(), key=lambda c: c.tier)

    def resolve(self, model_id: str, fallback: bool = True) -> tuple[Classifier, str | None]:
        """(classifier, reason for which it isn't the one asked for): the lowest tier that can run stands in."""
        asked = self._known.get(model_id)
        reason = f"no classifier {model_id!r}" if asked is None else asked.capability()
        if asked is not None and reason is None:
            return asked, None
        stand_in = next((c for c in self.listed() if c.model_id != model_id and c.capability() is None), None)
        if not fallback or stand_in is None:
            raise ValueError(f"{model_id!r} can't run: {reason}")
        return stand_in, reason


def guard_codes(output: Column) -> Column:
    """Codes in the second line of a guard's output; empty for a safe text."""
    lines = F.split(F.trim(output), "\n")
    tokens = F.transform(F.split(F.upper(F.trim(F.coalesce(F.get(lines, F.lit(1)), F.lit("")))), r"[,\s]+"), lambda t: F.trim(t))
    codes = F.filter(tokens, lambda t: t.rlike("^S(1[0-4]|[1-9])$"))
    return F.when(F.lower(F.trim(F.get(lines, F.lit(0)))) == "safe", F.array().cast("array<string>")).otherwise(codes)


def guard_scores(output: Column) -> Column:
    """map<category, score> with 1 for each named category; unsafe = 1 where none was readable."""
    safe = F.lower(F.trim(F.get(F.split(F.trim(output), "\n"), F.lit(0)))) == "safe"
    codes = guard_codes(output)
    pairs = [F.struct(F.lit(n).alias("key"), F.when(F.array_contains(codes, f"S{i + 1}"), 1.0).otherwise(0.0).alias("value")) for i, n in enumerate(GUARD_CATEGORIES)]
    unsafe = F.struct(F.lit("unsafe").alias("key"), F.lit(1.0).alias("value"))
    every = F.array(*pairs)
    return F.map_from_entries(F.when(~safe & (F.size(codes) == 0), F.array_append(every, unsafe)).otherwise(every))


def prompt_guard(labels: Column, benign: str = "BENIGN") -> Column:
    """Largest score of array<struct<label, score>> beside the benign label; 0 if there is none."""
    others = F.filter(labels, lambda x: F.upper(x["label"]) != benign)
    return F.coalesce(F.array_max(F.transform(others, lambda x: x["score"])), F.lit(0.0))
