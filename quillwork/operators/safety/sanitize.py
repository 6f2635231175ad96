"""Removing hidden characters and control strings, folding look-alikes, wrapping and filtering output."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillwork.operators.safety import rules as R


def removed(text: Column, chars: str) -> tuple[Column, Column]:
    """text without a class of characters, and how many there were."""
    out = F.regexp_replace(text, f"[{chars}]", "")
    return out, F.length(text) - F.length(out)


def sanitize(text: Column, keep_joiner: bool = False, run_min: int = 2) -> Column:
    """struct of the sanitized text and the counts by class.

    Selectors are counted in runs of the text as it came, in which other hidden
    characters end a run; from the run_min-th on they go.
    """
    zero = R.ZERO_WIDTH.replace(r"\x{200d}", "") if keep_joiner else R.ZERO_WIDTH
    kept_run = F.regexp_replace(text, f"([{R.SELECTORS}]{{{run_min - 1}}})[{R.SELECTORS}]+", "$1")
    n_selectors = F.length(text) - F.length(kept_run)
    a, n_tags = removed(kept_run, R.TAGS)
    b, n_zero = removed(a, zero)
    c, n_bidi = removed(b, R.BIDI)
    n_tokens, out = F.lit(0), c
    for token in R.CHAT_TOKENS:
        shorter = F.replace(out, F.lit(token), F.lit(""))
        n_tokens = n_tokens + ((F.length(out) - F.length(shorter)) / len(token)).cast("int")
        out = shorter
    return F.struct(
        out.alias("text"), n_tags.alias("tag_block"), n_zero.alias("zero_width"), n_selectors.alias("variation_selectors"), n_bidi.alias("bidi_controls"), n_tokens.alias("chat_tokens")
    )


def smuggling(text: Column) -> Column:
    """Whether a text holds tags, zero-width or direction characters or a run of selectors."""
    return text.rlike(f"[{R.TAGS}{R.ZERO_WIDTH}{R.BIDI}]|[{R.SELECTORS}]{{2}}")


def fold_confusables(text: Column) -> Column:
    return F.translate(text, R.CONFUSABLES, R.LATIN)


def normalized(text: Column, form: str) -> Column:
    """Unicode normalisation, which has no built-in function."""

    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda s: None if s is None else unicodedata.normalize(form, s))

    return F.pandas_udf(run, T.StringType())(text)


def for_policy(text: Column) -> Column:
    return F.lower(normalized(fold_confusables(text), "NFKC"))


def for_wire(text: Column) -> Column:
    return normalized(text, "NFC")


def wrap_untrusted(content: Column, origin: Column, mime: Column | None = None, sha256: Column | None = None) -> Column:
    """content between tags that name its origin; absent or empty attributes are left out."""

    def attr(name: str, value: Column) -> Column:
        safe = value
        for old, new in (("&", "&amp;"), ('"', "&quot;"), ("<", "&lt;"), (">", "&gt;")):
            safe = F.replace(safe, F.lit(old), F.lit(new))
        return F.concat(F.lit(f'{name}="'), safe, F.lit('"'))

    attrs = [attr("origin", origin)]
    for name, value in (("mime", mime), ("sha256", sha256)):
        if value is not None:
            attrs.append(F.when(F.coalesce(value, F.lit("")) != "", attr(name, value)))
    return F.concat(F.lit("<untrusted_content "), F.concat_ws(" ", *attrs), F.lit(">\n"), content, F.lit("\n</untrusted_content>"))


IMAGE, LINK = r"!\[([^\]]*)\]\(([^)]+)\)", r"(?<!!)\[([^\]]*)\]\(([^)]+)\)"


def verdict(url: Column, hosts: list[str]) -> Column:
    """ok, data-uri, javascript-uri, invalid-url or non-allowlisted-domain."""
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    allowed = F.lit(False)
    for h in hosts:
        allowed = allowed | (host == h.lower()) | host.endswith("." + h.lower())
    return (
        F.when(url.startswith("data:"), "data-uri")
        .when(url.rlike("(?i)^javascript:"), "javascript-uri")
        .when(url.startswith("#") | url.startswith("/"), "ok")
        .when(~url.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), "invalid-url")
        .when(allowed, "ok")
        .otherwise("non-allowlisted-domain")
    )


def markdown_urls(text: Column, images: list[str], links: list[str]) -> Column:
    """array<struct<kind, url, reason>> of the references in a Markdown text."""

    def each(kind: str, pattern: str, hosts: list[str]) -> Column:
        urls = F.regexp_extract_all(text, F.lit(pattern), 2)
        return F.transform(urls, lambda u: F.struct(F.lit(kind).alias("kind"), u.alias("url"), verdict(u, hosts).alias("reason")))

    return F.concat(each("image", IMAGE, images), each("link", LINK, links))


def strip_query(url: Column) -> Column:
    """Scheme, host and path of an absolute URL."""
    return F.regexp_replace(url, r"[?#].*$", "")


def filter_markdown(text: Column, images: list[str], links: list[str], strip: bool = True) -> Column:
    """text with blocked references replaced and the others kept, without queries if strip."""

    def rewrite(source: Column, kind: str, pattern: str, hosts: list[str]) -> Column:
        mark = "!" if kind == "image" else ""
        found = F.regexp_extract_all(source, F.lit(pattern), 0)
        between = F.split(source, pattern, -1)

        def one(m: Column) -> Column:
            alt, url = F.regexp_extract(m, r"\[([^\]]*)\]", 1), F.regexp_extract(m, r"\]\(([^)]+)\)", 1)
            why = verdict(url, hosts)
            shown = F.when(url.rlike("^[A-Za-z][A-Za-z0-9+.-]*://"), strip_query(url)).otherwise(url) if strip else url
            blocked = F.concat(F.lit(f"[{kind} blocked: "), why, F.lit("]"))
            return F.when(why == "ok", F.concat(F.lit(f"{mark}["), alt, F.lit("]("), shown, F.lit(")"))).otherwise(blocked)

        glued = F.zip_with(between, F.transform(found, one), lambda g, m: F.concat(g, F.coalesce(m, F.lit(""))))
        return F.array_join(glued, "")

    return rewrite(rewrite(text, "image", IMAGE, images), "link", LINK, links)


def tool_description(text: Column, longest: int = 1500) -> Column:
    """struct(sanitized, hits, suspicious): authority claims redacted, counted on the original."""
    out, hits = text, []
    for i, pattern in enumerate(R.AUTHORITY):
        n = F.regexp_count(text, F.lit(R.java(pattern)))
        out = F.when(n > 0, F.regexp_replace(out, R.java(pattern), "[REDACTED]")).otherwise(out)
        hits.append(F.struct(F.lit(i).alias("pattern"), n.cast("int").alias("count")))
    long = F.length(out) > longest
    cut = F.when(long, F.concat(F.substring(out, 1, longest), F.lit("[…TRUNCATED]"))).otherwise(out)
    hits.append(F.struct(F.lit(len(R.AUTHORITY)).alias("pattern"), long.cast("int").alias("count")))
    seen = F.filter(F.array(*hits), lambda h: h["count"] > 0)
    return F.struct(cut.alias("sanitized"), seen.alias("hits"), (F.size(seen) > 0).alias("suspicious"))


def collisions(tools: DataFrame) -> DataFrame:
    """(name, servers, n_servers) of tool names that several servers offer, from tools(server, name)."""
    # Distinct first, so that a name's list holds each server once.
    named = tools.select("server", "name").distinct().groupBy("name").agg(F.array_sort(F.collect_list("server")).alias("servers"))
    return named.withColumn("n_servers", F.size("servers")).filter("n_servers > 1")


def namespaced(tools: DataFrame) -> DataFrame:
    return tools.withColumn("qualified", F.concat_ws(".", "server", "name"))
