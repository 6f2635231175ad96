"""Every registered query, and the SQL that says the same."""

from __future__ import annotations

from quillwork.catalog import decoding, documents, extras, numeric, safety, streams, text

MODULES = (streams, safety, numeric, text, documents, extras, decoding)


def queries() -> dict:
    return {k: f for m in MODULES for k, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for m in MODULES for k, s in m.ORACLES.items()}
