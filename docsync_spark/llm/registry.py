"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from docsync_spark.llm import bpe, langid, mixing, pii, quality, runs, sharding, simhash, substring, topk, toxicity, urlfilter, variants

MODULES = (topk, bpe, pii, langid, substring, quality, urlfilter, mixing, simhash, toxicity, runs, variants, sharding)


def queries() -> dict:
    return {name: f for m in MODULES for name, f in m.QUERIES.items()}


def oracle_sql() -> dict:
    return {name: sql for m in MODULES for name, sql in m.SQL.items()}
