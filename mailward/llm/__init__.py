"""Operators for preparing training corpora, each with a query of its own. Nothing outside imports this."""

from __future__ import annotations

from importlib import import_module

MODULES = ("exact_dedup", "langid", "wordbpe", "packing", "token_records", "ngram_join", "pii", "licenses", "chat", "neighbours", "whitening", "toxicity", "periodic_runs")


def queries() -> dict:
    return {k: f for m in MODULES for k, f in import_module(f"{__name__}.{m}").QUERIES.items()}


def oracle_sql() -> dict:
    return {k: s for m in MODULES for k, s in import_module(f"{__name__}.{m}").ORACLES.items()}
