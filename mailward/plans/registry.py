"""Where queries and their SQL twins are kept."""

from __future__ import annotations

QUERIES, ORACLES = {}, {}


def query(name: str, sql: str | None):
    """Register a function of (spark, folder); without SQL it is only run."""
    def keep(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return keep
