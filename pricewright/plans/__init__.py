"""Registered queries and their SQL."""

from __future__ import annotations


def registered() -> tuple[dict, dict]:
    """All queries, and the SQL of those that SQL can express."""
    from . import evidence, flyers, market, oracles, queries, shelf, signals, words

    found, sql = dict(queries.QUERIES), dict(oracles.SQL)
    for part in (evidence, flyers, market, shelf, signals, words):
        found |= part.QUERIES
        sql |= part.SQL
    return found, sql
