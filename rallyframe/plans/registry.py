"""All core queries and their SQL."""

from __future__ import annotations

from rallyframe.plans import match_queries, source_queries, training_queries

FLAGSHIP = "p1_rolling"
_MODULES = [match_queries, source_queries, training_queries]


def queries() -> dict:
    out: dict = {}
    for m in _MODULES:
        out |= m.QUERIES
    return out


def oracle_sql() -> dict[str, str]:
    out: dict[str, str] = {}
    for m in _MODULES:
        out |= m.ORACLES
    return out
