"""Names every query of the library and its oracle SQL."""

from __future__ import annotations

from scriptorium.plans import markup, relational, texts, upkeep

MODULES = [relational, texts, markup, upkeep]


def queries() -> dict:
    return {name: q for m in MODULES for name, q in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in m.ORACLE_SQL.items()}
