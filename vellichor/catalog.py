"""Queries of the core operators, by name, with their SQL counterparts."""

from __future__ import annotations

from vellichor.plans import evidence, inventory, ledger, policy

_THEMES = (ledger, inventory, evidence, policy)


def queries() -> dict:
    return {query.__name__: query for theme in _THEMES for query in theme.QUERIES}


def oracle_sql() -> dict[str, str]:
    return {name: sql for theme in _THEMES for name, sql in theme.ORACLE.items()}
