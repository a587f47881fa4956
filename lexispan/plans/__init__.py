"""Registered queries over whole tables, and their SQL."""

from __future__ import annotations

from . import mapped, reading, rules, service


def queries() -> dict:
    return {**reading.QUERIES, **rules.QUERIES, **service.QUERIES, **mapped.QUERIES}


def oracle_sql() -> dict[str, str]:
    return {**reading.ORACLE, **rules.ORACLE, **service.ORACLE, **mapped.ORACLE}
