"""The library's queries and their oracle SQL."""

from __future__ import annotations


def queries() -> dict:
    from .plans.queries import FOUND

    return dict(FOUND)


def oracle_sql() -> dict[str, str]:
    from .plans.oracle import SQL

    return dict(SQL)
