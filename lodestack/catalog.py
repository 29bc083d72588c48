"""All registered core queries and their SQL."""

from __future__ import annotations

from . import catalog_queries, catalog_tables  # noqa: F401  both register when imported

flagship = catalog_queries.flagship
Q, SQL = catalog_queries.Q, catalog_queries.SQL


def queries() -> dict:
    return dict(Q)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
