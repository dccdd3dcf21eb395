"""All core queries by name, with their DuckDB SQL."""

from __future__ import annotations


def _all():
    from engramlake.plans import graph_queries, queries  # noqa: F401  (the second adds to the first's tables)

    return queries


def queries() -> dict:
    return dict(_all().QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_all().SQL)
