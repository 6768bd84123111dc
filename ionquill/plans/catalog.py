"""Every query of the library, by name."""

from __future__ import annotations

from ionquill.plans import format_queries, io_queries, psm_queries, relational_queries, statistics_queries, vector_queries  # noqa: F401
from ionquill.plans.registry import QUERIES, SQL


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
