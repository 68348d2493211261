"""Registered queries of the moderation engine and their SQL."""

from __future__ import annotations

from modlark.plans import index_queries, message_queries, model_queries, queue_queries, stream_queries, table_queries  # noqa: F401  they register queries
from modlark.plans.registry import ORACLES, QUERIES, Query


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
