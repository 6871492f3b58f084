"""All queries of the library over the driver's tables, with their SQL."""

from __future__ import annotations

from . import compose_queries, event_queries, grid_queries, more_queries, rolling_queries, score_queries, stream_queries, window_queries  # noqa: F401  they register themselves
from .registry import QUERIES, SQL, Query


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
