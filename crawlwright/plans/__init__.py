"""Named queries over the given tables, each with its oracle SQL."""

from __future__ import annotations

import importlib

from .registry import QUERIES, Query

MODULES = ("page_queries", "image_queries", "task_queries", "metric_queries", "stream_queries")


def all_queries() -> dict[str, Query]:
    for m in MODULES:
        importlib.import_module(f"{__name__}.{m}")
    return QUERIES
