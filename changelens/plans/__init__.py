"""Driver queries of the operators, and their SQL."""

from __future__ import annotations

import importlib

from changelens.plans import base

_MODULES = ["graph_queries", "change_queries", "more_queries", "inventory_queries", "function_queries", "depth_queries"]


def queries() -> dict[str, base.Query]:
    for m in _MODULES:
        importlib.import_module(f"changelens.plans.{m}")
    return dict(base.QUERIES)


def oracle_sql() -> dict[str, str]:
    queries()
    return dict(base.SQL)
