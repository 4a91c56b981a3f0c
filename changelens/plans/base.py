"""Registry of the driver queries of this package, each with its SQL for DuckDB where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from changelens.sources.graph import SYMBOL, VIA, duck_views

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None, graph: bool = True) -> Callable[[Query], Query]:
    """Registers a query. ``sql`` may start with further ``, name AS (...)`` views; with ``graph`` it sees the graph views."""

    def add(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql:
            SQL[name] = f"{duck_views()}\n{sql}" if graph else sql
        return fn

    return add


#: Columns of symbol and relation rows in the SQL, with s for symbols and e for edges.
S = ", ".join(f"s.{c}" for c in SYMBOL)
E = "e.source_id AS via_source, e.target_id AS via_target, e.kind AS via_kind, e.line AS via_line, e.resolution_kind AS via_resolution, e.confidence AS via_confidence"
C = ", ".join(SYMBOL)
V = ", ".join(VIA)
