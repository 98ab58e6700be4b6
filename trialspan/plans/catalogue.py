"""All registered queries of the engine's own operators, with the SQL that each must equal."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

MODULES = ["aggregate_queries", "analytic_queries", "join_queries", "window_queries", "graph_queries", "scalar_queries", "flow_queries", "request_queries", "stream_queries", "io_queries"]

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a function under its own name, with its oracle SQL."""

    def put(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql is not None:
            _SQL[f.__name__] = sql
        return f

    return put


def oracle(name: str) -> str:
    """The SQL of another query, which must be registered before."""
    for module in MODULES:
        if name not in _SQL:
            import_module(f"trialspan.plans.{module}")
    return _SQL[name]


def _load() -> None:
    """Imports the modules whose functions register themselves."""
    for name in MODULES:
        import_module(f"trialspan.plans.{name}")


def queries() -> dict[str, Query]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_SQL)
