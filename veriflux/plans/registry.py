"""The registered queries: name, DataFrame function, and the SQL that checks it."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

FLAGSHIP = "entry"
MODULES = ("retrieval_queries", "graph_queries", "rule_queries", "stat_queries", "kpi_queries", "image_queries", "detector_queries", "store_queries")
_queries: dict[str, Query] = {}
_sql: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a function under its name, with the SQL that gives the same rows."""

    def add(f: Query) -> Query:
        _queries[f.__name__] = f
        if sql is not None:
            _sql[f.__name__] = sql
        return f

    return add


def _loaded() -> None:
    for m in MODULES:
        importlib.import_module(f"{__package__}.{m}")


def queries() -> dict[str, Query]:
    _loaded()
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    _loaded()
    return dict(_sql)
