"""Queries of the reference's operators and the SQL that they are held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
FLAGSHIP = "pair_keyword_topk"
MODULES = ["pair_queries", "text_queries", "edit_queries", "graph_queries", "stat_queries", "source_queries", "report_queries", "dataset_queries", "injection_queries", "commit_queries", "anonymise_queries", "landed_queries", "docket_queries"]


def query(name: str, sql: str | None = None):
    """Registers a query (and its SQL, if SQL can express it) by name."""

    def add(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return add


def load() -> None:
    """Imports the modules that register queries."""
    import importlib

    for name in MODULES:
        importlib.import_module(f"tessera.plans.{name}")
