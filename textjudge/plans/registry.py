"""Named queries and, where SQL can express them, their DuckDB oracle text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from textjudge.plans.views import VIEWS, Tables, with_views

QUERIES: dict[str, Callable[[Tables], DataFrame]] = {}
ORACLES: dict[str, str] = {}
# oracle-only helper relations, usable by name in any oracle text
HELPERS: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    """Register ``fn(tables) -> DataFrame`` under ``name``."""

    def register(fn):
        assert name not in QUERIES, name
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn

    return register


def helper(name: str, sql: str) -> None:
    HELPERS[name] = sql


def oracle_text(name: str) -> str:
    return with_views(ORACLES[name], "duckdb", {**VIEWS, **HELPERS})
