"""Registered queries: every operator on the shared tables, with the SQL that checks it."""
from __future__ import annotations

from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register ``fn(spark, sf_dir)`` under an operator id."""
    def add(fn: Callable) -> Callable:
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn
    return add


def load_all() -> None:
    from . import dependency, flow, lifecycle, review, rollup, stream, text  # noqa: F401
