"""The registered queries of the engine: plans by name, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a plan (spark, sf_dir) -> DataFrame under ``name``."""

    def held(plan: Callable) -> Callable:
        QUERIES[name] = plan
        if sql is not None:
            SQL[name] = sql
        return plan

    return held
