"""Registry: query name to DataFrame builder and to its SQL for an independent engine."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Builder = Callable[[SparkSession, str], DataFrame]

_QUERIES: dict[str, Builder] = {}
_ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None) -> Callable[[Builder], Builder]:
    """Register a builder under ``name``, with the SQL that gives the same rows where SQL can express it."""

    def add(build: Builder) -> Builder:
        _QUERIES[name] = build
        if sql is not None:
            _ORACLES[name] = sql
        return build

    return add


def queries() -> dict[str, Builder]:
    load_all()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    load_all()
    return dict(_ORACLES)


def load_all() -> None:
    """Import every module of bindings; each registers its queries."""
    import importlib

    for name in MODULES:
        importlib.import_module(f"afterbell.plans.{name}")


MODULES = ("study", "bars", "backtest", "evidence", "review", "discovery", "time", "projections", "domains", "sections", "models")
