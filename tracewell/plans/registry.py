"""Query name -> function of the estate, and SQL over the same tables."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tracewell.plans.estate import ESTATE_SQL, Estate

MODULES = ("coverage", "worklists", "joins", "integrity", "graphs", "texts", "windowed", "sets", "events", "readers", "federated", "scalars", "checks", "matching", "glossary", "loads", "suggestions", "snapshots")
_QUERIES: dict[str, Callable[[Estate], DataFrame]] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None, *, tables: str = "", recursive: bool = False):
    """Register a function of the estate under its own name. sql is the body of
    the same query; tables holds further common tables it uses."""

    def add(f: Callable[[Estate], DataFrame]) -> Callable[[Estate], DataFrame]:
        _QUERIES[f.__name__] = f
        if sql is not None:
            _SQL[f.__name__] = f"WITH {'RECURSIVE ' if recursive else ''}{ESTATE_SQL.strip()}{', ' + tables.strip() if tables else ''}\n{sql.strip()}"
        return f

    return add


def _load() -> None:
    for m in MODULES:
        importlib.import_module(f"tracewell.plans.{m}")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()
    return {name: (lambda spark, sf_dir, f=f: f(Estate(spark, sf_dir))) for name, f in _QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_SQL)
