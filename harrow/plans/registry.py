"""Registered queries: a name, how to build it from the driver's tables, and its SQL."""

from __future__ import annotations

import importlib
import pkgutil
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from harrow.plans.standins import view, with_views

_queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_sql: dict[str, str] = {}


def register(name: str, *roles: str, sql: str | None = None):
    """Decorator for a function of the named roles' DataFrames."""

    def add(build):
        _queries[name] = lambda spark, sf_dir: build(*[view(spark, sf_dir, r) for r in roles])
        if sql:
            _sql[name] = with_views(sql)
        return build

    return add


def register_raw(name: str, sql: str | None = None):
    """Decorator for a function of (spark, sf_dir)."""

    def add(build):
        _queries[name] = build
        if sql:
            _sql[name] = with_views(sql)
        return build

    return add


def load() -> tuple[dict, dict]:
    import harrow.plans as package

    for m in pkgutil.iter_modules(package.__path__):
        if m.name.startswith("queries_"):
            importlib.import_module(f"harrow.plans.{m.name}")
    return dict(_queries), dict(_sql)
