"""Queries and SQL of the training-data operators."""

from __future__ import annotations

import importlib
import pkgutil
import re

import harrow.llm as package


def modules() -> list:
    return [importlib.import_module(f"harrow.llm.{m.name}") for m in pkgutil.iter_modules(package.__path__) if re.match(r"q\d\d_", m.name)]


def queries() -> dict:
    return {m.NAME: m.query for m in modules()}


def oracle_sql() -> dict[str, str]:
    return {m.NAME: m.ORACLE_SQL for m in modules() if m.ORACLE_SQL}
