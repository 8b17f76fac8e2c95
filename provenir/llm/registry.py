"""The subpackage's named queries and their SQL counterparts."""

from __future__ import annotations

import importlib
import pkgutil
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import provenir.llm as package


def _modules():
    return [importlib.import_module(f"{package.__name__}.{m.name}") for m in pkgutil.iter_modules(package.__path__) if m.name not in {"registry"} and not m.name.startswith("_")]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = {}
    for m in _modules():
        found |= getattr(m, "QUERIES", {})
    return dict(sorted(found.items(), key=lambda x: int(x[0][2:].split("_")[0])))


def oracle_sql() -> dict[str, str]:
    found = {}
    for m in _modules():
        found |= getattr(m, "ORACLE", {})
    return found
