"""Registry of named queries: a Spark builder plus (where SQL can say it) a DuckDB oracle text.

Each catalog module registers its keys with :func:`register`.  The Spark side
takes ``(spark, sf_dir)`` and returns a lazy DataFrame; the oracle text reads the
driver's pre-registered views and the fixture CTEs it names.
"""

from __future__ import annotations

import importlib
from dataclasses import dataclass
from typing import Callable

from pyspark.sql import DataFrame, SparkSession

from pickwise.sources.fixtures import with_fixtures


@dataclass(frozen=True)
class Query:
    key: str
    build: Callable[[SparkSession, str], DataFrame]
    sql: str | None


_QUERIES: dict[str, Query] = {}

CATALOG_MODULES = [
    "pickwise.plans.catalog.tables",
    "pickwise.plans.catalog.scores",
    "pickwise.plans.catalog.metrics",
    "pickwise.plans.catalog.models",
    "pickwise.plans.catalog.sampling",
    "pickwise.plans.catalog.groups",
    "pickwise.plans.catalog.verifiers",
    "pickwise.plans.catalog.diagnostics",
    "pickwise.plans.catalog.text",
    "pickwise.plans.catalog.distill",
    "pickwise.plans.catalog.fitted",
    "pickwise.plans.catalog.streaming",
]


def register(key: str, sql: str | None = None, fixtures: tuple[str, ...] = ("f1",)):
    """Decorator: register ``fn(spark, sf_dir) -> DataFrame`` under ``key``."""

    def deco(fn):
        if key in _QUERIES:
            raise ValueError(f"duplicate query key {key}")
        text = with_fixtures(sql, *fixtures) if sql is not None else None
        _QUERIES[key] = Query(key, fn, text)
        return fn

    return deco


def all_queries() -> dict[str, Query]:
    for mod in CATALOG_MODULES:
        importlib.import_module(mod)
    return dict(_QUERIES)
