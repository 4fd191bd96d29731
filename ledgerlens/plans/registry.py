"""Registry of named queries: a Spark builder and, where SQL can say it, the
DuckDB text that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


@dataclass
class Query:
    name: str
    survey_ids: str
    build: Callable[[SparkSession, str], DataFrame]
    sql: str | None = None


REGISTRY: dict[str, Query] = {}


def query(name: str, ids: str, sql: str | None = None):
    def deco(fn):
        REGISTRY[name] = Query(name, ids, fn, sql)
        return fn
    return deco
