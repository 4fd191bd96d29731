"""Wiring of the registry into the driver contract."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import catalog, catalog_io, catalog_ml, catalog_reports, catalog_streams  # noqa: F401  (register queries)
from .registry import REGISTRY


def registered_queries():
    return {k: q.build for k, q in REGISTRY.items()}


def registered_sql():
    return {k: q.sql for k, q in REGISTRY.items() if q.sql}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .jobs import flagship_job
    return flagship_job(spark, sf_dir)
