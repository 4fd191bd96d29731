"""Small files of a cluster file system, by Hadoop's own interface: listing,
deleting, and texts that appear whole or not at all."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession


def _at(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _at(spark, path)
    return fs.exists(p)


def children(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder; none if it isn't there."""
    fs, p = _at(spark, path)
    return [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []


def matching(spark: SparkSession, pattern: str) -> list[str]:
    """Paths that match a glob pattern."""
    fs, p = _at(spark, pattern)
    return [str(s.getPath()) for s in fs.globStatus(p) or []]


def partition_name(spark: SparkSession, column: str, value: str) -> str:
    """Folder of a partition value, escaped as Spark's writers do."""
    return spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.getPartitionPathString(column, value)


def delete(spark: SparkSession, path: str) -> None:
    fs, p = _at(spark, path)
    fs.delete(p, True)


def commit_text(spark: SparkSession, path: str, text: str) -> None:
    """Write a small text aside and rename it to ``path``, replacing what is there."""
    fs, p = _at(spark, path)
    _, aside = _at(spark, f"{path}.{uuid.uuid4().hex}.tmp")
    out = fs.create(aside, True)
    out.write(text.encode())
    out.close()
    options = spark._jvm.org.apache.hadoop.fs.Options.Rename
    context = spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(p.toUri() if p.toUri().getScheme() else fs.getUri(), spark._jsc.hadoopConfiguration())
    replace = spark.sparkContext._gateway.new_array(options, 1)
    replace[0] = options.OVERWRITE
    context.rename(aside, p, replace)


def read_text(spark: SparkSession, path: str) -> str | None:
    """A small text; None if there is none."""
    fs, p = _at(spark, path)
    if not fs.exists(p):
        return None
    stream = fs.open(p)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()
