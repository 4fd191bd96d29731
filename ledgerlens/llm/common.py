"""Helpers shared by the operators of this subpackage.

Conventions of all operators
----------------------------
* A null text counts as the empty text unless the operator says otherwise.
* Input columns are taken by exact name, so extra columns, also ones that
  differ by case only or bear the name of an output, do no harm.
* Empty tables give empty results of the same schema.
"""

from __future__ import annotations

import gc
import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage, shared_dir

ASCII_SPACE = " \t\n\x0b\x0c\r"


def take(df: DataFrame, *names: str) -> DataFrame:
    """The named columns only, found by exact name even if others clash by case."""
    positions = [df.columns.index(n) for n in names]
    safe = df.toDF(*[f"_{i}" for i in range(len(df.columns))])
    return safe.select(*[F.col(f"_{p}").alias(n) for p, n in zip(positions, names)])


def aside(df: DataFrame, *names: str) -> tuple[DataFrame, list[str]]:
    """The whole table under safe names, and the safe names of ``names``.

    ``df.toDF(*original)`` undoes it for the columns that came in.
    """
    positions = [df.columns.index(n) for n in names]
    return df.toDF(*[f"_in{i}" for i in range(len(df.columns))]), [f"_in{p}" for p in positions]


def words(text: str | None) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text with A-Z lower-cased, as UTF-8."""
    return text.encode().lower().split() if text else []


def fold(id_col: str | Column, n: int = 5) -> Column:
    """crc32 of the id as text, mod n; a null id counts as the empty text."""
    c = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary")) % n


def written(df: DataFrame, name: str) -> DataFrame:
    """:func:`cut_lineage`, after which the shuffle files that made ``df`` can go.

    Spark removes them when the driver's garbage collector finds that nothing
    refers to them any more, which may be long after the step; so it is asked to look."""
    out = cut_lineage(df, name)
    gc.collect()
    df.sparkSession._jvm.System.gc()
    return out


def bucketed(df: DataFrame, key: str, buckets: int, name: str) -> DataFrame:
    """``df`` written into the shared folder in buckets of ``key`` and read back:
    groupings and joins by ``key`` with a side in as many partitions read it as
    it lies and shuffle the other side only."""
    spark = df.sparkSession
    table = f"{name}_{uuid.uuid4().hex}"
    df.write.bucketBy(buckets, key).sortBy(key).option("path", shared_dir(spark, f"bucketed/{table}")).saveAsTable(table)
    return spark.table(table)


def components(edges: DataFrame) -> DataFrame:
    """Connected components of links (a, b): one row (node, component) per
    node that has a link; component is the smallest node reachable.

    Alternating star contraction (Kiveris et al. 2014): the large star links
    each greater neighbour of a node to the node's smallest neighbour, the
    small star does so for the lesser ones.  Minima are pre-aggregated before
    each shuffle, links stay distributed, and every round is written to the
    shared folder, so plans stay short and lost executors do no harm.
    """
    pair = (F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    e = cut_lineage(edges.select(*pair).where("u <> v").distinct(), "links")
    seen = None
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"))
        large = (both.join(least, "u").where("v > u")
                 .select(F.col("v").alias("u"), F.least("u", "m").alias("v")))
        root = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(root, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .unionByName(root.select("u", F.col("m").alias("v"))).distinct())
        e = cut_lineage(small, "stars")
        now = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == seen:
            break
        seen = now
    return (e.select(F.col("u").alias("node"), F.col("v").alias("component"))
            .unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()))
