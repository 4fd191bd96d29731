"""Trailing time-window aggregates that do not funnel a hot series into one task.

A window ``(t - w, t]`` per series only needs rows from the current time
bucket and the one before it when buckets are at least ``w`` wide.  Rows are
copied once into the next bucket as read-only *halo* rows, the window runs
partitioned by (series, bucket), and only the bucket's own rows are kept.
A series holding a third of all rows is therefore split over as many tasks
as it has buckets; each row is shuffled at most twice.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def with_halo(df: DataFrame, ts_us: str, bucket_us: int, out: str = "_tb") -> DataFrame:
    """Every row in its own bucket (``_halo`` false) and in the next (true)."""
    b = F.floor(F.col(ts_us) / F.lit(bucket_us)).cast("long")
    return df.withColumn("_own", b).select(
        "*", F.explode(F.array(F.struct(F.col("_own").alias(out), F.lit(False).alias("_halo")),
                               F.struct((F.col("_own") + 1).alias(out), F.lit(True).alias("_halo")))).alias("_hb")
    ).select("*", "_hb.*").drop("_hb", "_own")


def trailing(df: DataFrame, series, ts_us: str, width_us: int, aggs: dict[str, Column],
             bucket_us: int | None = None, lags: dict[str, Column] | None = None,
             tie: str | None = None) -> DataFrame:
    """Add one column per ``aggs`` entry: the aggregate over ``(t - width, t]``
    of the same series.  ``lags`` are computed first (per series, previous row
    in (ts, tie) order) and may be used by the aggregates; a previous row more
    than one bucket back is not seen (it can only matter to the first row of a
    window, which callers account for)."""
    series = [series] if isinstance(series, str) else list(series)
    bucket_us = max(bucket_us or width_us, width_us)
    h = with_halo(df, ts_us, bucket_us)
    part = [*series, "_tb"]
    order = [F.col(ts_us)] + ([F.col(tie)] if tie else [])
    for name, expr in (lags or {}).items():
        h = h.withColumn(name, expr.over(Window.partitionBy(*part).orderBy(*order)))
    frame = Window.partitionBy(*part).orderBy(F.col(ts_us)).rangeBetween(-(width_us - 1), 0)
    for name, expr in aggs.items():
        h = h.withColumn(name, expr.over(frame))
    return h.where(~F.col("_halo")).drop("_halo", "_tb")
