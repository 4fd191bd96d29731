"""Numeric helpers shared by Spark code and the SQL oracle text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def sig_round(x: Column, digits: int = 10) -> Column:
    """Round to ``digits`` significant digits (floating sums differ in the last bits
    between engines and partitionings; this is applied to reported values only)."""
    e = F.floor(F.log10(F.abs(x)))
    scale = F.pow(F.lit(10.0), e)
    return F.when(x.isNull(), F.lit(None).cast("double")) \
            .when((x == 0) | F.isnan(x), x) \
            .otherwise(F.round(x / scale, digits - 1) * scale)


def sql_sig_round(x: str, digits: int = 10) -> str:
    e = f"floor(log10(abs({x})))"
    return (f"(CASE WHEN ({x}) IS NULL THEN NULL WHEN ({x}) = 0 OR isnan({x}) THEN ({x}) "
            f"ELSE round(({x}) / pow(10.0, {e}), {digits - 1}) * pow(10.0, {e}) END)")


def safe_ratio(a: Column, b: Column) -> Column:
    """a / b, 0 when b is 0 or null (zero_division=0)."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))
