"""Repeatable randomness: every draw is a function of (seed, row id, stream).

u = conv(substr(md5(seed|id), 1, 13), 16, 10) / 2^52 is a 52-bit uniform in
[0, 1) that Spark and DuckDB compute identically, so sampled rows can be
checked against SQL.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TWO_52 = float(2 ** 52)


def md5_uniform(seed, *parts) -> Column:
    """Uniform in [0,1) from md5 of ``seed|part1|part2...``."""
    cols = [F.lit(str(seed))] + [p if isinstance(p, Column) else F.lit(str(p)) for p in parts]
    digest = F.md5(F.concat_ws("|", *[c.cast("string") for c in cols]))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / F.lit(TWO_52)


def sql_md5_uniform(seed, *parts: str) -> str:
    """DuckDB/Spark SQL text of :func:`md5_uniform` (parts are SQL expressions)."""
    inner = " || '|' || ".join([f"'{seed}'"] + [f"CAST({p} AS VARCHAR)" for p in parts])
    return f"(CAST(('0x' || substr(md5({inner}), 1, 13)) AS UBIGINT) / 4503599627370496.0)"
