"""Synthetic demo transactions and statement conversion (K1-K4).

Rows are generated from an id column of a real table (one demo row per id),
so the work grows with the data; every value is an md5 draw of (seed, id,
feature), hence repeatable and SQL-checkable.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import config as C
from ..functions.dist import quantile_bucket, running_sums
from ..functions.rand import md5_uniform


def _u(seed, id_col, name):
    return md5_uniform(seed, name, F.col(id_col))


def gen_safe(ids: DataFrame, id_col: str = "id", seed: int = C.SEED,
             v_half_width: float = C.SAFE_V_HALF_WIDTH) -> DataFrame:
    """K1: Time in [0, 50000), Amount in [10, 90), V in +-0.4 (sheet variant +-0.5)."""
    lo, hi = C.SAFE_AMOUNT
    return ids.select(
        F.col(id_col).alias("id"),
        F.round(_u(seed, id_col, "Time") * C.SAFE_TIME_MAX, 0).alias("Time"),
        *[F.round((_u(seed, id_col, v) * 2.0 - 1.0) * v_half_width, 6).alias(v) for v in C.V_COLS],
        F.round(F.lit(lo) + _u(seed, id_col, "Amount") * (hi - lo), 2).alias("Amount"),
        F.lit(0).alias("Class"))


def gen_fraud(ids: DataFrame, id_col: str = "id", seed: int = C.SEED) -> DataFrame:
    """K2: driver features near their fraud centres (+-1), others +-1.5,
    Time in [0, 172000), Amount in [50, 1050)."""
    lo, hi = C.FRAUD_AMOUNT

    def v(name):
        u = _u(seed, id_col, name)
        if name in C.FRAUD_DRIVERS:
            return F.round(F.lit(C.FRAUD_DRIVERS[name]) + (u * 2.0 - 1.0), 6)
        return F.round((u * 2.0 - 1.0) * C.FRAUD_OTHER_V_HALF_WIDTH, 6)
    return ids.select(
        F.col(id_col).alias("id"),
        F.round(_u(seed, id_col, "Time") * C.FRAUD_TIME_MAX, 0).alias("Time"),
        *[v(n).alias(n) for n in C.V_COLS],
        F.round(F.lit(lo) + _u(seed, id_col, "Amount") * (hi - lo), 2).alias("Amount"),
        F.lit(1).alias("Class"))


def running_balance(stmt: DataFrame, n_buckets: int | None = None) -> DataFrame:
    """K3: start balance + cumulative signed amount per account in (date, seq) order.

    The running sum is split into buckets of the order, a day and a range of
    sequence numbers each, so an account holding a large share of all lines,
    even on one day, is spread over many tasks.
    """
    day = F.floor(F.unix_seconds(F.col("tx_date").cast("timestamp")) / 86400)
    b = quantile_bucket(stmt, "seq", n_buckets, out_col="_sb")
    b = b.withColumn("_b", F.coalesce(day.cast("long"), F.lit(-2 ** 31)) * 2 ** 20 + F.col("_sb"))
    r = running_sums(b, [F.col("tx_date"), F.col("seq")], {"_cum": F.col("amount_vnd")}, partition_by=["account"])
    return r.withColumn("balance", F.col("start_balance") + F.col("_cum")).drop("_cum", "_sb", "_b")


def statement_to_technical(lines: DataFrame) -> DataFrame:
    """K4: statement lines -> Time = h*3600 + m*60, Amount = round(|VND| / 25000, 2)."""
    hm = F.split(F.col("time"), ":")
    h = F.try_element_at(hm, F.lit(1)).try_cast("int")
    m = F.try_element_at(hm, F.lit(2)).try_cast("int")
    vnd = F.regexp_replace(F.col("amount_display"), "[^0-9.-]", "").try_cast("double")
    return lines.select(
        "file", "line_no",
        (h * 3600 + m * 60).cast("double").alias("Time"),
        F.round(F.abs(vnd) / C.VND_PER_USD, 2).alias("Amount"),
        F.concat(F.lpad(h.cast("string"), 2, "0"), F.lit(":"), F.lpad(m.cast("string"), 2, "0")).alias("hhmm"))
