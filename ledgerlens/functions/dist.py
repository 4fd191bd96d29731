"""Skew-safe rank, cut-off and running-total helpers.

A window with no partition key (or one hot key, e.g. the majority class that
holds 99.8% of rows) runs in one task.  These helpers split the ordered domain
into buckets whose order agrees with the sort order, compute per-bucket totals
(a small table: groups x buckets), turn them into offsets with a window over
that small table, and finish with a window partitioned by (group, bucket).
The big side is shuffled at most once, on (group, bucket), and no bucket
holds more than about n / n_buckets rows.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut_lineage

DEFAULT_RANK_BUCKETS = 4096
DEFAULT_CUTOFF_BUCKETS = 65536
BUCKET_ROWS = 100_000       # target rows of a bucket of a global order


def _cols(xs) -> list[str]:
    if xs is None:
        return []
    if isinstance(xs, str):
        return [xs]
    return list(xs)


def uniform_rank(df: DataFrame, by, u: str, tie: str, rank_col: str = "rank",
                 n_buckets: int = DEFAULT_RANK_BUCKETS) -> DataFrame:
    """Exact 1-based ``row_number() over (partition by <by> order by u, tie)``.

    ``u`` must be uniform on [0, 1) (an md5 draw), so ``floor(u * n_buckets)``
    gives balanced buckets whatever the group sizes are.
    """
    by = _cols(by)
    d = df.withColumn("_b", F.floor(F.col(u) * n_buckets).cast("int"))
    counts = d.groupBy(*by, "_b").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*by).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*by, "_b", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    # join and window share the (by, _b) hash partitioning: one shuffle of the big side
    within = Window.partitionBy(*by, "_b").orderBy(F.col(u), F.col(tie))
    return (d.join(offsets, [*by, "_b"])
             .withColumn(rank_col, (F.col("_off") + F.row_number().over(within)).cast("long"))
             .drop("_b", "_off"))


def first_k_mask(df: DataFrame, by, u: str, tie: str, k: DataFrame, k_col: str = "k",
                 out_col: str = "selected",
                 n_buckets: int = DEFAULT_CUTOFF_BUCKETS) -> DataFrame:
    """Flag the first ``k`` rows of each group in (u, tie) order, exactly.

    ``k`` is a small DataFrame (one row per group; the number of groups is the
    number of strata, so it is broadcast).  Only the rows of one boundary
    bucket per group are ever sorted; everything else is decided by comparing
    its bucket with the boundary bucket, so the big side is never shuffled.
    """
    by = _cols(by)
    d = df.withColumn("_b", F.floor(F.col(u) * n_buckets).cast("int"))
    counts = d.groupBy(*by, "_b").agg(F.count(F.lit(1)).alias("_n"))
    w = Window.partitionBy(*by).orderBy("_b")
    cum = (counts.withColumn("_incl", F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, 0)))
                 .withColumn("_before", F.col("_incl") - F.col("_n"))
                 .join(F.broadcast(k.select(*by, F.col(k_col).alias("_k"))), by))
    boundary = (cum.where((F.col("_before") < F.col("_k")) & (F.col("_k") <= F.col("_incl")))
                   .select(*by, F.col("_b").alias("_bb"), (F.col("_k") - F.col("_before")).alias("_need")))
    # rows of the boundary bucket only: about n / n_buckets per group
    edge = (d.join(F.broadcast(boundary), [*by]).where(F.col("_b") == F.col("_bb"))
             .withColumn("_r", F.row_number().over(Window.partitionBy(*by).orderBy(F.col(u), F.col(tie))))
             .where(F.col("_r") == F.col("_need"))
             .select(*by, "_bb", F.col(u).alias("_cu"), F.col(tie).alias("_ct")))
    # groups whose k reaches past the last row take every row
    totals = (cum.groupBy(*by).agg(F.max("_incl").alias("_tot"), F.first("_k").alias("_k"))
                 .where(F.col("_k") >= F.col("_tot")).select(*by, F.lit(True).alias("_all")))
    rule = edge.join(totals, by, "full_outer")
    u_c, t_c = F.col(u), F.col(tie)
    hit = (F.coalesce(F.col("_all"), F.lit(False))
           | (F.col("_b") < F.col("_bb"))
           | ((F.col("_b") == F.col("_bb"))
              & ((u_c < F.col("_cu")) | ((u_c == F.col("_cu")) & (t_c <= F.col("_ct"))))))
    return (d.join(F.broadcast(rule), by, "left")
             .withColumn(out_col, F.coalesce(hit, F.lit(False)))
             .drop("_b", "_bb", "_cu", "_ct", "_all"))


def bucket_count(n_rows: int, per_bucket: int = BUCKET_ROWS) -> int:
    """Buckets of about ``per_bucket`` rows; a few even for small inputs."""
    return max(8, -(-n_rows // per_bucket))


def quantile_bucket(df: DataFrame, col: str, n_buckets: int | None = None, out_col: str = "_b",
                    descending: bool = False) -> DataFrame:
    """Add a bucket id monotone in ``col`` with roughly equal-count buckets.

    The number of buckets follows the number of rows unless given.  A bucket is a
    partition of a range shuffle by ``col``, so no cut points are made here and equal
    values always land in the same bucket.  The rows are written once with their
    bucket, as a second shuffle may draw other ranges.  Nulls are in the first
    bucket, or in the last with ``descending``, as Spark sorts them.
    """
    n_buckets = bucket_count(df.count()) if n_buckets is None else n_buckets
    if n_buckets <= 1:
        return df.withColumn(out_col, F.lit(0))
    order = F.col(col).desc() if descending else F.col(col).asc()
    return cut_lineage(df.repartitionByRange(n_buckets, order).withColumn(out_col, F.spark_partition_id()), "ranges")


def running_sums(df: DataFrame, order: Sequence[Column], values: dict[str, Column],
                 partition_by=(), bucket: str = "_b", inclusive: bool = True) -> DataFrame:
    """Running sums of ``values`` per ``partition_by`` in ``order``.

    ``bucket`` names an integer column monotone in ``order`` (see
    :func:`quantile_bucket`, or a time floor).  Output keeps every input row and
    adds one column per value; ``inclusive=False`` gives the sum of the rows
    strictly before.
    """
    part = _cols(partition_by)
    d = df
    for name, expr in values.items():
        d = d.withColumn(f"_v_{name}", expr)
    agg = d.groupBy(*part, bucket).agg(*[F.sum(f"_v_{n}").alias(f"_s_{n}") for n in values])
    before = Window.partitionBy(*part).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    offs = agg.select(*part, bucket, *[F.coalesce(F.sum(f"_s_{n}").over(before), F.lit(0)).alias(f"_o_{n}")
                                      for n in values])
    frame = Window.partitionBy(*part, bucket).orderBy(*order)
    frame = frame.rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    out = d.join(offs, [*part, bucket])
    for n in values:
        out = out.withColumn(n, F.col(f"_o_{n}") + F.coalesce(F.sum(f"_v_{n}").over(frame), F.lit(0)))
    return out.drop(*[f"_v_{n}" for n in values], *[f"_o_{n}" for n in values])


FOLD_ROWS = 1 << 20         # rows that a task holds before it adds up those of equal value


def _descending(x: pa.Array) -> np.ndarray:
    """Numbers whose ascending order is Spark's descending order of doubles: NaN first, nulls
    last, both zeros equal."""
    v = x.fill_null(0.0).to_numpy(zero_copy_only=False).astype(np.float64) + 0.0
    bits = np.where(np.isnan(v), np.nan, v).view(np.int64)
    up = np.where(bits < 0, ~bits, bits | np.int64(-1 << 63)).view(np.uint64)
    return np.where(x.is_null().to_numpy(zero_copy_only=False), np.uint64(0xFFFFFFFFFFFFFFFF), ~up)


def _doubles(k: np.ndarray) -> pa.Array:
    """The doubles of :func:`_descending`."""
    up = ~k
    bits = np.where(up >> np.uint64(63) != 0, up ^ np.uint64(1 << 63), ~up)
    return pa.array(bits.view(np.float64), mask=up == 0)


def _folded(g: np.ndarray, k: np.ndarray, sums: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Distinct (g, k) in order, with the sums of their rows."""
    at = np.lexsort((k, g))
    g, k = g[at], k[at]
    first = np.flatnonzero(np.append(True, (g[1:] != g[:-1]) | (k[1:] != k[:-1])))
    return g[first], k[first], [np.add.reduceat(v[at], first) for v in sums]


def range_sums(ranged: DataFrame, group: str, value: str, totals: dict[str, str]) -> DataFrame:
    """(group, value, counts, running sums of the counts) of each distinct double ``value`` of
    each ``group``, in descending order, of rows that lie in ranges by (value descending,
    group).  ``totals``: running sum -> its column of counts; groups and counts are long.

    Each task puts its range in order and adds up on the way, so the rows are written
    once, with their sums within the range, and are not shuffled again; it holds the distinct values of its
    range.  What lies before a range is added from a table of ranges x groups."""
    counts = list(totals.values())
    rows = ranged.select(group, value, *counts, F.spark_partition_id().alias("_b"))
    fields = {f.name: f for f in rows.schema.fields}
    schema = T.StructType([*(fields[c] for c in (group, value, *counts, "_b")), *(T.StructField(f"_r_{n}", T.LongType()) for n in totals)])

    def run(batches):
        held, size, bucket = [], 0, None

        def fold():
            g, k, *v = (np.concatenate(x) for x in zip(*held))
            return _folded(g, k, v)

        for b in batches:
            if not b.num_rows:
                continue
            bucket = b.column("_b")[0].as_py()
            whole = [b.column(c).to_numpy(zero_copy_only=False) for c in (group, *counts)]
            held.append([whole[0], _descending(b.column(value)), *whole[1:]])
            size += b.num_rows
            if size > FOLD_ROWS:
                g, k, v = fold()
                held, size = [[g, k, *v]], 0
        if not held:
            return
        g, k, v = fold()
        opens = np.flatnonzero(np.append(True, g[1:] != g[:-1]))
        size = np.diff(np.append(opens, len(g)))
        within = []
        for x in v:
            upto = np.cumsum(x)
            within.append(upto - np.repeat((upto - x)[opens], size))
        out = pa.RecordBatch.from_arrays([pa.array(g), _doubles(k), *map(pa.array, v), pa.array(np.full(len(g), bucket, np.int32)), *map(pa.array, within)], schema.names)
        for at in range(0, len(g), 10_000):
            yield out.slice(at, 10_000)

    told = cut_lineage(rows.mapInArrow(run, schema), "ranges")
    parts = told.groupBy(group, "_b").agg(*[F.sum(c).alias(f"_s_{n}") for n, c in totals.items()])
    earlier = Window.partitionBy(group).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.select(group, "_b", *[F.coalesce(F.sum(f"_s_{n}").over(earlier), F.lit(0)).alias(f"_o_{n}") for n in totals])
    # one row for each group in a range of some 500,000 rows
    out = told.join(F.broadcast(offsets), [group, "_b"])
    return out.select(group, value, *counts, *[(F.col(f"_o_{n}") + F.col(f"_r_{n}")).alias(n) for n in totals])


def range_numbers(df: DataFrame, order: str, out: str, n_buckets: int | None = None) -> DataFrame:
    """1-based row number by ``order`` over the whole table.  The rows are shuffled and
    written once, with their place in their range; the rows of the ranges before are
    added from a table of one row for each range."""
    n_buckets = bucket_count(df.count()) if n_buckets is None else n_buckets
    placed = df.repartitionByRange(n_buckets, F.col(order).asc()).sortWithinPartitions(F.col(order).asc())
    rows = cut_lineage(placed.withColumn("_at", F.monotonically_increasing_id()), "ranges")    # range << 33 | place
    sizes = rows.groupBy(F.shiftright("_at", 33).alias("_b")).agg(F.count(F.lit(1)).alias("_n"))
    earlier = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_b", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_off"))
    place = F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    return (rows.withColumn("_b", F.shiftright("_at", 33)).join(F.broadcast(offsets), "_b")
                .select(*df.columns, (F.col("_off") + place + 1).cast("long").alias(out)))
