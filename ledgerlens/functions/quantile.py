"""Exact quantiles (linear interpolation) without collecting a column.

Spark's ``percentile`` is exact but keeps a value->count map per group in one
task; ``percentile_approx`` is bounded but approximate.  This helper uses the
approximate sketch only to bracket each wanted order statistic (rank error is
at most n / accuracy), counts the rows below the bracket, and sorts just the
distinct values inside it with their counts, so a value shared by many rows is
one row.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

ACCURACY = 10_000           # brackets hold 0.06 % of the rows; a sketch stays below a MB


def long_values(df: DataFrame, cols: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """(*by, feature, value) with nulls and NaN removed."""
    long = df.select(*by, *[F.col(c).cast("double").alias(c) for c in cols]).unpivot(
        list(by), list(cols), "feature", "value")
    return long.where(F.col("value").isNotNull() & ~F.isnan("value"))


def exact_quantiles(df: DataFrame, cols: Sequence[str], probs: Sequence[float],
                    by: Sequence[str] = (), accuracy: int = ACCURACY,
                    long: DataFrame | None = None) -> DataFrame:
    """(*by, feature, n, q_<i> for each prob) equal to ``quantile_cont``.

    ``long`` may be passed when the caller already has the long form.
    """
    by = list(by)
    keys = by + ["feature"]
    lv = long if long is not None else long_values(df, cols, by)
    margin = 3.0 / accuracy
    brackets = []
    for p in probs:
        brackets += [max(0.0, p - margin), min(1.0, p + margin)]
    stats = lv.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"),
                                   F.percentile_approx("value", brackets, accuracy).alias("_br"))
    tcols = []
    for i, p in enumerate(probs):
        h = (F.col("n") - 1).cast("double") * F.lit(float(p))
        tcols += [F.col("_br")[2 * i].alias(f"_lo{i}"), F.col("_br")[2 * i + 1].alias(f"_hi{i}"),
                  h.alias(f"_h{i}")]
    targets = stats.select(*keys, "n", *tcols)
    # one row per column: told to broadcast, as adaptive execution takes few groups in many partitions
    # for a table not worth it and would sort every value of a column in one task; with ``by`` the
    # groups may be many, and Spark decides by their size
    tb = targets if by else F.broadcast(targets)
    below = lv.join(tb, keys).groupBy(*keys).agg(
        *[F.count_if(F.col("value") < F.col(f"_lo{i}")).alias(f"_below{i}") for i in range(len(probs))])
    in_any = F.lit(False)
    for i in range(len(probs)):
        in_any = in_any | F.col("value").between(F.col(f"_lo{i}"), F.col(f"_hi{i}"))
    cand = lv.join(tb, keys).where(in_any)
    which = F.array(*[F.when(F.col("value").between(F.col(f"_lo{i}"), F.col(f"_hi{i}")), F.lit(i))
                      for i in range(len(probs))])
    cand = (cand.withColumn("_pi", F.explode(F.filter(which, lambda x: x.isNotNull())))
                .join(below if by else F.broadcast(below), keys))
    below_i = F.element_at(F.array(*[F.col(f"_below{i}") for i in range(len(probs))]),
                           (F.col("_pi") + 1).cast("int"))
    h_i = F.element_at(F.array(*[F.col(f"_h{i}") for i in range(len(probs))]), (F.col("_pi") + 1).cast("int"))
    # equal values are one row from here on, with the ranks (_r - _c, _r] they hold
    cand = cand.groupBy(*keys, "n", "_pi", "value", below_i.alias("_below"), h_i.alias("_h")).agg(F.count(F.lit(1)).alias("_c"))
    h_i = F.col("_h")
    up_to = F.sum("_c").over(Window.partitionBy(*keys, "_pi").orderBy("value").rowsBetween(Window.unboundedPreceding, 0))
    r = F.col("_below") + up_to
    lo_rank = F.floor(h_i).cast("long") + 1
    hi_rank = F.least(lo_rank + 1, F.col("n"))
    picked = (cand.withColumn("_r", r).withColumn("_lr", lo_rank).withColumn("_hr", hi_rank)
                  .withColumn("_d", h_i - F.floor(h_i))
                  .withColumn("_has_l", (F.col("_r") >= F.col("_lr")) & (F.col("_r") - F.col("_c") < F.col("_lr")))
                  .withColumn("_has_h", (F.col("_r") >= F.col("_hr")) & (F.col("_r") - F.col("_c") < F.col("_hr")))
                  .where("_has_l or _has_h")
                  .groupBy(*keys, "_pi")
                  .agg(F.max_by("value", "_has_l").alias("_v1"),
                       F.max_by("value", "_has_h").alias("_v2"),
                       F.first("_d").alias("_d")))
    val = F.col("_v1") + (F.col("_v2") - F.col("_v1")) * F.col("_d")
    wide = (picked.withColumn("_q", val).groupBy(*keys)
                  .pivot("_pi", list(range(len(probs)))).agg(F.first("_q")))
    out = stats.select(*keys, "n").join(wide, keys, "left")
    return out.select(*keys, "n", *[F.col(str(i)).alias(f"q_{i}") for i in range(len(probs))])
