"""Scoring columns: probability clean-up, verdict, confidence, batch scoring (H1-H9)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import config as C


def normalise_proba(prob: Column, label: Column | None = None) -> Column:
    """H1: P(fraud) from a probability array: abs, renormalise (0.5/0.5 when the
    sum is 0), clip to [0,1].  A null array falls back to 1.0/0.0 by label."""
    a = F.transform(prob, lambda x: F.abs(x))
    total = F.aggregate(a, F.lit(0.0), lambda acc, x: acc + x)
    p1 = F.when(total == 0, F.lit(0.5)).otherwise(F.element_at(a, -1) / total)
    p1 = F.least(F.greatest(p1, F.lit(0.0)), F.lit(1.0))
    if label is None:
        return p1
    return F.when(prob.isNull(), F.when(label == 1, 1.0).otherwise(0.0)).otherwise(p1)


def clip_proba(p: Column) -> Column:
    """H2: batch variant, clip only."""
    return F.least(F.greatest(p, F.lit(0.0)), F.lit(1.0))


def verdict(p: Column) -> Column:
    """H3: fraud >= 0.75 > suspect >= 0.35 > safe (canonical codes)."""
    return (F.when(p >= C.FRAUD_THRESHOLD, F.lit("fraud"))
             .when(p >= C.SUSPECT_THRESHOLD, F.lit("suspect"))
             .otherwise(F.lit("safe")))


def verdict_label(code: Column) -> Column:
    """Display label of a verdict code."""
    m = F.create_map(*[x for k, v in C.VERDICT_LABELS.items() for x in (F.lit(k), F.lit(v))])
    return F.coalesce(m[code], code)


def confidence(p: Column) -> Column:
    """H4: confidence in the verdict: p, or 1 - p for a safe row."""
    return F.when(p >= C.SUSPECT_THRESHOLD, p).otherwise(F.lit(1.0) - p)


def add_verdict(df: DataFrame, p: str = "fraud_prob", clip: bool = True) -> DataFrame:
    """H2-H4 in one step: clipped probability, verdict code, confidence (4 dp)."""
    pc = clip_proba(F.col(p)) if clip else F.col(p)
    return (df.withColumn(p, pc)
              .withColumn("verdict", verdict(F.col(p)))
              .withColumn("confidence", F.round(confidence(F.col(p)), 4)))


def batch_summary(scored: DataFrame, by=()) -> DataFrame:
    """H8: total, safe, suspect, fraud counts (per ``by`` if given)."""
    aggs = [F.count(F.lit(1)).alias("total"),
            F.count_if(F.col("verdict") == "safe").alias("safe"),
            F.count_if(F.col("verdict") == "suspect").alias("suspect"),
            F.count_if(F.col("verdict") == "fraud").alias("fraud")]
    return scored.groupBy(*by).agg(*aggs)


def batch_flag(summary: DataFrame) -> DataFrame:
    """H9: has-fraud flag and the message shown with the counts."""
    return (summary.withColumn("has_fraud", F.col("fraud") > 0)
                   .withColumn("message", F.when(F.col("fraud") > 0,
                                                 F.format_string("Detected %d fraudulent of %d transactions",
                                                                 F.col("fraud"), F.col("total")))
                                          .otherwise(F.format_string("All %d transactions look safe",
                                                                     F.col("total")))))


def new_batch_id(source: Column, stamp: Column) -> Column:
    """H7: 8 hex characters, constant per batch.  ``source`` and ``stamp`` must
    tell uploads apart: a file's path with its length and time of change (then
    the id repeats for the same file), or any fresh unique text."""
    return F.substring(F.md5(F.concat_ws("|", source.cast("string"), stamp.cast("string"))), 1, 8)


def row_numbers(df: DataFrame, order: str, out: str = "row") -> DataFrame:
    """1-based row number in source order without a single-task window; ``out``
    must not name a column of ``df`` in any case."""
    if out.lower() in (c.lower() for c in df.columns):
        raise ValueError(f"column {out!r} exists already")
    from ..functions.dist import range_numbers
    return range_numbers(df, order, out)
