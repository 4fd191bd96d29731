"""Reports over the scoring-history table.

The history table is partitioned by ``batch_id`` on disk, so per-batch reports
prune to one partition; the demo (non-batch) rows sit in the null partition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import config as C
from ..functions.dist import quantile_bucket, running_sums
from ..session import cut_lineage
from .clean import batch_rows, demo_rows, display_time, falsy_default, unpack_features


def _pct(c: Column) -> Column:
    return F.format_string("%.1f%%", c * 100.0)


def recent_history(h: DataFrame, n: int = 50) -> DataFrame:
    """Newest demo rows, local time text (ties broken by id, T9)."""
    top = demo_rows(h).orderBy(F.desc("timestamp"), F.desc("id")).limit(n)
    return top.select("id", display_time(F.col("timestamp")).alias("timestamp"), "amount", "verdict",
                      "probability", "model_used")


def history_item(h: DataFrame, item_id: Column) -> DataFrame:
    """One row with its features unpacked (lenient)."""
    return h.where(F.col("id") == item_id).select(
        F.col("time_val").alias("Time"), F.col("amount").alias("Amount"), *unpack_features(F.col("v_features")),
        "prediction", "probability", "verdict", "model_used")


def context_lines(h: DataFrame, fetch: int = 20, show: int = 10) -> DataFrame:
    """The newest demo rows as report lines (20 fetched, 10 shown)."""
    top = demo_rows(h).orderBy(F.desc("timestamp"), F.desc("id")).limit(fetch)
    ranked = top.withColumn("pos", F.row_number().over(Window.orderBy(F.desc("timestamp"), F.desc("id"))))
    line = F.format_string("- %s: %.2f$ [%s] -> %s (%.1f%%)", F.col("timestamp").cast("string"),
                           F.col("amount"), F.col("model_used"), F.col("verdict"),
                           F.col("probability") * 100.0)
    return ranked.where(F.col("pos") <= show).select("pos", "id", line.alias("line"))


def context_stats(h: DataFrame) -> DataFrame:
    """I4: avg amount and count of safe demo rows, count of fraud demo rows (one scan)."""
    d = demo_rows(h)
    safe = F.col("verdict") == "safe"
    return d.agg(F.coalesce(F.avg(F.when(safe, F.col("amount"))), F.lit(0.0)).alias("avg_safe_amount"),
                 F.count_if(safe).alias("safe_count"),
                 F.count_if(F.col("verdict") == "fraud").alias("fraud_count"))


def context_text(h: DataFrame) -> DataFrame:
    """The summary block assembled from I3 and I4 (at most 10 lines)."""
    st = context_stats(h)
    lines = context_lines(h).agg(
        F.coalesce(F.concat_ws("\n", F.transform(F.sort_array(F.collect_list(F.struct("pos", "line"))),
                                                 lambda s: s["line"])), F.lit("")).alias("recent"))
    head = F.format_string("SYSTEM OVERVIEW:\n- Safe transactions: %d\n- Average safe amount: %.2f$\n"
                           "- Fraud cases blocked: %d\n\nRECENT TRANSACTIONS:\n",
                           F.lit(st.select("safe_count").scalar()), F.lit(st.select("avg_safe_amount").scalar()),
                           F.lit(st.select("fraud_count").scalar()))
    return lines.select(F.concat(head, F.col("recent")).alias("context"))


def batch_meta(h: DataFrame) -> DataFrame:
    """Customer, bank and model of each batch, from its first row by id."""
    return batch_rows(h).groupBy("batch_id").agg(
        F.min_by(F.struct("customer_name", "bank_name", "model_used"), F.col("id")).alias("m")
    ).select("batch_id", "m.customer_name", "m.bank_name", "m.model_used")


def batch_counts(h: DataFrame) -> DataFrame:
    """Count, fraud and suspect per batch (conditional sums, null -> 0)."""
    return batch_rows(h).groupBy("batch_id").agg(
        F.count(F.lit(1)).alias("total"),
        F.coalesce(F.sum(F.when(F.col("verdict") == "fraud", 1).otherwise(0)), F.lit(0)).alias("fraud"),
        F.coalesce(F.sum(F.when(F.col("verdict") == "suspect", 1).otherwise(0)), F.lit(0)).alias("suspect"))


def batch_risky(h: DataFrame) -> DataFrame:
    """I8: non-safe rows of each batch by time, confidence as text."""
    return (batch_rows(h).where(F.col("verdict") != "safe")
            .select("batch_id", "id", F.col("time_val").alias("time_sec"), F.col("amount").alias("amount_vnd"),
                    "verdict", _pct(F.col("probability")).alias("confidence"),
                    F.col("tx_description").alias("description"))
            .orderBy("batch_id", "time_sec", "id"))


def batch_context_json(h: DataFrame, batch_id: Column | None = None) -> DataFrame:
    """Every row of a batch (each batch when ``batch_id`` is None) as one
    JSON array in time order.

    One batch is one uploaded file, so the array is bounded by the upload size.
    """
    rows = h.where(F.col("batch_id").isNotNull()) if batch_id is None else h.where(F.col("batch_id") == batch_id)
    item = F.struct(F.col("time_val").alias("time"), F.col("amount"), F.col("verdict"),
                    F.col("tx_description").alias("desc"))
    return rows.groupBy("batch_id").agg(
        F.to_json(F.transform(F.sort_array(F.collect_list(F.struct("time_val", "id", item.alias("t")))),
                              lambda s: s["t"])).alias("context_json"))


def batch_context_fragments(h: DataFrame, rows: int = 1000) -> DataFrame:
    """I9 for batches of any size: (batch_id, fragment, n, context_json), each
    fragment a JSON array of up to ``rows`` rows in time order, fragments numbered
    from 0 in that order.  No task holds more than a fragment of a batch as one value."""
    d = h.where(F.col("batch_id").isNotNull()).select("batch_id", "id", "time_val", "amount", "verdict", "tx_description")
    d = cut_lineage(d, "batch-rows")
    place = running_sums(quantile_bucket(d.withColumn("_o", F.coalesce("time_val", F.lit(float("-inf")))), "_o"), [F.asc_nulls_first("time_val"), F.col("id")], {"_n": F.lit(1)}, partition_by=["batch_id"])
    item = F.struct(F.col("time_val").alias("time"), F.col("amount"), F.col("verdict"), F.col("tx_description").alias("desc"))
    return (place.groupBy("batch_id", F.floor((F.col("_n") - 1) / rows).cast("long").alias("fragment"))
            .agg(F.count(F.lit(1)).alias("n"), F.to_json(F.transform(F.sort_array(F.collect_list(F.struct("_n", item.alias("t")))), lambda s: s["t"])).alias("context_json")))


def write_batch_contexts(h: DataFrame, path: str, rows: int = 1000) -> None:
    """I9 as files: the fragments of every batch, in order, by batch bucket."""
    (batch_context_fragments(h, rows).repartitionByRange("batch_id", "fragment").sortWithinPartitions("batch_id", "fragment").write.mode("overwrite").json(path))


def batch_list(h: DataFrame, n: int = 50) -> DataFrame:
    """Per (batch, customer, bank, model) totals, newest first."""
    g = batch_rows(h).groupBy("batch_id", "customer_name", "bank_name", "model_used").agg(
        F.count(F.lit(1)).alias("total"),
        F.sum(F.when(F.col("verdict") == "safe", 1).otherwise(0)).alias("safe"),
        F.sum(F.when(F.col("verdict") == "fraud", 1).otherwise(0)).alias("fraud"),
        F.min("timestamp").alias("_first"))
    top = g.orderBy(F.desc("_first"), "batch_id", "model_used").limit(n)
    return top.select("batch_id", falsy_default(F.col("customer_name"), "").alias("customer_name"),
                      falsy_default(F.col("bank_name"), "").alias("bank_name"),
                      falsy_default(F.col("model_used"), "").alias("model_used"), "total", "safe", "fraud",
                      display_time(F.col("_first"), minutes_only=True).alias("imported_at"))


def batch_detail(h: DataFrame, batch_id: Column | None = None) -> DataFrame:
    """Rows of a batch (every batch when ``batch_id`` is None) with defaults."""
    rows = batch_rows(h) if batch_id is None else h.where(F.col("batch_id") == batch_id)
    return rows.select("batch_id", "id", F.col("timestamp").cast("string").alias("timestamp"), "amount", "verdict",
                       "probability", "model_used", falsy_default(F.col("tx_description"), "").alias("description"),
                       falsy_default(F.col("customer_name"), "").alias("customer_name"),
                       falsy_default(F.col("bank_name"), "").alias("bank_name"),
                       F.coalesce(F.col("time_val"), F.lit(0.0)).alias("time_val"),
                       *unpack_features(F.col("v_features")),
                       falsy_default(F.col("model_id"), C.DEFAULT_MODEL_ID).alias("model_id"))


def reverse_index(top: DataFrame, order: list[Column]) -> DataFrame:
    """Label rows n, n-1, ..., 1 in display order (over a <= 50-row result)."""
    return top.withColumn("display_no", F.count(F.lit(1)).over(Window.partitionBy())
                          - F.row_number().over(Window.orderBy(*order)) + 1)
