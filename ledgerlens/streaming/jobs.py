"""Structured Streaming jobs: scoring stream (H10), log ingest (A19, A20) and
windowed metric counts (the stream twin of the batch rules).

Every stream is checkpointed in the cluster's shared checkpoint folder and
written with ``foreachBatch`` so that a replayed micro-batch *replaces* its
own output folder (``batch=<id>``) instead of appending twice: the sink is
idempotent per (query, batch id).  ``trigger(availableNow=True)`` processes
what is there and stops, which is how the checked queries run them; a
service would use a processing-time trigger instead.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_dir
from ..sources import io


def stream_table(spark: SparkSession, sf_dir: str, name: str, max_files: int = 1) -> DataFrame:
    """A driver table read as a file stream (schema taken from the batch file)."""
    path = f"{sf_dir.rstrip('/')}/{name}.parquet"
    schema = spark.read.parquet(path).schema
    return (spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet")
                 .option("maxFilesPerTrigger", max_files).parquet(sf_dir))


def idempotent_sink(out_dir: str, partition_by: list[str] | None = None) -> Callable[[DataFrame, int], None]:
    """foreachBatch writer: micro-batch ``b`` owns ``out_dir/batch=b``."""
    def write(batch: DataFrame, batch_id: int) -> None:
        w = batch.write.mode("overwrite")
        if partition_by:
            w = w.partitionBy(*partition_by)
        w.parquet(f"{out_dir}/batch={batch_id}")
    return write


def checkpoint_of(spark: SparkSession, name: str, out_dir: str) -> str:
    """The checkpoint belongs to the query's name and its output folder, so a
    restart goes on where the last run stopped instead of at batch 0."""
    return shared_dir(spark, f"streams/{name}-{hashlib.md5(out_dir.encode()).hexdigest()[:16]}/checkpoint")


def run_available(df: DataFrame, name: str, sink: Callable[[DataFrame, int], None], out_dir: str,
                  output_mode: str = "append", dropped: str | None = None) -> str:
    """Run a stream over everything available now; returns the checkpoint path.

    ``dropped``: folder for the number of rows that Spark dropped behind the
    watermark and of rows left in state, by micro-batch."""
    spark = df.sparkSession
    ckpt = checkpoint_of(spark, name, out_dir)
    if dropped:
        spark.conf.set("spark.sql.streaming.numRecentProgressUpdates", "100000")
    q = (df.writeStream.outputMode(output_mode).foreachBatch(sink)
           .option("checkpointLocation", ckpt).trigger(availableNow=True).start())
    q.awaitTermination()
    if dropped:
        rows = {p.batchId: (sum(o.numRowsDroppedByWatermark for o in p.stateOperators), sum(o.numRowsTotal for o in p.stateOperators))
                for p in q.recentProgress if p.stateOperators}
        counts = spark.createDataFrame([(b, *r) for b, r in sorted(rows.items())], "batch long, dropped long, state long")
        counts.coalesce(1).write.mode("append").parquet(dropped)
    return ckpt


def score_stream(events: DataFrame, score: Callable[[DataFrame], DataFrame], out_dir: str) -> str:
    """Score each arriving row with the same DataFrame functions as the
    batch path and append it to a folder, replay-safe."""
    scored = score(events)
    return run_available(scored, "score", idempotent_sink(out_dir), out_dir)


def score_into_history(events: DataFrame, score: Callable[[DataFrame], DataFrame], store: str, writer: str = "score") -> str:
    """H10 into A11: score arriving rows and append them to the history store,
    each micro-batch exactly once (see ``io.append_once``)."""
    def write(batch: DataFrame, batch_id: int) -> None:
        io.append_once(batch, store, writer, batch_id)
    return run_available(score(events), writer, write, store)


def ingest_logs(spark: SparkSession, log_dir: str) -> DataFrame:
    """Tail container log files ``<pod>_<namespace>_<container>-<id>.log``
    (files, or folders of files); pod, namespace and container come from the
    name, time from the line."""
    lines = spark.readStream.text(f"{log_dir.rstrip('/')}/*.log")
    path = F.regexp_extract(F.input_file_name(), r"([^/]+)\.log(/|$)", 1)
    ts = F.to_timestamp(F.regexp_extract("value", r"^(\S+ \S+)", 1), "yyyy-MM-dd HH:mm:ss.SSSSSS")
    return lines.select(
        F.regexp_extract(path, r"^([^_]+)_", 1).alias("pod"),
        F.regexp_extract(path, r"^[^_]+_([^_]+)_", 1).alias("namespace"),
        F.regexp_extract(path, r"^[^_]+_[^_]+_(.+)-[^-]+$", 1).alias("container"),
        ts.alias("ts"), F.col("value").alias("message"))


def log_index(logs: DataFrame, fmt: str = "yyyy.MM.dd") -> DataFrame:
    """Daily index name, used as the partition column of the log store."""
    return logs.withColumn("index", F.concat(F.lit("filebeat-"), F.date_format("ts", fmt)))


def windowed_counts(samples: DataFrame, window: str, watermark: str, key: str = "series",
                    cond: F.Column | None = None) -> DataFrame:
    """Tumbling-window counts per key with a watermark (late rows are dropped
    once their window is closed)."""
    s = samples.withWatermark("ts", watermark)
    c = F.count_if(cond) if cond is not None else F.count(F.lit(1))
    return s.groupBy(key, F.window("ts", window)).agg(c.alias("n"))
