"""The metric rules L1-L6 on streams, held to their batch forms.

Three kinds of state:

* ``rule_stream`` (L1, L3, and any rule over a span of time): samples are kept in
  a store by day; each micro-batch re-applies the batch rule where its samples
  can change a result and writes those results anew.  A late sample inside the
  watermark therefore corrects what was told before; a later one goes to a table
  of late rows.  ``current_results`` reads the newest version of each result.
* ``ratio_stream`` (L2, L4): two metric streams, each aggregated by window, joined
  as streams on (instance, window); closed windows leave the state.
* ``sustained_stream`` (L6): a keyed state processor with event-time timers.  A
  series' state is its open island and the samples that the watermark has not
  passed yet; ``current_islands`` reads the result so far.
* ``latest_stream`` (L5): one row of state for each series; order plays no part.

Every sink is written by micro-batch and replaced by a replay.
"""

from __future__ import annotations

from array import array
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor

from . import retention
from .jobs import checkpoint_of, idempotent_sink, run_available
from .signals import US

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


# ---------------------------------------------------------------- rules over a span of time

@dataclass(frozen=True)
class Rule:
    """A batch rule.  Its result at time t depends on samples of the same series
    in [t - before_s, t + after_s]; ``keys`` name a result, the series first."""

    apply: Callable[[DataFrame], DataFrame]
    keys: tuple[str, ...]
    at: str
    before_s: float = 0
    after_s: float = 0


def _seconds(s: float) -> Column:
    return F.make_dt_interval(secs=F.lit(float(s)))


def _told(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.read.schema(schema).parquet(path)


_LOG = T.StructType([T.StructField("max_ts", T.TimestampType()), T.StructField("n_in", T.LongType()), T.StructField("n_late", T.LongType()),
                     T.StructField("batch", T.LongType())])


def watermark_before(spark: SparkSession, log: str, batch_id: int, delay_s: float):
    """The latest sample of the micro-batches before this one, less the delay; None at first."""
    if batch_id == 0:
        return None
    latest = _told(spark, log, _LOG).where(F.col("batch") < batch_id).agg((F.max("max_ts") - _seconds(delay_s)).alias("w")).first()
    return latest["w"]


def rule_stream(samples: DataFrame, rule: Rule, delay_s: float, out_dir: str, ts: str = "ts", name: str = "rule") -> str:
    """Apply a rule to everything available; returns the checkpoint's path.

    Under ``out_dir``: ``samples`` (by day and micro-batch), ``late`` (rows older than
    the latest sample of earlier micro-batches by more than ``delay_s`` seconds, or
    without a time), ``results`` and ``log`` (rows and late rows of each micro-batch).
    """
    series = rule.keys[0]
    store, late_dir, results, log = (f"{out_dir}/{x}" for x in ("samples", "late", "results", "log"))

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        w = watermark_before(spark, log, batch_id, delay_s)
        on_time = F.col(ts).isNotNull() if w is None else F.coalesce(F.col(ts) >= F.lit(w), F.lit(False))
        batch.where(~on_time).write.mode("overwrite").parquet(f"{late_dir}/batch={batch_id}")
        retention.put(batch.where(on_time), store, batch_id, ts)
        known = retention.samples(spark, store, batch.schema).where(F.col("batch") <= batch_id)
        new = known.where(F.col("batch") == batch_id)
        span = new.groupBy(F.col(series).alias("_s")).agg(F.min(ts).alias("_lo"), F.max(ts).alias("_hi"))
        whole = span.agg(F.min("_lo").alias("lo"), F.max("_hi").alias("hi")).first()
        n_late = spark.read.schema(batch.schema).parquet(f"{late_dir}/batch={batch_id}").count()
        if whole["lo"] is not None:
            # results that the new samples can change lie in [lo - after, hi + before], and their samples around those
            reach = _seconds(rule.before_s + rule.after_s)
            near = known.where(F.col("day").between(*[F.date_format(F.lit(v) + s * reach, "yyyyMMdd") for v, s in ((whole["lo"], F.lit(-1)), (whole["hi"], F.lit(1)))]))
            near = near.join(span, F.col(series) == F.col("_s")).where(F.col(ts).between(F.col("_lo") - reach, F.col("_hi") + reach))
            told = rule.apply(near.select(*batch.columns)).join(span, F.col(series) == F.col("_s"))
            told = told.where(F.col(rule.at).between(F.col("_lo") - _seconds(rule.after_s), F.col("_hi") + _seconds(rule.before_s))).drop("_s", "_lo", "_hi")
            told.write.mode("overwrite").parquet(f"{results}/batch={batch_id}")
        rows = new.agg(F.count("*").alias("n"), F.max(ts).alias("max_ts"))
        rows.select("max_ts", (F.col("n") + n_late).alias("n_in"), F.lit(n_late).cast("long").alias("n_late")).write.mode("overwrite").parquet(f"{log}/batch={batch_id}")

    return run_available(samples, name, write, out_dir)


def current_results(spark: SparkSession, out_dir: str, rule: Rule) -> DataFrame:
    """The newest version of each result of a rule's stream."""
    rows = spark.read.option("mergeSchema", "false").parquet(f"{out_dir}/results")
    return rows.groupBy(*rule.keys).agg(F.max_by(F.struct(*[c for c in rows.columns if c not in (*rule.keys, "batch")]), "batch").alias("_r")).select(*rule.keys, "_r.*")


def late_rows(spark: SparkSession, out_dir: str, schema: T.StructType) -> DataFrame:
    """Late rows and the micro-batch in which they came."""
    return _told(spark, f"{out_dir}/late", T.StructType([*schema.fields, T.StructField("batch", T.LongType())]))


def batch_log(spark: SparkSession, out_dir: str) -> DataFrame:
    """(batch, n_in, n_late, max_ts) of each micro-batch."""
    return _told(spark, f"{out_dir}/log", _LOG)


# ---------------------------------------------------------------- two metrics (L2, L4)

def ratio_stream(total: DataFrame, part: DataFrame, total_agg: Column, part_agg: Column, window: str, delay: str, out_dir: str, instance: str = "series",
                 ts: str = "ts", complement: bool = False, name: str = "ratio") -> str:
    """pct = part / total * 100 (or the rest to 100) per (instance, window) of two
    metric streams; a window without a part is told with a null value.  Windows
    are written once the watermark of both streams has passed their end."""
    a = total.withWatermark(ts, delay).groupBy(instance, F.window(ts, window).alias("w")).agg(total_agg.alias("_total"))
    b = (part.withWatermark(ts, delay).groupBy(F.col(instance).alias("_instance"), F.window(ts, window).alias("_w")).agg(part_agg.alias("_part")))
    both = a.join(b, (F.col(instance) == F.col("_instance")) & (F.col("w") == F.col("_w")), "leftOuter")
    ratio = F.try_divide("_part", "_total")
    pct = ((1.0 - ratio) if complement else ratio) * 100.0
    return run_available(both.select(instance, F.col("w.start").alias("window_start"), pct.alias("value")), name, idempotent_sink(out_dir), out_dir)


# ---------------------------------------------------------------- the latest sample

def latest_stream(samples: DataFrame, value: str, threshold: float, out_dir: str, series: str = "series", ts: str = "ts", tie: str = "sample_id") -> str:
    """The latest sample of every series, told anew when it changes; late samples
    change nothing, so none is late."""
    last = samples.where(F.col(ts).isNotNull()).groupBy(series).agg(F.max_by(F.struct(F.col(value).alias("value"), F.col(ts).alias("ts")), F.struct(ts, tie)).alias("_r"))
    told = last.select(series, "_r.value", "_r.ts", (F.col("_r.value") < F.lit(threshold)).alias("firing"))
    return run_available(told, "latest", idempotent_sink(out_dir), out_dir, output_mode="update")


def current_latest(spark: SparkSession, out_dir: str, series: str = "series") -> DataFrame:
    rows = spark.read.parquet(out_dir)
    return rows.groupBy(series).agg(F.max_by(F.struct("value", "ts", "firing"), "batch").alias("_r")).select(series, "_r.*")


# ---------------------------------------------------------------- a condition that holds

ISLANDS = "series string, island_start timestamp, island_end timestamp, samples long, fired_at timestamp, final boolean, version long"


def walk(island, samples, for_us: int):
    """Islands that ``samples`` (us, tie, ok), in order, close, and the one left
    open: (start, last, samples, fired) or None."""
    closed = []
    for us, _, ok in samples:
        if not ok:
            if island is not None:
                closed.append(island)
            island = None
            continue
        start, _, n, fired = island or (us, us, 0, None)
        if fired is None and us - start >= for_us:
            fired = us
        island = (start, us, n + 1, fired)
    return closed, island


def packed(samples) -> bytes:
    """Samples (us, tie, ok) as three columns; 17 bytes each."""
    if not samples:
        return b""
    us, tie, ok = zip(*samples)
    flags = bytes(bool(o) | (t is None) << 1 for t, o in zip(tie, ok))
    return array("q", us).tobytes() + array("q", [t or 0 for t in tie]).tobytes() + flags


def unpacked(b: bytes) -> list:
    n, us, tie = len(b) // 17, array("q"), array("q")
    us.frombytes(b[:8 * n])
    tie.frombytes(b[8 * n:16 * n])
    return [(u, None if f & 2 else t, bool(f & 1)) for u, t, f in zip(us, tie, b[16 * n:])]


class Islands(StatefulProcessor):
    """State of a series: the island open at the watermark, the samples behind
    it still to come in order, and the number of versions told.  All of it is one
    value, the samples packed as columns, as each call to the store is a message to
    the executor: a series is read once and written once for each micro-batch.

    A version is what the series' open or provisional islands are now; islands
    that end before the watermark are told once, as final.  Timers are set to the
    time at which the open island will have lasted long enough and to the last
    sample held back, so that silence of a series holds nothing up."""

    def __init__(self, for_us: int):
        self.for_us = for_us

    def init(self, handle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", "pending binary, island array<long>, version long")

    def handleInputRows(self, key, rows, timerValues):
        yield from self.advance(key, [(r.us, r.tie, r.ok) for r in rows], timerValues)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        yield from self.advance(key, [], timerValues)

    def advance(self, key, samples, times):
        pending, island, version = self.state.get() or (b"", None, -1)
        samples = unpacked(pending) + samples
        # a tie may be null; nulls come first
        samples.sort(key=lambda s: (s[0], s[1] is not None, s[1] or 0, s[2]))
        passed = times.getCurrentWatermarkInMs() * 1000
        cut = next((i for i, s in enumerate(samples) if s[0] > passed), len(samples))
        closed, island = walk(tuple(island) if island else None, samples[:cut], self.for_us)
        ahead, last = walk(island, samples[cut:], self.for_us)
        if cut < len(samples):
            self.handle.registerTimer(samples[-1][0] // 1000 + 1)
        if island is not None and island[3] is None and island[0] + self.for_us > passed:
            self.handle.registerTimer((island[0] + self.for_us) // 1000 + 1)
        n = version + 1
        self.state.update((packed(samples[cut:]), None if island is None else list(island), n))
        yield Row(series=key[0], us=None, last=None, samples=None, fired=None, final=False, version=n)
        for final, found in ((True, closed), (False, [*ahead, last])):
            for i in found:
                if i is not None and i[3] is not None:
                    yield Row(series=key[0], us=i[0], last=i[1], samples=i[2], fired=i[3], final=final, version=n)


def sustained_stream(samples: DataFrame, cond: Column, for_s: float, delay: str, out_dir: str, series: str = "series", ts: str = "ts", tie: str = "sample_id",
                     name: str = "sustained") -> str:
    """L6 on a stream: islands of consecutive samples meeting ``cond`` that last
    ``for_s`` seconds.  Samples behind the watermark are dropped by Spark and
    counted in ``<out_dir>/dropped``."""
    spark = samples.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    keyed = (samples.where(F.col(ts).isNotNull()).withWatermark(ts, delay)
             .select(ts, F.col(series).cast("string").alias("series"), F.unix_micros(F.col(ts)).alias("us"), F.col(tie).cast("long").alias("tie"), F.coalesce(cond, F.lit(False)).alias("ok")))
    found = keyed.groupBy("series").transformWithState(Islands(int(for_s * US)), "series string, us long, last long, samples long, fired long, final boolean, version long", "Append", "EventTime")
    told = found.select("series", F.timestamp_micros("us").alias("island_start"), F.timestamp_micros("last").alias("island_end"), "samples",
                        F.timestamp_micros("fired").alias("fired_at"), "final", "version")
    return run_available(told, name, idempotent_sink(f"{out_dir}/islands"), out_dir, dropped=f"{out_dir}/dropped")


def current_islands(spark: SparkSession, out_dir: str) -> DataFrame:
    """Fired islands of all samples told so far: the final ones and each series' newest version of the others."""
    rows = spark.read.parquet(f"{out_dir}/islands")
    newest = rows.groupBy("series").agg(F.max("version").alias("_newest"))
    return (rows.join(newest, "series").where(F.col("island_start").isNotNull() & (F.col("final") | (F.col("version") == F.col("_newest"))))
            .select("series", "island_start", "island_end", "samples", "fired_at"))


__all__ = ["Rule", "rule_stream", "current_results", "late_rows", "batch_log", "ratio_stream", "latest_stream", "current_latest", "sustained_stream", "current_islands", "checkpoint_of"]
