"""Alert rules over metric samples (L1-L10), written once over a DataFrame.

A static table gives the checked batch result; the same functions run on a
micro-batch or on a stream (see ``streaming.jobs``).  Samples are
``(sample_id, ts, series, counter, gauge, event_type)``.

* ``counter_increase`` (L1): increase of a restart counter inside the trailing
  window, resets handled (a drop means the counter restarted from zero), no
  extrapolation; rate = increase / window seconds.
* ``window_ratio`` (L2, L4): a ratio of two conditional aggregates per
  (instance, tumbling window): one grouped pass, no self-join.
* ``cpu_busy`` (L3): 100 - 100 * average idle rate per (instance, window).
* ``latest_below`` (L5): latest sample per series under a threshold.
* ``sustained`` (L6): islands where a condition holds on every sample; an
  island fires once it has lasted ``for`` seconds.
* ``group_alerts`` (L7): notification times per (alertname, namespace) with
  group wait, group interval and repeat interval.
* ``route_alerts`` (L8), ``render_alert`` (L9), ``retain`` (L10).
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import config as C
from ..functions.dist import quantile_bucket, running_sums
from ..functions.timewin import with_halo

US = 1_000_000


def _ts_us(df: DataFrame, ts: str = "ts") -> DataFrame:
    return df.withColumn("_ts_us", F.unix_micros(F.col(ts).cast("timestamp")))


def counter_increase(samples: DataFrame, window_s: int, series: str = "series", value: str = "counter",
                     ts: str = "ts", tie: str = "sample_id") -> DataFrame:
    """L1: per sample, increase and per-second rate of the counter over the
    trailing ``window_s`` seconds; ``firing`` = rate > 0."""
    d = _ts_us(samples, ts)
    # increments need the previous sample: taken inside the halo partitioning
    h = with_halo(d, "_ts_us", window_s * US)
    part = Window.partitionBy(series, "_tb").orderBy("_ts_us", tie)
    h = h.withColumn("_prev", F.lag(F.col(value)).over(part))
    inc = F.when(F.col("_prev").isNull(), F.lit(0.0)) \
           .when(F.col(value) >= F.col("_prev"), F.col(value) - F.col("_prev")).otherwise(F.col(value))
    h = h.withColumn("_inc", inc)
    frame = Window.partitionBy(series, "_tb").orderBy("_ts_us").rangeBetween(-(window_s * US - 1), 0)
    h = (h.withColumn("_sum", F.sum("_inc").over(frame))
          .withColumn("_first", F.min_by("_inc", F.struct("_ts_us", tie)).over(frame)))
    out = h.where(~F.col("_halo"))
    incr = F.col("_sum") - F.col("_first")
    return out.select(samples.columns + [incr.alias("increase"), (incr / F.lit(float(window_s))).alias("rate")]) \
              .withColumn("firing", F.col("rate") > 0)


def tumbling(ts: Column, seconds: int) -> Column:
    """Start of the tumbling window holding ``ts``."""
    return F.timestamp_seconds(F.floor(F.unix_seconds(ts.cast("timestamp")) / seconds) * seconds)


def window_ratio(samples: DataFrame, num: Column, den: Column, window_s: int, instance: str = "series",
                 ts: str = "ts", complement: bool = False) -> DataFrame:
    """L2 / L4: pct = num_agg / den_agg * 100 (or (1 - ratio) * 100) per
    (instance, window); both aggregates in one grouped pass."""
    g = samples.groupBy(instance, tumbling(F.col(ts), window_s).alias("window_start")) \
               .agg(num.alias("_num"), den.alias("_den"))
    ratio = F.try_divide(F.col("_num"), F.col("_den"))
    pct = ((F.lit(1.0) - ratio) if complement else ratio) * F.lit(100.0)
    return g.select(instance, "window_start", pct.alias("value"))


def cpu_busy(rates: DataFrame, window_s: int, instance: str = "series", ts: str = "ts") -> DataFrame:
    """L3: 100 - avg(idle rate) * 100 per (instance, window)."""
    return (rates.groupBy(instance, tumbling(F.col(ts), window_s).alias("window_start"))
                 .agg((F.lit(100.0) - F.avg("rate") * F.lit(100.0)).alias("value")))


def latest_below(samples: DataFrame, value: str, threshold: float, series: str = "series", ts: str = "ts",
                 tie: str = "sample_id") -> DataFrame:
    """The latest sample of every series, firing when below the threshold."""
    last = samples.groupBy(series).agg(
        F.max_by(F.col(value), F.struct(F.col(ts), F.col(tie))).alias("value"),
        F.max(ts).alias("ts"))
    return last.withColumn("firing", F.col("value") < F.lit(threshold))


def sustained(samples: DataFrame, cond: Column, for_s: int, series: str = "series", ts: str = "ts",
              tie: str = "sample_id", n_buckets: int | None = None) -> DataFrame:
    """Islands of consecutive samples meeting ``cond``; an island fires
    once its span reaches ``for_s`` seconds.  Output: (series, island_start,
    island_end, samples, fired_at)."""
    d = samples.withColumn("_ok", F.coalesce(cond, F.lit(False)))
    d = d.withColumn("_ord", F.unix_micros(F.col(ts).cast("timestamp")).cast("double"))
    b = quantile_bucket(d, "_ord", n_buckets)
    # island id = number of breaking samples so far in the series
    r = running_sums(b, [F.col("_ord"), F.col(tie)], {"_isl": (~F.col("_ok")).cast("long")}, partition_by=[series])
    ok = r.where("_ok")
    isl = ok.groupBy(series, "_isl").agg(F.min(ts).alias("island_start"), F.max(ts).alias("island_end"),
                                        F.count(F.lit(1)).alias("samples"))
    span = F.unix_micros(F.col("island_end").cast("timestamp")) - F.unix_micros(F.col("island_start").cast("timestamp"))
    fired = isl.where(span >= F.lit(for_s * US))
    # the first sample at which the island had lasted long enough
    first_fire = (ok.join(fired.select(series, "_isl", "island_start"), [series, "_isl"])
                    .where(F.unix_micros(F.col(ts).cast("timestamp"))
                           - F.unix_micros(F.col("island_start").cast("timestamp")) >= F.lit(for_s * US))
                    .groupBy(series, "_isl").agg(F.min(ts).alias("fired_at")))
    return fired.join(first_fire, [series, "_isl"]).drop("_isl")


# ---- L7 grouping of notifications ---------------------------------------------

def _schedule(pdf: pd.DataFrame, wait_s: int, interval_s: int, repeat_s: int) -> pd.DataFrame:
    """Notification times of one group from its sorted evaluation ticks.

    ``new`` counts alerts whose first firing tick is that tick.  The first
    notification waits ``wait_s``; later ones go out when new alerts arrived
    since the last one and ``interval_s`` has passed, or, with nothing new,
    every ``repeat_s`` while the group keeps firing."""
    pdf = pdf.sort_values("tick")
    sent, last, pending = [], None, False
    for t, new in zip(pdf["tick"].to_numpy(dtype=float), pdf["new"].to_numpy()):
        if last is None:
            last = t + wait_s
            sent.append(last)
            continue
        pending = pending or (new > 0 and t > last)
        if t < last:
            continue
        if (pending and t - last >= interval_s) or t - last >= repeat_s:
            sent.append(t)
            last, pending = t, False
    key = pdf.iloc[0]
    return pd.DataFrame({"alertname": key["alertname"], "namespace": key["namespace"], "sent_at": sent})


def group_alerts(firing: DataFrame, wait_s: int = C.ALERT_GROUP_WAIT_S, interval_s: int = C.ALERT_GROUP_INTERVAL_S,
                 repeat_s: int = C.ALERT_REPEAT_S, tick_s: int = 30, alert_key: str = "series") -> DataFrame:
    """Notification times per (alertname, namespace).

    Firing rows are first reduced to one row per group and evaluation tick
    (with the number of alerts first seen at that tick), so the state machine
    of a group sees a table bounded by the time span, not by the number of
    alerts or samples."""
    tick = (F.floor(F.unix_seconds(F.col("ts").cast("timestamp")) / tick_s) * tick_s).cast("double")
    g = C.ALERT_GROUP_BY
    f = firing.select(*g, alert_key, tick.alias("tick"))
    first = f.groupBy(*g, alert_key).agg(F.min("tick").alias("tick")).groupBy(*g, "tick") \
             .agg(F.count(F.lit(1)).alias("new"))
    ticks = f.select(*g, "tick").distinct().join(first, [*g, "tick"], "left") \
             .withColumn("new", F.coalesce("new", F.lit(0)))
    return ticks.groupBy(*g).applyInPandas(
        lambda pdf: _schedule(pdf, wait_s, interval_s, repeat_s),
        "alertname string, namespace string, sent_at double"
    ).withColumn("sent_at", F.timestamp_seconds(F.col("sent_at")))


def route_alerts(alerts: DataFrame) -> DataFrame:
    """Alerts whose severity matches the route go to the receiver."""
    return alerts.withColumn("receiver", F.when(F.col("severity").rlike(f"^({C.ALERT_ROUTE_SEVERITY})$"),
                                                F.lit("notify")))


RULES_SCHEMA = "alertname string, severity string, for_s int, template string"


def render_alert(alerts: DataFrame, rules: DataFrame) -> DataFrame:
    """Description text from the rule's template: {instance}, {pod},
    {namespace} and {value} (printed with one decimal)."""
    j = alerts.join(F.broadcast(rules), "alertname")  # one row per rule
    t = F.col("template")
    for key in ("instance", "pod", "namespace"):
        t = F.replace(t, F.lit("{" + key + "}"), F.coalesce(F.col(key).cast("string"), F.lit("")))
    t = F.replace(t, F.lit("{value}"), F.format_string("%.1f", F.col("value")))
    return j.withColumn("description", t)


def rules_table(spark) -> DataFrame:
    return spark.createDataFrame([tuple(r) for r in C.ALERT_RULES], RULES_SCHEMA)


def retain(samples: DataFrame, days: int = C.RETENTION_DAYS, ts: str = "ts", now: Column | None = None) -> DataFrame:
    """Drop samples older than ``days`` before ``now`` (default: the latest sample)."""
    if now is None:
        latest = samples.agg(F.max(ts)).first()[0]  # one value
        if latest is None:
            return samples
        now = F.lit(latest)
    return samples.where(F.col(ts) > now - F.expr(f"INTERVAL {days} DAYS"))
