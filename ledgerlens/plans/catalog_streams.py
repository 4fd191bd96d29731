"""Checked queries of the metric rules (L1-L10) and the streaming jobs
(H10, A19, A20).  Times are reported as epoch microseconds so both engines
print them the same way whatever the session time zone."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from .. import config as C
from ..functions.numeric import sig_round, sql_sig_round
from ..operators import scoring as S
from ..sources import fixtures as fx
from ..sources import io
from ..session import shared_dir
from ..streaming import jobs as SJ
from ..streaming import retention
from ..streaming import rules as R
from ..streaming import signals as L
from .registry import query

W = fx.sql_with
DAY = 86400
RATE_WINDOW_S = DAY          # scaled durations for the sparse fixture (FIXTURES §2)
SUSTAIN_S = 6 * 3600
SUSTAIN_LIMIT = 50.0


def _us(c):
    return F.unix_micros(F.col(c).cast("timestamp")).alias(c)


_L1_SQL = (
    W("metrics_ts") + ", s AS (SELECT *, epoch_us(ts) AS us FROM metrics_ts), "
    "l AS (SELECT *, lag(counter) OVER (PARTITION BY series ORDER BY us, sample_id) AS prev FROM s), "
    "i AS (SELECT *, CASE WHEN prev IS NULL THEN 0.0 WHEN counter >= prev THEN counter - prev ELSE counter END AS inc FROM l), "
    f"w AS (SELECT *, sum(inc) OVER f - first_value(inc) OVER f AS increase FROM i WINDOW f AS "
    f"(PARTITION BY series ORDER BY us RANGE BETWEEN {RATE_WINDOW_S * 1_000_000 - 1} PRECEDING AND CURRENT ROW)) ")


def _rates(spark, d):
    return L.counter_increase(fx.metrics_ts(spark, d), RATE_WINDOW_S)


@query("counter_rate", "L1",
       _L1_SQL + f"SELECT sample_id, series, increase, {sql_sig_round(f'increase / {float(RATE_WINDOW_S)!r}')} AS rate, "
       "increase > 0 AS firing FROM w")
def q_rate(spark, d):
    r = _rates(spark, d)
    return r.select("sample_id", "series", "increase", sig_round(F.col("rate")).alias("rate"), "firing")


def _win_sql(expr: str, alias: str = "value") -> str:
    return (f"SELECT series, CAST(floor(epoch(ts) / {DAY}) * {DAY} AS BIGINT) AS window_start, {expr} AS {alias} "
            "FROM metrics_ts GROUP BY 1, 2")


def _window_out(df, limit):
    return df.select("series", F.col("window_start").cast("long").alias("window_start"),
                     sig_round(F.col("value")).alias("value"), (F.col("value") > limit).alias("firing"))


@query("memory_pct", "L2",
       W("metrics_ts") + "SELECT series, window_start, " + sql_sig_round("value") + f" AS value, value > {C.MEMORY_PCT_LIMIT} AS firing FROM ("
       + _win_sql("(1.0 - avg(CASE WHEN event_type = 'view' THEN gauge END) / nullif(max(gauge), 0)) * 100.0") + ")")
def q_memory(spark, d):
    m = fx.metrics_ts(spark, d)
    r = L.window_ratio(m, F.avg(F.when(F.col("event_type") == "view", F.col("gauge"))), F.max("gauge"), DAY,
                       complement=True)
    return _window_out(r, C.MEMORY_PCT_LIMIT)


@query("connection_pct", "L4",
       W("metrics_ts") + "SELECT series, window_start, " + sql_sig_round("value") + f" AS value, value > {C.CONNECTION_PCT_LIMIT} AS firing FROM ("
       + _win_sql("avg(CASE WHEN event_type = 'click' THEN gauge END) / nullif(max(gauge), 0) * 100.0") + ")")
def q_connections(spark, d):
    m = fx.metrics_ts(spark, d)
    r = L.window_ratio(m, F.avg(F.when(F.col("event_type") == "click", F.col("gauge"))), F.max("gauge"), DAY)
    return _window_out(r, C.CONNECTION_PCT_LIMIT)


@query("cpu_pct", "L3",
       _L1_SQL + "SELECT series, window_start, " + sql_sig_round("value") + f" AS value, value > {C.CPU_PCT_LIMIT} AS firing FROM ("
       f"SELECT series, CAST(floor(epoch(ts) / {DAY}) * {DAY} AS BIGINT) AS window_start, "
       f"100.0 - avg(increase / {float(RATE_WINDOW_S)!r}) * 100.0 AS value FROM w GROUP BY 1, 2)")
def q_cpu(spark, d):
    return _window_out(L.cpu_busy(_rates(spark, d), DAY), C.CPU_PCT_LIMIT)


@query("latest_below", "L5",
       W("metrics_ts") + "SELECT series, gauge AS value, epoch_us(ts) AS ts, gauge < " + str(float(C.MIN_REPLICAS) * 10)
       + " AS firing FROM (SELECT *, row_number() OVER (PARTITION BY series ORDER BY ts DESC, sample_id DESC) AS rn "
       "FROM metrics_ts WHERE event_type = 'purchase') WHERE rn = 1")
def q_latest(spark, d):
    m = fx.metrics_ts(spark, d).where(F.col("event_type") == "purchase")  # label filter of the rule
    r = L.latest_below(m, "gauge", float(C.MIN_REPLICAS) * 10)
    return r.select("series", "value", _us("ts"), "firing")


_L6_SQL = (
    W("metrics_ts") + f", s AS (SELECT *, coalesce(gauge > {SUSTAIN_LIMIT}, false) AS ok, "
    f"sum(CASE WHEN coalesce(gauge > {SUSTAIN_LIMIT}, false) THEN 0 ELSE 1 END) OVER (PARTITION BY series "
    "ORDER BY ts, sample_id ROWS UNBOUNDED PRECEDING) AS isl FROM metrics_ts), "
    "i AS (SELECT series, isl, min(ts) AS island_start, max(ts) AS island_end, count(*) AS samples FROM s WHERE ok GROUP BY 1, 2), "
    f"f AS (SELECT * FROM i WHERE epoch_us(island_end) - epoch_us(island_start) >= {SUSTAIN_S * 1_000_000}), "
    "ff AS (SELECT s.series, s.isl, min(s.ts) AS fired_at FROM s JOIN f USING (series, isl) WHERE s.ok AND "
    f"epoch_us(s.ts) - epoch_us(f.island_start) >= {SUSTAIN_S * 1_000_000} GROUP BY 1, 2) ")


def _sustained(spark, d):
    return L.sustained(fx.metrics_ts(spark, d), F.col("gauge") > SUSTAIN_LIMIT, SUSTAIN_S)


@query("sustained", "L6",
       _L6_SQL + "SELECT f.series, epoch_us(island_start) AS island_start, epoch_us(island_end) AS island_end, "
       "samples, epoch_us(fired_at) AS fired_at FROM f JOIN ff USING (series, isl)")
def q_sustained(spark, d):
    s = _sustained(spark, d)
    return s.select("series", _us("island_start"), _us("island_end"), "samples", _us("fired_at"))


def _memory_alerts(spark, d):
    m = fx.metrics_ts(spark, d)
    r = L.window_ratio(m, F.avg(F.when(F.col("event_type") == "view", F.col("gauge"))), F.max("gauge"), DAY,
                       complement=True)
    return (r.where(F.col("value") > C.MEMORY_PCT_LIMIT)
             .select(F.lit("NodeHighMemory").alias("alertname"), F.lit("warning").alias("severity"),
                     F.col("series").alias("instance"), F.lit(None).cast("string").alias("pod"),
                     F.lit("prod").alias("namespace"), "value",
                     F.col("window_start").alias("ts")))


_TEMPLATE = dict((r[0], r[3]) for r in C.ALERT_RULES)["NodeHighMemory"]


@query("route_and_render", "L8 L9",
       W("metrics_ts") + "SELECT instance, window_start, 'notify' AS receiver, "
       "replace(replace('" + _TEMPLATE + "', '{instance}', instance), '{value}', printf('%.1f', value)) AS description FROM ("
       "SELECT series AS instance, window_start, value FROM ("
       + _win_sql("(1.0 - avg(CASE WHEN event_type = 'view' THEN gauge END) / nullif(max(gauge), 0)) * 100.0")
       + f") WHERE value > {C.MEMORY_PCT_LIMIT})")
def q_route(spark, d):
    a = L.route_alerts(_memory_alerts(spark, d))
    r = L.render_alert(a, L.rules_table(spark))
    return r.select("instance", F.unix_seconds("ts").alias("window_start"), "receiver", "description")


@query("group_alerts", "L7")
def q_group(spark, d):
    a = _memory_alerts(spark, d).withColumn("series", F.col("instance"))
    return L.group_alerts(a).select("alertname", "namespace", _us("sent_at"))


@query("retain", "L10",
       W("metrics_ts") + "SELECT sample_id FROM metrics_ts WHERE ts > (SELECT max(ts) FROM metrics_ts) - INTERVAL 7 DAY")
def q_retain(spark, d):
    return L.retain(fx.metrics_ts(spark, d)).select("sample_id")


# ---------------------------------------------------------------- rules on streams
# ``arrivals`` come in four deliveries, each a micro-batch; a tenth of the samples
# comes with the next one.  Results are those of the batch rules.

def _rule_root(spark, name):
    return shared_dir(spark, f"rules/{name}-{uuid.uuid4().hex[:8]}")


def _deliveries(spark, d, root):
    """The stream of deliveries, and twice a delivery's span of time in seconds."""
    stream = fx.sample_stream(spark, d, f"{root}/in")
    lo, hi = spark.read.schema(stream.schema).parquet(f"{root}/in").agg(F.unix_micros(F.min("ts")), F.unix_micros(F.max("ts"))).first()
    return stream, 2 * ((hi - lo) // fx.SLICES // 1_000_000 + 1)


RATE_RULE = R.Rule(lambda d: L.counter_increase(d, RATE_WINDOW_S), ("series", "sample_id"), "ts", before_s=RATE_WINDOW_S)
CPU_RULE = R.Rule(lambda d: L.cpu_busy(L.counter_increase(d, RATE_WINDOW_S), DAY), ("series", "window_start"), "window_start", before_s=RATE_WINDOW_S, after_s=DAY)


@query("stream_counter_rate", "L1",
       _L1_SQL + f"SELECT sample_id, series, increase, {sql_sig_round(f'increase / {float(RATE_WINDOW_S)!r}')} AS rate, "
       "increase > 0 AS firing FROM w")
def q_stream_rate(spark, d):
    root = _rule_root(spark, "rate")
    stream, delay = _deliveries(spark, d, root)
    R.rule_stream(stream, RATE_RULE, delay, f"{root}/out")
    return R.current_results(spark, f"{root}/out", RATE_RULE).select("sample_id", "series", "increase", sig_round(F.col("rate")).alias("rate"), "firing")


@query("stream_cpu_pct", "L3",
       _L1_SQL + "SELECT series, window_start, " + sql_sig_round("value") + f" AS value, value > {C.CPU_PCT_LIMIT} AS firing FROM ("
       f"SELECT series, CAST(floor(epoch(ts) / {DAY}) * {DAY} AS BIGINT) AS window_start, "
       f"100.0 - avg(increase / {float(RATE_WINDOW_S)!r}) * 100.0 AS value FROM w GROUP BY 1, 2)")
def q_stream_cpu(spark, d):
    root = _rule_root(spark, "cpu")
    stream, delay = _deliveries(spark, d, root)
    R.rule_stream(stream, CPU_RULE, delay, f"{root}/out")
    return _window_out(R.current_results(spark, f"{root}/out", CPU_RULE), C.CPU_PCT_LIMIT)


LATE_S = 3600


@query("stream_late_rows", "L1",
       W("arrivals") + ", d AS (SELECT slice, max(epoch_us(ts)) AS hi FROM arrivals GROUP BY slice) "
       f"SELECT sample_id, slice AS batch FROM arrivals a WHERE epoch_us(ts) < (SELECT max(hi) FROM d WHERE d.slice < a.slice) - {LATE_S * 1_000_000}")
def q_stream_late(spark, d):
    """Samples that come more than an hour behind the latest one of the deliveries before."""
    root = _rule_root(spark, "late")
    stream, _ = _deliveries(spark, d, root)
    R.rule_stream(stream, RATE_RULE, LATE_S, f"{root}/out")
    return R.late_rows(spark, f"{root}/out", stream.schema).select("sample_id", F.col("batch").cast("int").alias("batch"))


@query("stream_retain", "L10",
       W("metrics_ts") + "SELECT sample_id FROM metrics_ts WHERE CAST(ts AS DATE) >= (SELECT CAST(max(ts) AS DATE) FROM metrics_ts) - INTERVAL 7 DAY")
def q_stream_retain(spark, d):
    """Samples left in a rule's store after the retention job has dropped its old days."""
    root = _rule_root(spark, "retain")
    stream, delay = _deliveries(spark, d, root)
    R.rule_stream(stream, RATE_RULE, delay, f"{root}/out")
    retention.drop_days(spark, f"{root}/out/samples")
    return retention.samples(spark, f"{root}/out/samples", stream.schema).select("sample_id")


def _closed(sql: str, kind: str) -> str:
    """Windows that the watermark of both streams has passed at the end."""
    return (f"SELECT * FROM ({sql}) WHERE (window_start + {DAY}) * 1000 <= (SELECT least(max(epoch_ms(ts)), max(CASE WHEN event_type = '{kind}' THEN epoch_ms(ts) END)) "
            f"FROM metrics_ts) - {5 * DAY * 1000}")


def _ratio(spark, d, name, kind, complement, limit):
    root = _rule_root(spark, name)
    stream, _ = _deliveries(spark, d, root)
    other = spark.readStream.schema(stream.schema).option("maxFilesPerTrigger", fx.delivery_files(spark, f"{root}/in")).parquet(f"{root}/in").where(F.col("event_type") == kind)
    R.ratio_stream(stream, other, F.max("gauge"), F.avg("gauge"), "1 day", "5 days", f"{root}/out", complement=complement)
    return _window_out(spark.read.parquet(f"{root}/out"), limit)


@query("stream_memory_pct", "L2",
       W("metrics_ts") + "SELECT series, window_start, " + sql_sig_round("value") + f" AS value, value > {C.MEMORY_PCT_LIMIT} AS firing FROM ("
       + _closed(_win_sql("(1.0 - avg(CASE WHEN event_type = 'view' THEN gauge END) / nullif(max(gauge), 0)) * 100.0"), "view") + ")")
def q_stream_memory(spark, d):
    """Windows that the watermark has closed, of two metric streams joined as streams."""
    return _ratio(spark, d, "memory", "view", True, C.MEMORY_PCT_LIMIT)


@query("stream_connection_pct", "L4",
       W("metrics_ts") + "SELECT series, window_start, " + sql_sig_round("value") + f" AS value, value > {C.CONNECTION_PCT_LIMIT} AS firing FROM ("
       + _closed(_win_sql("avg(CASE WHEN event_type = 'click' THEN gauge END) / nullif(max(gauge), 0) * 100.0"), "click") + ")")
def q_stream_connections(spark, d):
    return _ratio(spark, d, "connections", "click", False, C.CONNECTION_PCT_LIMIT)


@query("stream_latest_below", "L5",
       W("metrics_ts") + "SELECT series, gauge AS value, epoch_us(ts) AS ts, gauge < " + str(float(C.MIN_REPLICAS) * 10)
       + " AS firing FROM (SELECT *, row_number() OVER (PARTITION BY series ORDER BY ts DESC, sample_id DESC) AS rn "
       "FROM metrics_ts WHERE event_type = 'purchase') WHERE rn = 1")
def q_stream_latest(spark, d):
    root = _rule_root(spark, "latest")
    stream, _ = _deliveries(spark, d, root)
    R.latest_stream(stream.where(F.col("event_type") == "purchase"), "gauge", float(C.MIN_REPLICAS) * 10, f"{root}/out")
    return R.current_latest(spark, f"{root}/out").select("series", "value", _us("ts"), "firing")


@query("stream_sustained", "L6",
       _L6_SQL + "SELECT f.series, epoch_us(island_start) AS island_start, epoch_us(island_end) AS island_end, "
       "samples, epoch_us(fired_at) AS fired_at FROM f JOIN ff USING (series, isl)")
def q_stream_sustained(spark, d):
    root = _rule_root(spark, "sustained")
    stream, delay = _deliveries(spark, d, root)
    R.sustained_stream(stream, F.col("gauge") > SUSTAIN_LIMIT, SUSTAIN_S, f"{delay} seconds", f"{root}/out")
    return R.current_islands(spark, f"{root}/out").select("series", _us("island_start"), _us("island_end"), "samples", _us("fired_at"))


# ---------------------------------------------------------------- streams
def _events_stream(spark, d):
    s = SJ.stream_table(spark, d, "events")
    return s.withColumn("ts", F.col("ts").cast("timestamp"))


@query("stream_verdicts", "H10 H3 H4 A11",
       W("scores") + f"SELECT id, p AS fraud_prob, CASE WHEN p >= {C.FRAUD_THRESHOLD} THEN 'fraud' WHEN p >= "
       f"{C.SUSPECT_THRESHOLD} THEN 'suspect' ELSE 'safe' END AS verdict, round(CASE WHEN p >= {C.SUSPECT_THRESHOLD} "
       "THEN p ELSE 1.0 - p END, 4) AS confidence FROM scores")
def q_stream_verdicts(spark, d):
    out = shared_dir(spark, f"streams/verdicts-{abs(hash(d)) % 10**8}-{uuid.uuid4().hex[:6]}")

    def score(ev):
        cls = ((F.col("event_type") == "error") & (F.col("value") >= 150)).cast("int")
        s = ev.select(F.col("event_id").alias("id"), cls.alias("Class"))
        s = s.withColumn("fraud_prob", fx.score_expr("id", "Class"))
        return S.add_verdict(s, "fraud_prob", clip=False)
    SJ.score_stream(_events_stream(spark, d), score, out)
    return spark.read.parquet(out).select("id", "fraud_prob", "verdict", "confidence")


@query("stream_error_windows", "L1 L6",
       "SELECT CAST(user_id AS VARCHAR) AS series, CAST(floor(epoch(ts) / 86400) * 86400 AS BIGINT) AS window_start, "
       "count_if(event_type = 'error') AS n FROM events GROUP BY 1, 2")
def q_stream_windows(spark, d):
    out = shared_dir(spark, f"streams/windows-{uuid.uuid4().hex[:8]}")
    ev = _events_stream(spark, d).withColumn("series", F.col("user_id").cast("string"))
    c = SJ.windowed_counts(ev, "1 day", "1 day", cond=F.col("event_type") == "error")
    SJ.run_available(c, "windows", SJ.idempotent_sink(out), out, output_mode="update")
    res = spark.read.parquet(out)       # a window's last update holds its count
    return res.groupBy("series", F.unix_seconds(F.col("window.start")).alias("window_start")).agg(F.max_by("n", "batch").alias("n"))


@query("stream_scored_history", "H10 A11",
       "SELECT event_id AS id, value AS amount, TRUE AS p_in_range, TRUE AS verdict_follows, TRUE AS as_batch FROM events")
def q_stream_history(spark, d):
    """Arriving events scored by a fitted model on scaled features and appended
    to the history store, each micro-batch once; ``as_batch``: the score stored is
    the one that the same model gives the row in a batch."""
    from ..operators import models, prep
    from . import jobs
    train, _, scaler = jobs.prepared(spark, fx.tx(spark, d))
    model = models.train_model("logistic_regression", train)
    emb = fx.table(spark, d, "embeddings")
    first = fx.table(spark, d, "events").agg(F.min("ts")).first()[0]
    n = emb.count()

    def score(ev):
        x = ev.join(emb, F.pmod("event_id", F.lit(n)) == F.col("vec_id"))
        micros = F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.lit(first).cast("timestamp"))
        raw = x.select(F.col("event_id").alias("id"), "ts", (micros.cast("double") / 1e6).alias("Time"),
                       *[F.col("embedding")[i].cast("double").alias(f"V{i + 1}") for i in range(28)],
                       F.col("value").alias("Amount"), F.col("value").alias("raw_amount"))
        p = model.predict(prep.apply_robust_scaler(raw, scaler))
        p = p.withColumn("fraud_prob", S.normalise_proba(F.array(1 - F.col("p"), F.col("p"))))
        p = S.add_verdict(p, "fraud_prob", clip=False)
        return p.select("id", F.col("ts").alias("timestamp"), F.col("raw_amount").alias("amount"), F.col("prediction").cast("int").alias("prediction"),
                        F.col("fraud_prob").alias("probability"), "verdict", F.lit("logistic_regression").alias("model_id"))

    store = shared_dir(spark, f"streams/history-{uuid.uuid4().hex[:8]}")
    SJ.score_into_history(_events_stream(spark, d), score, store)
    told = io.read_history(spark, store)
    batch = score(fx.table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))).select("id", F.col("probability").alias("_p"))
    p = F.col("probability")
    return told.join(batch, "id").select("id", "amount", p.between(0, 1).alias("p_in_range"), (F.col("verdict") == S.verdict(p)).alias("verdict_follows"),
                                         (F.abs(p - F.col("_p")) < 1e-12).alias("as_batch"))


# ---- fixed values: labels of the derived container logs ------------------------
LOG_PODS = ["app-0", "app-1", "postgresql-0"]


def _write_logs(spark, d) -> str:
    """Container logs derived from the events table, one log per pod."""
    ev = fx.table(spark, d, "events")
    pods = F.array(*[F.lit(p) for p in LOG_PODS])
    line = F.concat_ws(" ", F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS"), F.upper("event_type"), F.col("props"))
    logs = ev.select(F.element_at(pods, (F.pmod("user_id", F.lit(len(LOG_PODS))) + 1).cast("int")).alias("pod"), line.alias("value"))
    path = shared_dir(spark, f"logs/containers-{uuid.uuid4().hex[:8]}")
    for pod in LOG_PODS:
        logs.where(F.col("pod") == pod).select("value").write.text(f"{path}/{pod}_prod_app-0a1b2c.log")
    return path


@query("log_index_counts", "A19 A20",
       "SELECT 'filebeat-' || strftime(ts, '%Y.%m.%d') AS \"index\", "
       "list_extract([" + ", ".join(f"'{p}'" for p in LOG_PODS) + f"], CAST(user_id % {len(LOG_PODS)} AS INTEGER) + 1) AS pod, "
       "'prod' AS namespace, 'app' AS container, count(*) AS n FROM events GROUP BY ALL")
def q_logs(spark, d):
    src = _write_logs(spark, d)
    out = shared_dir(spark, f"logs/index-{uuid.uuid4().hex[:8]}")
    logs = SJ.log_index(SJ.ingest_logs(spark, src))
    SJ.run_available(logs, "logs", SJ.idempotent_sink(out, ["index"]), out)
    res = spark.read.parquet(out)
    return res.groupBy("index", "pod", "namespace", "container").agg(F.count(F.lit(1)).alias("n"))
