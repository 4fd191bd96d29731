"""Rules on streams against their batch forms: shuffled micro-batches, late
samples, restarts, silence, bounded state, retention."""

import random
import uuid

import pytest
from pyspark.sql import functions as F

from ledgerlens.session import shared_dir
from ledgerlens.sources import fixtures as fx
from ledgerlens.streaming import retention
from ledgerlens.streaming import rules as R
from ledgerlens.streaming import signals as L

SCHEMA = "sample_id long, ts timestamp, series string, counter double, gauge double, event_type string"
T0 = 1_700_000_000


def samples(n=240, series=3, seed=0, step=30):
    rnd = random.Random(seed)
    out = []
    for i in range(n):
        s = rnd.randrange(series)
        out.append((i, T0 + i * step + rnd.randrange(step), f"s{s}", float(rnd.randrange(5) * (i % 17)), float(rnd.choice([10, 90, 90, 90])), rnd.choice(["view", "click"])))
    return out


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA.replace("ts timestamp", "ts long")).withColumn("ts", F.timestamp_seconds("ts"))


class Source:
    """A folder that files are added to, one micro-batch each."""

    def __init__(self, spark):
        self.spark, self.root = spark, shared_dir(spark, f"tests/{uuid.uuid4().hex}")
        self.out = f"{self.root}/out"

    def add(self, rows):
        frame(self.spark, rows).coalesce(1).write.mode("append").parquet(f"{self.root}/in")

    def stream(self):
        return self.spark.readStream.schema(frame(self.spark, []).schema).option("maxFilesPerTrigger", 1).parquet(f"{self.root}/in")


def shuffled(rows, parts, reach, seed=1):
    """Rows in micro-batches, each up to ``reach`` places away from its order."""
    rnd = random.Random(seed)
    order = sorted(rows, key=lambda r: r[0] + rnd.random() * reach)
    size = -(-len(order) // parts)
    return [order[i:i + size] for i in range(0, len(order), size)]


def same(a, b):
    return sorted(map(tuple, a.collect()), key=repr) == sorted(map(tuple, b.select(*a.columns).collect()), key=repr)


W = 600
RULES = {
    "counter_rate": R.Rule(lambda d: L.counter_increase(d, W), ("series", "sample_id"), "ts", before_s=W),
    "cpu": R.Rule(lambda d: L.cpu_busy(L.counter_increase(d, W), W), ("series", "window_start"), "window_start", before_s=W, after_s=W),
    "memory": R.Rule(lambda d: L.window_ratio(d, F.avg(F.when(F.col("event_type") == "view", F.col("gauge"))), F.max("gauge"), W, complement=True),
                     ("series", "window_start"), "window_start", after_s=W),
}


@pytest.mark.parametrize("name", sorted(RULES))
def test_late_samples_correct_results(spark, name):
    rows, rule, src = samples(), RULES[name], Source(spark)
    for i, part in enumerate(shuffled(rows, 5, 60)):
        src.add(part)
        if i in (1, 4):                                  # a restart in between
            R.rule_stream(src.stream(), rule, 3600, src.out)
    want = rule.apply(frame(spark, rows))
    assert same(R.current_results(spark, src.out, rule).select(*want.columns).drop("rate"), want.drop("rate"))
    log = R.batch_log(spark, src.out).collect()
    assert sorted(r.batch for r in log) == [0, 1, 2, 3, 4] and sum(r.n_in for r in log) == len(rows) and not any(r.n_late for r in log)


def test_rows_behind_the_watermark_are_told(spark):
    rows, src = samples(100), Source(spark)
    late = [rows[3], rows[7]]
    first, second = [r for r in rows[:60] if r not in late], [*rows[60:], *late, (500, None, "s0", 1.0, 1.0, "view")]
    for part in (first, second):
        src.add(part)
    R.rule_stream(src.stream(), RULES["counter_rate"], 900, src.out)
    told = R.late_rows(spark, src.out, src.stream().schema).select("sample_id", "batch").collect()
    assert sorted(map(tuple, told)) == [(3, 1), (7, 1), (500, 1)]
    assert sorted((r.batch, r.n_in, r.n_late) for r in R.batch_log(spark, src.out).collect()) == [(0, 58, 0), (1, 43, 3)]
    want = L.counter_increase(frame(spark, [r for r in rows if r not in late]), W).select("sample_id", "increase")
    assert same(R.current_results(spark, src.out, RULES["counter_rate"]).select("sample_id", "increase"), want)


def test_latest_on_a_stream(spark):
    rows, src = samples(), Source(spark)
    for part in shuffled(rows, 4, 300):
        src.add(part)
    R.latest_stream(src.stream(), "gauge", 50.0, src.out)
    assert same(R.current_latest(spark, src.out), L.latest_below(frame(spark, rows), "gauge", 50.0))


def islands(spark, rows, for_s):
    return L.sustained(frame(spark, rows), F.col("gauge") > 50, for_s).select("series", "island_start", "island_end", "samples", "fired_at")


@pytest.mark.parametrize("for_s", [0, 90, 200])
def test_islands_on_a_stream(spark, for_s):
    """After each run, what was told equals the batch form over all that came; restarts go on from state."""
    rows, src, seen = samples(seed=4), Source(spark), []
    rows += [(1000 + i, T0 + 500 * i, "s1", 0.0, None, "view") for i in range(3)] + [(2000, rows[5][1], rows[5][2], 0.0, 10.0, "view")]
    for i, part in enumerate(shuffled(rows, 5, 40, seed=5)):
        src.add(part)
        seen += part
        if i in (0, 2, 4):
            R.sustained_stream(src.stream(), F.col("gauge") > 50, for_s, "10 hours", src.out)
            assert same(R.current_islands(spark, src.out), islands(spark, seen, for_s))
    assert spark.read.parquet(f"{src.out}/dropped").agg(F.sum("dropped")).first()[0] == 0


def test_islands_close_behind_the_watermark(spark):
    """Samples in order with a short watermark: islands become final, state stays small, late rows are counted."""
    rows, src = [r for r in samples(seed=6, series=2)], Source(spark)
    for i in range(0, 240, 40):
        src.add(rows[i:i + 40])
    src.add([(900, T0 + 5, "s0", 0.0, 10.0, "view")])                  # far too late
    R.sustained_stream(src.stream(), F.col("gauge") > 50, 60, "2 minutes", src.out)
    assert same(R.current_islands(spark, src.out), islands(spark, rows, 60))
    told = spark.read.parquet(f"{src.out}/islands")
    assert told.where("final").count() > 5 and told.where("final").groupBy("series", "island_start").count().where("count > 1").count() == 0
    counts = spark.read.parquet(f"{src.out}/dropped").collect()
    assert sum(r.dropped for r in counts) == 1


def test_a_silent_series_is_finished_by_its_timer(spark):
    """Series a says nothing more; the time of series b passes its samples."""
    src = Source(spark)
    src.add([(i, T0 + 60 * i, "a", 0.0, 90.0 if i < 5 else 10.0, "view") for i in range(6)])
    src.add([(10, T0 + 7200, "b", 0.0, 10.0, "view")])
    src.add([(11, T0 + 7260, "b", 0.0, 10.0, "view")])
    R.sustained_stream(src.stream(), F.col("gauge") > 50, 180, "10 minutes", src.out)
    final = spark.read.parquet(f"{src.out}/islands").where("final").collect()
    assert [(r.series, r.samples, (r.fired_at - r.island_start).total_seconds()) for r in final] == [("a", 5, 180.0)]


def test_islands_read_and_write_a_series_once(monkeypatch):
    """A micro-batch costs a series one read and one write of its state, however many samples wait."""
    calls = []

    class Value:
        now = None

        def get(self):
            calls.append("get")
            return self.now

        def update(self, v):
            calls.append("update")
            self.now = v

    class Handle:
        def getValueState(self, *_):
            return Value()

        def registerTimer(self, ms):
            pass

    class Times:
        def getCurrentWatermarkInMs(self):
            return 2

    p = R.Islands(1000)
    p.init(Handle())
    wait = [(5000, None, True), (3000, 7, True), (3000, None, False), (9000, 1, False)]
    first = list(p.advance(("s",), [(1000, 1, True), *wait], Times()))
    assert calls == ["get", "update"] and R.unpacked(R.packed(sorted(wait, key=str))) == sorted(wait, key=str)
    assert [s[0] for s in R.unpacked(p.state.now[0])] == [3000, 3000, 5000, 9000] and p.state.now[1] == [1000, 1000, 1, None]
    second = list(p.advance(("s",), [], Times()))
    assert len(calls) == 4 and first[0].version == 0 and second[0].version == 1


def test_a_large_delivery_is_written_by_many_tasks(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(fx, "DELIVERY_ROWS", 50)
    from conftest import SMALL
    one = fx.metrics_ts(spark, SMALL)
    stream = fx.sample_stream(spark, SMALL, str(tmp_path / "in"))
    n = fx.delivery_files(spark, str(tmp_path / "in"))
    assert n > 1
    batches = {}
    q = stream.writeStream.foreachBatch(lambda b, i: batches.setdefault(i, sorted(r.sample_id for r in b.select("sample_id").collect()))).option(
        "checkpointLocation", str(tmp_path / "ckpt")).trigger(availableNow=True).start()
    q.awaitTermination()
    want = {}
    for r in fx.arrivals(one, spark).select("slice", "sample_id").collect():
        want.setdefault(r.slice, []).append(r.sample_id)
    assert batches == {i: sorted(v) for i, v in want.items()}


def test_ratio_of_two_streams(spark):
    rows, src = samples(400), Source(spark)
    for part in shuffled(rows, 5, 10):
        src.add(part)
    s = src.stream()
    R.ratio_stream(s, src.stream().where("event_type = 'view'"), F.max("gauge"), F.avg("gauge"), f"{W} seconds", "10 minutes", src.out, complement=True)
    got = spark.read.parquet(src.out).drop("batch")
    view = max(r[1] for r in rows if r[5] == "view")
    closed = min(view, max(r[1] for r in rows)) - 600
    want = RULES["memory"].apply(frame(spark, rows)).where(F.unix_seconds("window_start") + W <= closed)
    assert want.count() > 20 and same(got, want)


def test_retention_drops_days(spark):
    src = Source(spark)
    rows = samples(200, step=3600)
    for i in range(0, 200, 50):
        src.add(rows[i:i + 50])
    R.rule_stream(src.stream(), RULES["counter_rate"], 3600, src.out)
    store, schema = f"{src.out}/samples", src.stream().schema
    before = retention.samples(spark, store, schema)
    n = before.count()
    days = sorted(r.day for r in before.select("day").distinct().collect())
    gone = retention.drop_days(spark, store, days=3)
    assert gone == days[:-4] and len(days) > 6
    after = retention.samples(spark, store, schema)
    assert sorted(r.day for r in after.select("day").distinct().collect()) == days[-4:]
    assert n == len(rows) and after.count() == before.where(F.col("day") >= days[-4]).count()
    assert retention.drop_days(spark, store, days=3) == [] and retention.horizon(spark, store) == days[-4]
    src.add([(999, rows[-1][1] + 60, "s0", 1.0, 1.0, "view")])
    R.rule_stream(src.stream(), RULES["counter_rate"], 3600, src.out)               # the stream goes on over the smaller store
    assert retention.samples(spark, store, schema).where("sample_id = 999").count() == 1


def test_readers_go_by_the_horizon(spark, monkeypatch):
    """A retention job that dies after its commit: rows are gone for readers, folders by the next run."""
    src = Source(spark)
    src.add(samples(200, step=3600))
    R.rule_stream(src.stream(), RULES["counter_rate"], 3600, src.out)
    store, schema = f"{src.out}/samples", src.stream().schema

    def dies(*_):
        raise OSError("killed")

    with monkeypatch.context() as m:
        m.setattr(retention, "delete", dies)
        with pytest.raises(OSError):
            retention.drop_days(spark, store, days=2)
    seen = retention.samples(spark, store, schema).count()
    assert retention.drop_days(spark, store, days=2) and retention.samples(spark, store, schema).count() == seen
