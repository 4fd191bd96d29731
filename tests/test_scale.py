"""What holds on large keys, large counts, ties and one dominant value."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerlens import config as C
from ledgerlens.functions.quantile import exact_quantiles
from ledgerlens.operators import knn, metrics as M, models, synth, tuning
from ledgerlens.plans import jobs
from ledgerlens.session import cut_lineage, shared_dir
from ledgerlens.streaming import jobs as SJ, signals as L


def test_running_balance_with_large_keys_and_one_hot_account(spark):
    rng = np.random.default_rng(0)
    rows = [(1 if i % 3 else int(rng.integers(2, 9)), int(rng.integers(0, 2 ** 52)), f"2024-01-{1 + i % 5:02d}", float(rng.integers(-50, 50)), 100.0)
            for i in range(1500)]
    df = spark.createDataFrame(rows, "account long, seq long, tx_date string, amount_vnd double, start_balance double").withColumn("tx_date", F.to_date("tx_date"))
    got = {(r.account, r.seq): r.balance for r in synth.running_balance(df, n_buckets=16).collect()}
    want = {}
    for a in {r[0] for r in rows}:
        total = 100.0
        for r in sorted((r for r in rows if r[0] == a), key=lambda r: (r[2], r[1])):
            total += r[3]
            want[a, r[1]] = total
    assert got == want


def test_auc_of_huge_counts(spark):
    n = 6 * 10 ** 9
    g = spark.createDataFrame([(0.9, n, 0, n, 0, 0, 0), (0.1, 0, n, n, n, n, 0)], "p double, pos long, neg long, tp_cum long, fp_cum long, tp_above long, fp_above long")
    assert M.ranking_metrics(g).first()["auc_roc"] == pytest.approx(1.0)


@pytest.mark.parametrize("share", [0.0, 0.4, 0.95])
def test_quantiles_with_a_dominant_value(spark, share):
    rng = np.random.default_rng(1)
    x = rng.normal(size=4001)
    x[rng.random(4001) < share] = 0.25
    df = spark.createDataFrame([(float(v),) for v in x], "x double")
    r = exact_quantiles(df, ["x"], [0.25, 0.5, 0.9], accuracy=50).first()
    assert [r["q_0"], r["q_1"], r["q_2"]] == pytest.approx(np.quantile(x, [0.25, 0.5, 0.9]).tolist(), abs=1e-12)


def test_quantiles_of_few_columns_sort_no_whole_column(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "200")           # far more partitions than columns
    try:
        df = spark.range(20_000).select(F.col("id").cast("double").alias("x"), F.sqrt("id").alias("y"))
        q = exact_quantiles(df, ["x", "y"], [0.25, 0.5])
        got = {r["feature"]: (r["q_0"], r["q_1"]) for r in q.collect()}
        plan = q._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    for c in ("x", "y"):
        v = np.arange(20_000.0) if c == "x" else np.sqrt(np.arange(20_000.0))
        assert got[c] == pytest.approx(tuple(np.quantile(v, [0.25, 0.5])), rel=1e-12)
    # values of a column meet their brackets where they are, without a sort of the column
    assert "_lo0" in plan and not [j for j in plan.splitlines() if "SortMergeJoin" in j and "Inner" in j]


def test_counter_rate_with_equal_timestamps(spark):
    rows = [(i, "2024-01-01 00:00:%02d" % (i // 3), "s", float(i)) for i in range(60)]
    df = spark.createDataFrame(rows, "sample_id long, ts string, series string, counter double").withColumn("ts", F.to_timestamp("ts"))
    got = [sorted((r.sample_id, r.increase) for r in L.counter_increase(df.repartition(n), 5).collect()) for n in (1, 7)]
    assert got[0] == got[1]


@pytest.mark.parametrize("metric", ["euclidean", "manhattan"])
def test_cells_sifted_by_a_product_lose_none(metric):
    rng = np.random.default_rng(5)
    wide = np.array([1e5, 1.0, 1.0, 30.0])
    q, centres = rng.normal(size=(400, 4)) * wide, rng.normal(size=(60, 4)) * wide
    q[:60] = centres                                                # rows that are centres
    radius, reach = rng.uniform(0, 2e4, 60), rng.uniform(0, 2e4, 400)
    radius[::9], reach[::7] = -np.inf, np.inf                       # empty cells; rows without a bound
    d = knn.distances(q, centres, metric)
    held = radius > -np.inf
    for r in (reach, reach / 50):                                   # many cells in reach, and few
        assert (knn._within_reach(q, centres, radius, r, metric) == (d - radius <= r[:, None]))[:, held].all()
    cell, far = knn._own_centres(q, centres, metric)
    assert (far == d[np.arange(400), cell]).all() and (far[:60] == 0).all()
    q[3, 2] = np.nan
    bad = knn.distances(q, centres, metric)
    assert (knn._within_reach(q, centres, radius, reach, metric) == (bad - radius <= reach[:, None])).all()
    assert np.isnan(knn._own_centres(q, centres, metric)[1][3])


@pytest.mark.parametrize("metric", ["euclidean", "manhattan"])
@pytest.mark.parametrize("exclude_self", [False, True])
def test_knn_join_over_many_cells_and_blocks(spark, metric, exclude_self):
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.normal(size=(500, 6)), rng.normal(size=(300, 6)) * 0.01 + 2, np.repeat(rng.normal(size=(1, 6)), 100, 0)])
    df = spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(x)], "id long, a double, b double, c double, d double, e double, f double")
    got = {(r.q_id, r.rank): (r.b_id, r.dist) for r in knn.knn_join(df, df, 4, list("abcdef"), metric, exclude_self=exclude_self, block_rows=60, cell_rows=50).collect()}
    d = knn.distances(x, x, metric)
    if exclude_self:
        np.fill_diagonal(d, np.inf)
    for i in range(len(x)):
        best = np.lexsort((np.arange(len(x)), d[i]))[:4]
        assert [got[i, r + 1] for r in range(4)] == [(int(j), float(d[i, j])) for j in best]
    assert len(got) == 4 * len(x)


def test_approximate_knn_recall(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(900, 5)) + rng.integers(0, 4, (900, 1)) * 3
    df = spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(x)], "id long, a double, b double, c double, d double, e double")
    pairs = lambda approx: {(r.q_id, r.b_id) for r in knn.knn_join(df, df, 5, list("abcde"), approx=approx, cell_rows=30, probes=8).collect()}
    exact = pairs(False)
    assert len(pairs(True) & exact) >= 0.9 * len(exact)


def test_knn_cv_against_brute_force(spark):
    rng = np.random.default_rng(4)
    n = 120
    y = (rng.random(n) < 0.3).astype(int)
    x = rng.normal(size=(n, 30)) + y[:, None] * 0.6
    fold = np.arange(n) % 5
    rows = [(i, *map(float, x[i]), int(y[i]), int(fold[i])) for i in range(n)]
    df = spark.createDataFrame(rows, "id long, " + ", ".join(f"{c} double" for c in C.FEATURES) + ", Class int, fold int")
    trials = {0: {"n_neighbors": 3}, 1: {"n_neighbors": 7, "weights": "distance"}, 2: {"n_neighbors": 5, "metric": "manhattan"}}
    want = {}
    for t, p in trials.items():
        scores = []
        for f in range(5):
            tr, va = np.flatnonzero(fold != f), np.flatnonzero(fold == f)
            d = knn.distances(x[va], x[tr], p.get("metric", "euclidean"))
            near = np.argsort(d, axis=1, kind="stable")[:, :p["n_neighbors"]]
            w = 1 / np.take_along_axis(d, near, 1) if p.get("weights") == "distance" else np.ones(near.shape)
            pred = (w * y[tr][near]).sum(1) / w.sum(1) > 0.5
            tp, off = (pred & (y[va] == 1)).sum(), (pred != (y[va] == 1)).sum()
            scores.append(round(2 * tp / (2 * tp + off), 4) if tp else 0.0)
        want[t] = sum(scores) / 5
    got = tuning.knn_cv_f1(df, trials)
    assert got == pytest.approx(want, abs=1e-9)
    assert tuning.cv_f1(models.make_model("knn", {"n_neighbors": 3}), df) == pytest.approx(want[0], abs=1e-4)


def test_smote_needs_more_rows_than_neighbours(spark):
    df = spark.createDataFrame([(i, *[float(i)] * 30, int(i < 3)) for i in range(20)], "id long, " + ", ".join(f"{c} double" for c in C.FEATURES) + ", Class int")
    with pytest.raises(ValueError):
        knn.smote(df, k=5)


def test_stream_goes_on_after_a_restart(spark):
    import uuid
    root = shared_dir(spark, f"tests/{uuid.uuid4().hex}")
    add = lambda lo, hi: spark.range(lo, hi).write.mode("append").parquet(f"{root}/in")
    run = lambda: SJ.run_available(spark.readStream.schema("id long").parquet(f"{root}/in"), "restart", SJ.idempotent_sink(f"{root}/out"), f"{root}/out")
    add(0, 50)
    run()
    add(50, 80)
    run()
    run()
    assert sorted(r.id for r in spark.read.parquet(f"{root}/out").collect()) == list(range(80))


def test_cut_lineage_keeps_rows(spark):
    assert cut_lineage(spark.range(10), "t").count() == 10


def test_knn_join_searches_the_majority_class(spark):
    from conftest import SMALL
    from ledgerlens.plans.entry import registered_queries
    from ledgerlens.sources import fixtures as fx
    t = fx.tx(spark, SMALL)
    got = registered_queries()["knn_join"](spark, SMALL).join(t.select(F.col("id").alias("b_id"), "Class"), "b_id")
    assert got.count() == 5 * t.count()
    assert [r.Class for r in got.select("Class").distinct().collect()] == [0]


@pytest.mark.parametrize("metric", ["euclidean", "manhattan"])
def test_nearest_of_a_block(metric):
    """Ties, own ids, limits, cells that are not finite and empty sides, against all distances sorted."""
    rng = np.random.default_rng(3)
    for case in range(12):
        q, b = np.round(rng.normal(size=(40, 6)), case % 3), np.round(rng.normal(size=(90, 6)), case % 3)
        q[:, 0], b[:, 0] = q[:, 0] * 1e5 + 1e9, b[:, 0] * 1e5 + 1e9
        if case % 4 == 3:
            b[0, 2] = np.nan
        q_id, b_id = rng.permutation(120)[:40], rng.permutation(120)[:90]
        limit = np.full(40, np.inf) if case % 2 else rng.uniform(1e4, 9e4, 40)
        d = knn.distances(q, b, metric)
        told = knn._nearest(q_id, q, limit, b_id, b, 5, metric, True).to_pylist()
        want = [(int(q_id[i]), int(b_id[j]), d[i, j]) for i in range(40)
                for j in sorted((j for j in range(90) if b_id[j] != q_id[i] and d[i, j] <= limit[i]), key=lambda j: (d[i, j], b_id[j]))[:5]]
        assert [tuple(r.values()) for r in told] == want
    none, no_id = np.zeros((0, 0)), np.zeros(0, np.int64)
    assert knn._nearest(no_id, none, np.zeros(0), b_id, b, 5, metric, False).num_rows == 0
    assert knn._nearest(q_id, q, limit, no_id, none, 5, metric, False).num_rows == 0


def test_knn_where_most_cells_have_no_query(spark):
    """Queries in one corner of the base rows."""
    base = spark.range(3000).select("id", (F.col("id") % 1500).cast("double").alias("a"), (F.col("id") % 7).cast("double").alias("b"))
    query = spark.range(5).select("id", (F.col("id") + 0.25).alias("a"), F.lit(0.5).alias("b"))
    told = knn.knn_join(query, base, 3, ["a", "b"]).collect()
    x = np.array([[i % 1500, i % 7] for i in range(3000)], float)
    for i in range(5):
        d = np.sqrt(((x - [i + 0.25, 0.5]) ** 2).sum(1))
        assert sorted((r.rank, r.b_id) for r in told if r.q_id == i) == [(n + 1, int(j)) for n, j in enumerate(np.lexsort((np.arange(3000), d))[:3])]


def test_training_rows_lie_on_all_cores(spark):
    """A small table isn't packed into one partition that one task would fit models on."""
    rows = spark.range(400).select("id", *[F.col("id").cast("double").alias(c) for c in C.FEATURES], (F.col("id") % 4 == 0).cast("int").alias("Class"))
    train, test, _ = jobs.prepared(spark, rows.repartition(2))
    assert train.rdd.getNumPartitions() >= 2 * spark.sparkContext.defaultParallelism
    assert train.count() + test.count() == 400
