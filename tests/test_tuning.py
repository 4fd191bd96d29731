"""Tuning with shared work against fits one by one, and models as arrays."""

import json

import numpy as np
import pytest
from pyspark.ml.classification import LinearSVC
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from ledgerlens import config as C
from ledgerlens.operators import arrays, explain, lockstep, models, tuning
from ledgerlens.session import reliable


@pytest.fixture(scope="module")
def table(spark):
    """A planted signal: 30 features, two of which tell the class in part."""
    rng = np.random.default_rng(3)
    n = 420
    x = rng.normal(size=(n, 30)) * rng.uniform(0.3, 3, 30)
    y = (x[:, 3] - 0.6 * x[:, 7] * x[:, 7] + rng.normal(size=n) * 0.8 > 0.2).astype(int)
    rows = [(i, *map(float, r), int(c), i % 5) for i, (r, c) in enumerate(zip(x, y))]
    schema = "id long, " + ", ".join(f"{c} double" for c in C.FEATURES) + ", Class int, fold int"
    return reliable(spark.createDataFrame(rows, schema).repartition(3))


LR = {0: {"C": 0.05, "l1_ratio": 0.7, "class_weight": "balanced"}, 1: {"C": 30.0, "l1_ratio": 0.0, "class_weight": None}, 2: {"C": 1.0, "l1_ratio": 1.0, "class_weight": None}}


def test_logistic_grid_is_the_optimum(spark, table):
    """Coefficients equal those of Spark's own solver, run to the end."""
    rows = lockstep.fold_rows(table, C.FEATURES, C.TARGET)
    grid = [lockstep.Model(f, p["class_weight"] == "balanced", p["C"], p["l1_ratio"]) for p, f in zip(LR.values(), (0, 3, -1))]
    beta = lockstep.logistic_grid(rows, grid, 5)
    for m, b in zip(grid, beta):
        train = table.where(F.col("fold") != m.fold)
        spec = models.make_model("logistic_regression", {"C": m.C, "l1_ratio": m.l1_ratio, "class_weight": "balanced" if m.balanced else None, "max_iter": 1000})
        fit = models.train_model(spec, train).model.stages[-1]
        assert np.abs(b[:-1] - fit.coefficients.toArray()).max() < 5e-3 and abs(b[-1] - fit.intercept) < 5e-3


def test_logistic_trials_equal_fits_one_by_one(table):
    got = tuning.lr_cv_f1(table, LR)
    assert got[0] == pytest.approx(tuning.cv_f1(models.make_model("logistic_regression", LR[0]), table), abs=0.004)


def hinge(x, y, w, b, l2, weight):
    s = 2 * y - 1
    return float((weight * np.maximum(0, 1 - s * (x @ w + b))).sum() / weight.sum() + l2 * (w @ w) / 2)


def test_svm_grid_is_no_worse_than_linear_svc(spark, table):
    """The hinge objective that Spark's solver minimises, at both solutions."""
    rows = lockstep.fold_rows(table, C.FEATURES, C.TARGET)
    local = table.toPandas()
    x, y = local[C.FEATURES].to_numpy(), local["Class"].to_numpy()
    dev = x.std(0)
    for balanced, c in ((True, 1.0),):
        b = lockstep.svm_grid(rows, [lockstep.Model(-1, balanced, c)], [lambda z: z], 5)[0]
        weight = np.where(y == 1, len(y) / (2 * y.sum()), len(y) / (2 * (1 - y).sum())) if balanced else np.ones(len(y))
        d = spark.createDataFrame([(r.tolist(), float(t), float(w)) for r, t, w in zip(x, y, weight)], "a array<double>, y double, w double").withColumn("v", array_to_vector("a"))
        svc = LinearSVC(featuresCol="v", labelCol="y", weightCol="w", regParam=1 / (c * len(y)), maxIter=100).fit(d)
        at = [hinge(x / dev, y, w * dev, t, 1 / (c * len(y)), weight) for w, t in ((b[:-1], b[-1]), (svc.coefficients.toArray(), svc.intercept))]
        assert at[0] < at[1] * 1.03 + 1e-3 and at[0] < hinge(x, y, np.zeros(30), 0.0, 0, weight)


def test_svm_trials_find_the_signal(table):
    trials = {0: {"kernel": "rbf", "gamma": "scale", "C": 2.0}, 1: {"kernel": "poly", "degree": 2, "C": 5.0, "class_weight": None}, 2: {"kernel": "rbf", "gamma": "auto", "C": 10.0}}
    got = tuning.svm_cv_f1(table, trials)
    assert all(0.3 < v < 1 for v in got.values())


def test_forest_arrays_score_as_the_model(spark, table):
    fit = models.train_model(models.make_model("random_forest", {"n_estimators": 12, "max_depth": 9}), table)
    forest = arrays.forest_arrays(spark, fit.model.stages[-1])
    local = fit.predict(table).toPandas()
    assert np.abs(forest.p(local[C.FEATURES].to_numpy()) - local["p"].to_numpy()).max() < 1e-9


def test_cut_forests_are_what_their_limits_say(spark, table):
    """Each trial by a slow walk down every tree."""
    fit = models.train_model(models.make_model("random_forest", {"n_estimators": 8, "max_depth": 12}), table)
    f = arrays.forest_arrays(spark, fit.model.stages[-1])
    x = table.select(*C.FEATURES).toPandas().to_numpy()[:60]
    wanted = [(2, 3, 2), (8, 12, 2), (5, 30, 40), (8, 1, 300), (8, 6, 10)]
    got = tuning.forest_margins(f, x, wanted)
    for j, (n, depth, least) in enumerate(wanted):
        for i, row in enumerate(x):
            total = 0.0
            for t in range(n):
                at = f.roots[t]
                for _ in range(depth):
                    if f.left[at] == at or f.rows[at] < least:
                        break
                    at = f.left[at] if row[f.feature[at]] <= f.threshold[at] else f.right[at]
                total += f.share[at]
            assert got[i, j] == pytest.approx(total / n - 0.5, abs=1e-12)


def test_forest_trials_find_the_signal(table):
    trials = {0: {"n_estimators": 20, "max_depth": 4, "min_samples_split": 2}, 1: {"n_estimators": 40, "max_depth": 10, "min_samples_split": 6, "class_weight": "balanced_subsample"}}
    got = tuning.rf_cv_f1(table, trials)
    want = tuning.cv_f1(models.make_model("random_forest", trials[1]), table)
    assert got[1] == pytest.approx(want, abs=0.08) and min(got.values()) > 0.5


@pytest.mark.parametrize("name", ["random_forest", "logistic_regression", "svm"])
def test_attribution_in_batches_equals_that_by_rows(table, name):
    f = models.train_model(models.make_model(name, {"n_estimators": 10} if name == "random_forest" else None), table)
    some = reliable(table.where("id < 25"))
    a = explain.shapley(some, f, background={"V3": 0.5}).toPandas().sort_values(["id", "feature"])
    b = explain._shapley_by_rows(some, f, C.FEATURES, {"V3": 0.5}, 4, C.SEED, "id").toPandas().sort_values(["id", "feature"])
    assert list(a["feature"]) == list(b["feature"]) and len(a) == 25 * 30
    for c in ("shap", "base", "fx"):
        assert np.abs(a[c].to_numpy() - b[c].to_numpy()).max() < 1e-9


def test_orders_drawn_in_tasks_are_the_md5_draws(spark):
    for kind, ids in (("long", [0, 7, -3, 2 ** 40, None]), ("string", ["a", "", "é|1", None])):
        rows = spark.createDataFrame([(v,) for v in ids], f"id {kind}")
        got = rows.select(F.concat_ws("|", F.lit("42"), F.col("id").cast("string")).alias("head"),
                          F.array(*[explain._order(42, 30, F.lit(p), "id") for p in range(3)]).alias("orders")).collect()
        assert (explain._orders([r["head"] for r in got], 30, 3) == np.array([r["orders"] for r in got])).all()


def test_sums_of_many_tasks_are_added_in_groups(spark, monkeypatch):
    monkeypatch.setattr(lockstep, "FAN_IN", 3)
    rows = spark.range(200).selectExpr("id % 5 AS fold", "CAST(id % 2 AS DOUBLE) AS y", "array(CAST(id AS DOUBLE)) AS x").repartition(20)
    got = lockstep.summed(rows, lambda fold, y, x: np.array([len(x), x.sum(), y.sum()]), 3)
    assert got.tolist() == [200, 19900, 100]


def test_tuned_record_is_used(spark, table, monkeypatch):
    from ledgerlens.plans import jobs
    from ledgerlens.session import shared_dir
    from ledgerlens.sources import io
    out = shared_dir(spark, f"tests/tuned-{np.random.randint(1 << 30)}")
    io.write_best_params(spark.createDataFrame([("logistic_regression", 0.5, io.encode_params(LR[0]))], "model string, best_f1 double, params map<string,string>"), out)
    assert jobs.tuned_params(spark, out) == {"logistic_regression": LR[0]}
    used = {}
    monkeypatch.setattr(jobs, "run_models", lambda train, test, names, label, params=None, keep=(): _stop(used, params))
    with pytest.raises(StopIteration):
        jobs.train_job(spark, table.drop("fold"), "none", ["logistic_regression"], out_dir=out)
    assert used == {"logistic_regression": json.loads(json.dumps(LR[0]))}


def _stop(used, params):
    used.update(params)
    raise StopIteration
