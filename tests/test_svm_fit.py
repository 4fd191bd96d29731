"""The SVM's fit: the objective of LinearSVC in few passes, and no row of kernel features kept."""

import os

import numpy as np
import pytest
from pyspark.ml.classification import LinearSVC
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from ledgerlens import config as C
from ledgerlens.operators import fitcheck, lockstep, models
from ledgerlens.session import ensure_checkpoint_dir, reliable

COLS = ["a", "b", "c"]


@pytest.fixture(scope="module")
def table(spark):
    """Three columns, a curved border between two unequal classes."""
    rng = np.random.default_rng(11)
    x = rng.normal(size=(3000, 3)) * [1.0, 2.0, 0.5]
    y = x[:, 0] ** 2 + 0.3 * x[:, 1] + 0.4 * rng.normal(size=3000) > 1.6
    return reliable(spark.createDataFrame([(*map(float, r), int(t)) for r, t in zip(x, y)], "a double, b double, c double, Class int").repartition(4))


def objective(train, fit, w, b):
    return fitcheck.svm_objective(models.Fitted(fit.spec, _Linear(w, b), fit.spark_params, 0.0, fit.extra), train)[0]


class _Linear:
    def __init__(self, w, b):
        self.coefficients, self.intercept = type("V", (), {"toArray": lambda _: np.asarray(w)})(), b


@pytest.mark.parametrize("params", [{"kernel": "poly", "degree": 2, "C": 0.5}, {"class_weight": None, "C": 20.0}])
def test_objective_is_no_worse_than_that_of_linear_svc(spark, table, params):
    fit = models.train_model(models.make_model("svm", params), table, feature_cols=COLS)
    local = table.toPandas()
    z, y = fit.extra["features"](local[COLS].to_numpy()), local["Class"].to_numpy()
    weight = np.where(y == 1, len(y) / (2 * y.sum()), len(y) / (2 * (1 - y).sum())) if fit.spec.balanced else np.ones(len(y))
    d = spark.createDataFrame([(r.tolist(), float(t), float(w)) for r, t, w in zip(z, y, weight)], "a array<double>, y double, w double").withColumn("v", array_to_vector("a"))
    svc = LinearSVC(featuresCol="v", labelCol="y", weightCol="w", regParam=fit.spark_params["regParam"], maxIter=60).fit(d)
    ours = objective(table, fit, fit.model.coefficients.toArray(), fit.model.intercept)
    assert ours <= objective(table, fit, svc.coefficients.toArray(), svc.intercept) * 1.01
    margin = z @ fit.model.coefficients.toArray() + fit.model.intercept
    told = fit.predict(table).toPandas()
    again = told[COLS].to_numpy()
    assert (told["prediction"].to_numpy() == (fit.extra["features"](again) @ fit.model.coefficients.toArray() + fit.model.intercept > 0)).all()
    assert ((margin > 0) == (y == 1)).mean() > 0.8 and told["p"].between(0, 1).all()


def test_fit_takes_few_jobs_and_keeps_no_features(spark, table):
    kept = ensure_checkpoint_dir(spark).removeprefix("file:")
    size = lambda: sum(os.path.getsize(os.path.join(at, f)) for at, _, fs in os.walk(kept) for f in fs)
    before = size()
    spark.sparkContext.setJobGroup("svm-fit", "svm fit")
    models.train_model("svm", table, feature_cols=COLS)
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("svm-fit"))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert jobs < 200 and size() - before < 3000 * models.KERNEL_FEATURES * 8 / 2


def test_rough_features_are_the_features(table):
    x = np.random.default_rng(2).normal(size=(500, 30)) * 40
    exact, rough = (models.kernel_matrix("rbf", 30, 0.5, 3, 64, 7, rough=r)(x) for r in (False, True))
    assert np.abs(exact - rough).max() < 1e-6


def test_bad_rows_are_an_error(spark, table):
    for bad in (table.withColumn("a", F.when(F.col("b") > 3, F.lit(float("nan"))).otherwise(F.col("a"))), table.withColumn("Class", F.lit(2))):
        with pytest.raises(ValueError):
            models.train_model("svm", bad, feature_cols=COLS)


def test_rows_without_a_class_are_left_out_of_a_weighted_fit(spark, table):
    more = table.unionByName(table.limit(50).withColumn("Class", F.lit(None).cast("int")))
    fits = [models.train_model("svm", t, feature_cols=COLS) for t in (table, more)]
    assert fits[0].spark_params["regParam"] == fits[1].spark_params["regParam"]


def test_moments_are_those_of_the_summarizer(spark, table):
    from pyspark.ml.stat import Summarizer
    rows = models.svm_rows(table, COLS, C.TARGET, True)
    _, w = models.svm_weights(rows, True)
    total, std = lockstep.feature_moments(rows, lambda x: x, w)
    weight = F.when(F.col("y") == 1, float(w[1])).otherwise(float(w[0]))
    want = rows.select(array_to_vector("x").alias("v"), weight.alias("w")).agg(Summarizer.std(F.col("v"), F.col("w")).alias("s"), F.sum("w").alias("t")).first()
    assert np.abs(std - want["s"].toArray()).max() < 1e-9 and total == pytest.approx(want["t"])
