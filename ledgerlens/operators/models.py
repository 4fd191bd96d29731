"""Classifiers on Spark ML.

Every model is a ``pyspark.ml`` model trained by Spark across the cluster;
no rows are fitted on the driver.  Parameters use the original pipeline's
names and are translated to Spark's knobs (see ``translate``):

* random forest    -> ``RandomForestClassifier`` (weighted when balanced)
* logistic regr.   -> ``LogisticRegression`` with the same objective scale:
                      regParam = 1 / (C * sum of weights)
* kNN              -> the exact distributed k-nearest join of ``knn.py``
* SVM              -> the objective of ``LinearSVC`` over an explicit kernel
                      feature map (random Fourier features for rbf, random
                      Maclaurin features for poly), minimised by
                      ``lockstep.svm_fit`` and kept as a ``LinearSVCModel``,
                      then Platt scaling for P(fraud)

Training rows carry a ``weight`` column from ``prep.balanced_weights``.
"""

from __future__ import annotations

import json
import math
import time
from dataclasses import dataclass, field
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LinearSVC, LinearSVCModel, LogisticRegression, RandomForestClassifier
from pyspark.ml.common import _py2java
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import config as C
from ..session import spread
from . import lockstep
from .prep import balanced_weights

# ---- fixed values: default hyper-parameters of the original pipeline ---------
DEFAULTS: dict[str, dict[str, Any]] = {
    "random_forest": {"n_estimators": 100, "max_depth": None, "min_samples_split": 2,
                      "class_weight": "balanced", "random_state": 42},
    "logistic_regression": {"C": 1.0, "l1_ratio": 0.0, "max_iter": 1000,
                            "class_weight": "balanced", "random_state": 42},
    "knn": {"n_neighbors": 5, "weights": "uniform", "metric": "minkowski"},
    "svm": {"C": 1.0, "kernel": "rbf", "gamma": "scale", "degree": 3,
            "class_weight": "balanced", "probability": True, "random_state": 42},
}
SPARK_MAX_DEPTH = 30
KERNEL_FEATURES = 256


@dataclass
class ModelSpec:
    """A named model with merged parameters (defaults <- overrides)."""
    name: str
    params: dict[str, Any] = field(default_factory=dict)

    @property
    def balanced(self) -> bool:
        return self.params.get("class_weight") in ("balanced", "balanced_subsample")


def make_model(name: str, params: dict | None = None) -> ModelSpec:
    """A named family with its defaults, changed by ``params``; a name
    outside the table of defaults is an error.  An explicit ``class_weight: None`` switches weighting off (T19)."""
    table = DEFAULTS.get(name)
    if table is None:
        raise ValueError(f"no model family {name!r}; there are {', '.join(DEFAULTS)}")
    merged = dict(table)
    merged.update(params or {})
    return ModelSpec(name, merged)


def translate(spec: ModelSpec, n_features: int = len(C.FEATURES)) -> dict[str, Any]:
    """The Spark parameters a spec maps to (recorded with every run)."""
    p = spec.params
    if spec.name == "random_forest":
        depth = p.get("max_depth")
        return {"numTrees": int(p["n_estimators"]),
                "maxDepth": SPARK_MAX_DEPTH if depth is None else min(int(depth), SPARK_MAX_DEPTH),
                "minInstancesPerNode": max(1, int(p["min_samples_split"]) // 2),
                "seed": int(p.get("random_state") or C.SEED), "weighted": spec.balanced}
    if spec.name == "logistic_regression":
        return {"C": float(p["C"]), "elasticNetParam": float(p.get("l1_ratio") or 0.0),
                "maxIter": int(p.get("max_iter", 1000)), "weighted": spec.balanced}
    if spec.name == "knn":
        metric = p.get("metric", "minkowski")
        return {"k": int(p["n_neighbors"]), "weights": p.get("weights", "uniform"),
                "metric": "euclidean" if metric in ("minkowski", "euclidean") else metric}
    if spec.name == "svm":
        return {"C": float(p["C"]), "kernel": p.get("kernel", "rbf"), "gamma": p.get("gamma", "scale"),
                "degree": int(p.get("degree", 3)), "n_components": KERNEL_FEATURES,
                "seed": int(p.get("random_state") or C.SEED), "weighted": spec.balanced}
    raise ValueError(spec.name)


def assembler(cols=None, out: str = "features") -> VectorAssembler:
    return VectorAssembler(inputCols=list(cols or C.FEATURES), outputCol=out)


# ---- kernel feature maps (D5) --------------------------------------------------

def kernel_matrix(kernel: str, n_in: int, gamma: float, degree: int, n_components: int, seed: int, rough: bool = False):
    """The fixed random map of a kernel, from a matrix of rows to one of features.

    The projection (n_components x n_in doubles) is drawn from ``seed`` and
    shipped with the function.  ``rough``: cosines to 7 digits, in a fifth of the
    time, for fits that make the features many times."""
    rng = np.random.default_rng(seed)
    if kernel == "rbf":
        W = rng.normal(0.0, math.sqrt(2.0 * gamma), size=(n_in, n_components))
        b = rng.uniform(0.0, 2.0 * math.pi, size=n_components)
        scale = math.sqrt(2.0 / n_components)
        if not rough:
            return lambda X: scale * np.cos(X @ W + b)

        def near(X):
            turns = (X @ W + b) / (2.0 * math.pi)
            turns -= np.rint(turns)
            return scale * np.cos((2.0 * math.pi * turns).astype(np.float32)).astype(float)
        return near
    if kernel != "poly":
        raise ValueError(f"unsupported kernel {kernel!r}")
    # random Maclaurin features of (gamma <x, y>)^degree: product of `degree`
    # Rademacher projections (Kar & Karnick 2012)
    Ws = [rng.choice([-1.0, 1.0], size=(n_in, n_components)) for _ in range(degree)]
    scale = math.sqrt(gamma ** degree / n_components)

    def fmap(X):
        out = np.ones((X.shape[0], n_components))
        for w in Ws:
            out *= X @ w
        return scale * out
    return fmap


def kernel_map_udf(fmap):
    """A feature map as a function of array<double> columns: one matrix product for an Arrow batch."""
    @F.arrow_udf("array<double>")
    def mapped(xs: pa.Array) -> pa.Array:
        z = fmap(lockstep.matrix(xs)) if len(xs) else np.zeros((0, 1))
        return pa.ListArray.from_arrays(pa.array(np.arange(len(z) + 1, dtype=np.int32) * z.shape[1]), pa.array(z.ravel()))
    return mapped


def margin_udf(fmap, w: np.ndarray, b: float):
    """The margin of an array<double> column under a feature map: one matrix product for an Arrow batch."""
    @F.arrow_udf("double")
    def margin(xs: pa.Array) -> pa.Array:
        return pa.array(fmap(lockstep.matrix(xs)) @ w + b if len(xs) else np.zeros(0))
    return margin


def kernel_gamma(value, n_in: int, variance: float) -> float:
    """The kernel width that 'auto', 'scale' or a number stands for."""
    if value == "auto":
        return 1.0 / n_in
    if value == "scale":
        return 1.0 / (n_in * variance) if variance > 0 else 1.0
    return float(value)


def feature_variance(df: DataFrame, cols) -> float:
    """Variance of all feature values pooled (the 'scale' gamma uses it)."""
    cols = list(cols)
    row = df.agg(*[F.sum(F.col(c)).alias(f"s{i}") for i, c in enumerate(cols)],
                 *[F.sum(F.col(c) * F.col(c)).alias(f"q{i}") for i, c in enumerate(cols)],
                 F.count(F.lit(1)).alias("n")).first()
    n = row["n"] * len(cols)
    if n == 0:
        return 0.0
    s = sum(row[f"s{i}"] or 0.0 for i in range(len(cols)))
    q = sum(row[f"q{i}"] or 0.0 for i in range(len(cols)))
    return max(q / n - (s / n) ** 2, 0.0)


# ---- fitted model wrapper -------------------------------------------------------

@dataclass
class Fitted:
    """A trained model: ``predict`` adds prediction and p (P(fraud))."""
    spec: ModelSpec
    model: Any
    spark_params: dict
    seconds: float
    extra: dict = field(default_factory=dict)

    def predict(self, df: DataFrame, label_col: str = "prediction", p_col: str = "p") -> DataFrame:
        """Label and P(class 1) for any of the four models."""
        if self.spec.name == "knn":
            return self.model.transform(df, label_col, p_col)
        if self.spec.name == "svm":
            return _svm_predict(self, df, label_col, p_col)
        out = self.model.transform(df)
        return (out.withColumn(p_col, vector_to_array(F.col("probability"))[1])
                   .withColumn(label_col, F.col("_pred").cast("int"))
                   .drop("features", "rawPrediction", "probability", "_pred"))


def _weighted(df: DataFrame, spec: ModelSpec, label: str):
    if spec.balanced:
        return balanced_weights(df, label, "weight"), "weight"
    return df, None


def train_model(spec: ModelSpec | str, train: DataFrame, label: str = C.TARGET,
                feature_cols=None) -> Fitted:
    """Fit one model on the (already resampled) training rows."""
    spec = make_model(spec) if isinstance(spec, str) else spec
    cols = list(feature_cols or C.FEATURES)
    sp = translate(spec, len(cols))
    t0 = time.time()
    if spec.name == "knn":
        from .knn import KNNClassifier
        model = KNNClassifier(k=sp["k"], weights=sp["weights"], metric=sp["metric"],
                              feature_cols=cols, label=label).fit(train)
        return Fitted(spec, model, sp, time.time() - t0)
    if spec.name == "svm":
        return _fit_svm(spec, sp, train, cols, label, t0)
    d, wcol = _weighted(train, spec, label)
    if spec.name == "random_forest":
        est = RandomForestClassifier(featuresCol="features", labelCol=label, predictionCol="_pred",
                                     numTrees=sp["numTrees"], maxDepth=sp["maxDepth"],
                                     minInstancesPerNode=sp["minInstancesPerNode"], seed=sp["seed"], cacheNodeIds=True,
                                     **({"weightCol": wcol} if wcol else {}))
    elif spec.name == "logistic_regression":
        wsum = d.agg(F.sum(F.col(wcol)) if wcol else F.count(F.lit(1))).first()[0] or 1.0
        est = LogisticRegression(featuresCol="features", labelCol=label, predictionCol="_pred",
                                 regParam=1.0 / (sp["C"] * float(wsum)), elasticNetParam=sp["elasticNetParam"],
                                 maxIter=sp["maxIter"], standardization=False,
                                 **({"weightCol": wcol} if wcol else {}))
        sp["regParam"] = 1.0 / (sp["C"] * float(wsum))
    else:
        raise ValueError(spec.name)
    model = Pipeline(stages=[assembler(cols), est]).fit(d.withColumn(label, F.col(label).cast("double")))
    return Fitted(spec, model, sp, time.time() - t0)


def svm_rows(train: DataFrame, cols, label: str, balanced: bool) -> DataFrame:
    """(fold 0, y, x) of training rows; weighted rows need a class."""
    some = train.select(F.lit(0).alias("fold"), F.col(label), *cols)
    return lockstep.fold_rows(some.where(F.col(label).isNotNull()) if balanced else some, cols, label)


def svm_weights(rows: DataFrame, balanced: bool) -> tuple[int, np.ndarray]:
    """Number of rows, and weight of class 0 and 1; other classes are an error."""
    odd = rows.where("y IS NULL OR y NOT IN (0, 1)").select("y").first()
    if odd:
        raise ValueError(f"an SVM takes the classes 0 and 1, not {odd['y']}")
    counts = lockstep.class_counts(rows, 1)
    return int(counts.sum()), lockstep.class_weights([lockstep.Model(-1, balanced, 1.0)], counts)[:, 0]


def _fit_svm(spec, sp, train, cols, label, t0) -> Fitted:
    n_in = len(cols)
    rows = spread(svm_rows(train, cols, label, spec.balanced))
    n, weights = svm_weights(rows, spec.balanced)
    variance = feature_variance(rows.select(*[F.col("x")[i].alias(f"x{i}") for i in range(n_in)]), [f"x{i}" for i in range(n_in)]) if sp["gamma"] == "scale" else 0.0
    sp["gamma_value"] = kernel_gamma(sp["gamma"], n_in, variance)
    sp["regParam"] = 1.0 / (sp["C"] * max(n, 1))
    kernel = (sp["kernel"], n_in, sp["gamma_value"], sp["degree"], sp["n_components"], sp["seed"])
    w, b = lockstep.svm_fit(rows, kernel_matrix(*kernel, rough=True), weights, sp["regParam"])
    spark, fmap = train.sparkSession, kernel_matrix(*kernel)
    java = spark._jvm.org.apache.spark.ml.classification.LinearSVCModel(LinearSVC().uid, _py2java(spark.sparkContext, Vectors.dense(w)), b)
    svm = LinearSVCModel(java).setFeaturesCol("zfeat").setPredictionCol("_pred").setRawPredictionCol("_raw")
    # Platt scaling: one-feature logistic regression on the margin
    platt_in = assembler(["_m"], "_mf").transform(rows.select("y", margin_udf(fmap, w, b)("x").alias("_m")))
    platt = LogisticRegression(featuresCol="_mf", labelCol="y", predictionCol="_pp",
                               rawPredictionCol="_pr", probabilityCol="_pprob", regParam=0.0).fit(platt_in)
    return Fitted(spec, svm, sp, time.time() - t0, {"fmap": kernel_map_udf(fmap), "features": fmap, "platt": platt, "cols": cols})


def _svm_predict(f: Fitted, df: DataFrame, label_col: str, p_col: str) -> DataFrame:
    margin = margin_udf(f.extra["features"], f.model.coefficients.toArray(), float(f.model.intercept))
    platt = f.extra["platt"]
    out = df.withColumn("_m", margin(F.array(*[F.col(c).cast("double") for c in f.extra["cols"]])))
    told = F.col("_m") * float(platt.coefficients[0]) + float(platt.intercept)
    return (out.withColumn(p_col, 1.0 / (1.0 + F.exp(-told)))
               .withColumn(label_col, ((F.col("_m") > 0) & ~F.isnan("_m")).cast("int"))
               .drop("_m"))


def feature_importance(f: Fitted, names=None) -> DataFrame:
    """(feature, importance) descending; models without importances give
    an empty table."""
    from pyspark.sql import SparkSession
    spark = SparkSession.getActiveSession()
    names = list(names or C.FEATURES)
    rows = []
    if f.spec.name == "random_forest":
        imp = f.model.stages[-1].featureImportances.toArray()
        rows = [(n, float(v)) for n, v in zip(names, imp)]
    df = spark.createDataFrame(rows, "feature string, importance double")
    return df.orderBy(F.desc("importance"), "feature")


def top_importance(imp: DataFrame, n: int = 20) -> DataFrame:
    """The n most important features (a top-k report)."""
    return imp.orderBy(F.desc("importance"), "feature").limit(n)


def save_model(f: Fitted, path: str) -> None:
    """Spark ML persistence (kNN keeps its training rows as parquet), and
    the parameters it was fitted with as JSON."""
    from pyspark.sql import SparkSession
    fitted_with = json.dumps({"params": f.spec.params, "spark_params": f.spark_params, "cols": f.extra.get("cols", C.FEATURES)})
    SparkSession.getActiveSession().createDataFrame([(fitted_with,)], "value string").coalesce(1) \
        .write.mode("overwrite").text(f"{path}_fitted_with")
    if f.spec.name == "knn":
        f.model.save(path)
    elif f.spec.name == "svm":
        f.model.write().overwrite().save(f"{path}/svm")
        f.extra["platt"].write().overwrite().save(f"{path}/platt")
    else:
        f.model.write().overwrite().save(path)


def load_model(spec: ModelSpec, path: str, spark_params: dict | None = None) -> Fitted:
    """The inverse of :func:`save_model`; parameters come from the saved
    record, so a kernel map is rebuilt as it was fitted."""
    from pyspark.sql import SparkSession
    saved = json.loads(SparkSession.getActiveSession().read.text(f"{path}_fitted_with").first()[0])
    spec, spark_params = ModelSpec(spec.name, saved["params"]), spark_params or saved["spark_params"]
    if spec.name == "knn":
        from .knn import KNNModel
        return Fitted(spec, KNNModel.load(path), spark_params or translate(spec), 0.0)
    if spec.name == "svm":
        from pyspark.ml.classification import LogisticRegressionModel
        sp = spark_params or translate(spec)
        svm = LinearSVCModel.load(f"{path}/svm")
        platt = LogisticRegressionModel.load(f"{path}/platt")
        cols = saved["cols"]
        fmap = kernel_matrix(sp["kernel"], len(cols), sp["gamma_value"], sp["degree"], sp["n_components"], sp["seed"])
        return Fitted(spec, svm, sp, 0.0, {"fmap": kernel_map_udf(fmap), "features": fmap, "platt": platt, "cols": cols})
    return Fitted(spec, PipelineModel.load(path), spark_params or translate(spec), 0.0)
