"""Feature attribution as a Spark job.

Sampling Shapley values (Strumbelj & Kononenko 2014): for every row and each
of ``n_perm`` seeded feature orders (and their reverses, which lowers the
variance), the features are switched from the background value to the row's
value one at a time; a feature's contribution is the change of P(fraud) when it
is switched on, averaged over orders.  Per order the contributions sum to
f(x) - f(background) exactly.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import config as C
from ..functions.rand import md5_uniform
from .arrays import scorer


def _order(seed: int, n: int, perm: Column, id_col: str) -> Column:
    """A seeded permutation of 0..n-1 as an array (sort by md5 draws)."""
    keyed = F.array(*[F.struct(md5_uniform(seed, F.col(id_col), perm, i).alias("u"), F.lit(i).alias("i"))
                      for i in range(n)])
    return F.transform(F.array_sort(keyed), lambda s: s["i"])


def _orders(heads: list[str], n: int, n_perm: int) -> np.ndarray:
    """The orders of :func:`_order` for each ``seed|id`` and permutation, drawn inside a task:
    rows x permutations x features.  The first 13 hex digits of a digest are the first 52 bits."""
    tails = [f"|{perm}|{i}".encode() for perm in range(n_perm) for i in range(n)]
    digests = b"".join([hashlib.md5(h + t, usedforsecurity=False).digest() for h in map(str.encode, heads) for t in tails])
    draws = np.frombuffer(digests, ">u8")[::2].astype(np.uint64) >> np.uint64(12)
    return np.argsort(draws.reshape(len(heads), n_perm, n), axis=2, kind="stable")


def matrix_scorer(spark, model, cols):
    """P(class 1) of a matrix of rows with columns ``cols`` as a function for tasks,
    if the model is one that arrays can hold; else None."""
    if hasattr(model, "of_matrix"):
        return lambda x: model.of_matrix(x, cols)
    if not hasattr(model, "spec") or model.spec.name == "knn":
        return None
    fitted = model.extra["cols"] if model.spec.name == "svm" else model.model.stages[0].getInputCols()
    return scorer(spark, model) if list(fitted) == list(cols) else None


CHUNK = 256                     # rows whose masked copies are scored together


def _contributions(score, x, background, orders):
    """Sums over the orders and their reverses: contributions (rows x features),
    the score of the background and the score of the rows."""
    n, d = x.shape
    shap, every = np.zeros((n, d)), np.arange(n)[:, None]
    base, fx = np.zeros(n), np.zeros(n)
    for order in [o for i in range(orders.shape[1]) for o in (orders[:, i], orders[:, i, ::-1])]:
        place = np.argsort(order, axis=1)
        masked = np.where(place[None] < np.arange(d + 1)[:, None, None], x[None], background)       # step, row, feature
        p = score(masked.reshape(-1, d)).reshape(d + 1, n)
        shap[every, order] += (p[1:] - p[:-1]).T
        base, fx = base + p[0], fx + p[-1]
    return shap, base, fx


def shapley(df: DataFrame, model, cols=None, background: dict | None = None, n_perm: int = 4,
            seed: int = C.SEED, id_col: str = "id") -> DataFrame:
    """(id, feature, shap, base, fx).

    A model that arrays can hold scores a row's masked copies inside the Arrow
    batch that holds the row; they never become rows of a table.  Any other model
    scores them by ``model.predict``, which adds ``p``."""
    cols = list(cols or C.FEATURES)
    score = matrix_scorer(df.sparkSession, model, cols)
    if score is None:
        return _shapley_by_rows(df, model, cols, background, n_perm, seed, id_col)
    n = len(cols)
    bg = np.array([float((background or {}).get(c, 0.0)) for c in cols])
    # the work of a row is far beyond its bytes, by which partitions are joined otherwise
    spark = df.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    rows = df.select(id_col, F.array(*[F.col(c).cast("double") for c in cols]).alias("x")).repartition(parts).withColumn("head", F.concat_ws("|", F.lit(str(seed)), F.col(id_col).cast("string")))
    names = pa.array(cols)

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, CHUNK):
                part = b.slice(at, CHUNK)
                m = part.num_rows
                x = part.column("x").flatten().to_numpy(zero_copy_only=False).astype(float).reshape(m, n)
                order = _orders(part.column("head").to_pylist(), n, n_perm)
                shap, base, fx = (v / (2 * n_perm) for v in _contributions(score, x, bg, order))
                yield pa.RecordBatch.from_arrays([part.column(id_col).take(np.repeat(np.arange(m), n)), names.take(np.tile(np.arange(n), m)),
                                                  pa.array(shap.ravel()), pa.array(np.repeat(base, n)), pa.array(np.repeat(fx, n))], [id_col, "feature", "shap", "base", "fx"])

    told = T.StructType([df.schema[id_col], T.StructField("feature", T.StringType()), *[T.StructField(c, T.DoubleType()) for c in ("shap", "base", "fx")]])
    return rows.mapInArrow(run, told)


def _shapley_by_rows(df: DataFrame, model, cols, background, n_perm, seed, id_col) -> DataFrame:
    """All masked copies as rows of one table, scored by one ``predict``."""
    n = len(cols)
    bg = background or {}
    # dealt by id before the rows multiply: the sums below need no other shuffle
    x = df.select(id_col, *[F.col(c).cast("double").alias(c) for c in cols]).repartition(id_col)
    x = x.withColumn("perm", F.explode(F.sequence(F.lit(0), F.lit(2 * n_perm - 1))))
    base_order = _order(seed, n, F.col("perm") % n_perm, id_col)
    x = x.withColumn("order", F.when(F.col("perm") < n_perm, base_order).otherwise(F.reverse(base_order)))
    # place of each feature in the order, looked up for every step
    x = x.withColumn("place", F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.array_position("order", i)))
    x = x.withColumn("step", F.explode(F.sequence(F.lit(0), F.lit(n))))
    # the masked row of step s has the first s features of its order switched on:
    # its score counts for the feature switched on last and against the next one
    masked = x.select(id_col, "step", F.get("order", F.col("step") - 1).alias("on"), F.get("order", F.col("step")).alias("next"), *[
        F.when(F.get("place", F.lit(i)) <= F.col("step"), F.col(c))
         .otherwise(F.lit(float(bg.get(c, 0.0)))).alias(c)
        for i, c in enumerate(cols)])
    scored = model.predict(masked).select(id_col, "step", "on", "next", "p")
    p, none = F.col("p"), F.lit(None).cast("double")
    signed = scored.select(id_col, F.explode(F.array(
        F.struct(F.col("on").alias("i"), p.alias("d"), F.when(F.col("on").isNull(), p).alias("base"), none.alias("fx")),
        F.struct(F.col("next").alias("i"), (-p).alias("d"), none.alias("base"), F.when(F.col("next").isNull(), p).alias("fx")))).alias("e")).select(id_col, "e.*")
    sums = signed.groupBy(id_col, "i").agg(*[(F.sum(c) / (2 * n_perm)).alias(c) for c in ("d", "base", "fx")])
    row = Window.partitionBy(id_col)
    names = F.array(*[F.lit(c) for c in cols])
    return (sums.withColumns({"base": F.max("base").over(row), "fx": F.max("fx").over(row)}).where("i is not null")
            .select(id_col, F.get(names, F.col("i")).alias("feature"), F.col("d").alias("shap"), "base", "fx"))


def top_features(attr: DataFrame, k: int = 5, id_col: str = "id") -> DataFrame:
    """The k largest |shap| per row, rounded to 4, with the direction."""
    w = Window.partitionBy(id_col).orderBy(F.desc(F.abs("shap")), "feature")
    r = attr.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return r.select(id_col, "rank", "feature", F.round("shap", 4).alias("shap"),
                    F.when(F.col("shap") > 0, F.lit("raise risk")).otherwise(F.lit("lower risk")).alias("direction"))


def waterfall(attr: DataFrame, k: int = 10, id_col: str = "id") -> DataFrame:
    """K-1 largest bars plus one 'other' bar, with start/end from the base value."""
    w = Window.partitionBy(id_col).orderBy(F.desc(F.abs("shap")), "feature")
    r = attr.withColumn("rank", F.row_number().over(w))
    bars = r.withColumn("bar", F.when(F.col("rank") < k, F.col("rank")).otherwise(F.lit(k))) \
            .withColumn("label", F.when(F.col("rank") < k, F.col("feature")).otherwise(F.lit("other")))
    g = bars.groupBy(id_col, "bar").agg(F.first(F.when(F.col("bar") < k, F.col("label")), True).alias("label"),
                                        F.sum("shap").alias("value"), F.first("base").alias("base"))
    g = g.withColumn("label", F.coalesce("label", F.lit("other")))
    cw = Window.partitionBy(id_col).orderBy("bar").rowsBetween(Window.unboundedPreceding, 0)
    g = g.withColumn("end", F.col("base") + F.sum("value").over(cw))
    return g.select(id_col, "bar", "label", "value", (F.col("end") - F.col("value")).alias("start"), "end")


def attribution_text(attr: DataFrame, k: int = 5, id_col: str = "id") -> DataFrame:
    """J4: '  - V14: SHAP = +0.1234 (raise risk)' lines in rank order, one text per row."""
    t = top_features(attr, k, id_col)
    line = F.format_string("  - %s: SHAP = %+.4f (%s)", F.col("feature"), F.col("shap"), F.col("direction"))
    items = F.sort_array(F.collect_list(F.struct("rank", line.alias("line"))))
    return t.groupBy(id_col).agg(F.concat_ws("\n", F.transform(items, lambda s: s["line"])).alias("text"))


class LinearScore:
    """A fixed linear score p = sum(w_f * x_f) (exact Shapley: w_f * (x_f - bg_f));
    used to check the attribution operators against SQL."""

    def __init__(self, weights: dict[str, float]):
        self.weights = weights

    def of_matrix(self, x: np.ndarray, cols) -> np.ndarray:
        return x @ np.array([self.weights.get(c, 0.0) for c in cols])

    def predict(self, df: DataFrame) -> DataFrame:
        p = sum((F.col(c) * F.lit(w) for c, w in self.weights.items()), F.lit(0.0))
        return df.withColumn("p", p)


def rule_weights(cols=None) -> dict[str, float]:
    """Weights from a rule: alternating sign, growing with the position."""
    cols = list(cols or C.FEATURES)
    return {c: (1.0 if i % 2 == 0 else -1.0) * (i + 1) / len(cols) for i, c in enumerate(cols)}
