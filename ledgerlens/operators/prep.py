"""Scaling, stratified splitting and class rebalancing.

Every random choice is an md5 draw of (seed, row id), so a split is a pure
function of the data and the seed and can be reproduced in SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import config as C
from ..functions.dist import first_k_mask, uniform_rank
from ..functions.quantile import exact_quantiles
from ..functions.rand import md5_uniform


# ---- C1 / C2 robust scaling ------------------------------------------------

def fit_robust_scaler(df: DataFrame, cols=None, exact: bool = True) -> DataFrame:
    """(column, center, scale): median and q75 - q25 (0 -> 1)."""
    cols = cols or C.SCALE_COLS
    if exact:
        q = exact_quantiles(df, cols, [0.25, 0.5, 0.75])
    else:
        long = df.select(*cols).unpivot([], cols, "feature", "value")
        q = long.groupBy("feature").agg(F.percentile_approx("value", [0.25, 0.5, 0.75], 10000).alias("a")) \
                .select("feature", F.col("a")[0].alias("q_0"), F.col("a")[1].alias("q_1"), F.col("a")[2].alias("q_2"))
    iqr = F.col("q_2") - F.col("q_0")
    return q.select("feature", F.col("q_1").alias("center"),
                    F.when(iqr == 0, F.lit(1.0)).otherwise(iqr).alias("scale"))


def apply_robust_scaler(df: DataFrame, params: DataFrame, cols=None) -> DataFrame:
    """(x - center) / scale on the scaled columns; params enter as scalar subqueries."""
    cols = cols or C.SCALE_COLS
    out = {}
    for c in cols:
        p = params.where(F.col("feature") == c)
        out[c] = (F.col(c) - p.select("center").scalar()) / p.select("scale").scalar()
    return df.withColumns(out)


# ---- C3 / C4 stratified split ----------------------------------------------

def approximate_mode(counts: DataFrame, n_draws_col: str, out: str, by: str = C.TARGET,
                     n_col: str = "n") -> DataFrame:
    """Split ``n_draws`` over classes proportionally: floors plus the largest
    remainders (ties to the smaller class label).  ``counts`` is one row per
    class, so the window below runs over a handful of rows."""
    total = F.sum(n_col).over(Window.partitionBy())
    cont = F.col(n_col).cast("double") * F.col(n_draws_col) / total
    d = counts.withColumn("_cont", cont).withColumn("_floor", F.floor("_cont"))
    d = d.withColumn("_need", F.col(n_draws_col) - F.sum("_floor").over(Window.partitionBy()))
    d = d.withColumn("_ord", F.row_number().over(
        Window.partitionBy().orderBy(F.desc(F.col("_cont") - F.col("_floor")), F.col(by))))
    return d.withColumn(out, (F.col("_floor") + (F.col("_ord") <= F.col("_need")).cast("long")).cast("long")) \
            .drop("_cont", "_floor", "_need", "_ord")


def class_counts(df: DataFrame, by: str = C.TARGET) -> DataFrame:
    return df.groupBy(by).agg(F.count(F.lit(1)).alias("n"))


def with_draw(df: DataFrame, seed: int = C.SEED, id_col: str = "id", out: str = "_u") -> DataFrame:
    return df.withColumn(out, md5_uniform(seed, F.col(id_col)))


def stratified_split(df: DataFrame, test_size: float = C.TEST_SIZE, seed: int = C.SEED,
                     id_col: str = "id", by: str = C.TARGET) -> DataFrame:
    """Adds ``is_test``.  Train gets floor((1-t)n) rows split by approximate
    mode first; every other row is test; within a class the first rows in md5
    order go to test."""
    cc = class_counts(df, by)
    tot = cc.agg(F.sum("n").alias("_tot"))
    cc = cc.withColumn("_ntrain", F.floor(F.lit(1.0 - test_size) * F.sum("n").over(Window.partitionBy())))
    alloc = approximate_mode(cc, "_ntrain", "n_train", by)
    k = alloc.select(by, (F.col("n") - F.col("n_train")).alias("k"))
    d = with_draw(df, seed, id_col)
    return first_k_mask(d, [by], "_u", id_col, k, out_col="is_test").drop("_u")


def stratified_subsample(df: DataFrame, fraction: float = C.TUNE_FRACTION, seed: int = C.SEED,
                         id_col: str = "id", by: str = C.TARGET) -> DataFrame:
    """C4: keep floor(fraction * n) rows, split over classes by approximate mode."""
    cc = class_counts(df, by).withColumn(
        "_nk", F.floor(F.lit(float(fraction)) * F.sum("n").over(Window.partitionBy())))
    k = approximate_mode(cc, "_nk", "k", by).select(by, "k")
    d = with_draw(df, seed, id_col)
    return first_k_mask(d, [by], "_u", id_col, k, out_col="_keep").where("_keep").drop("_u", "_keep")


def undersample(df: DataFrame, seed: int = C.SEED, id_col: str = "id", by: str = C.TARGET) -> DataFrame:
    """Every class cut to the minority count, drawn without replacement."""
    cc = class_counts(df, by)
    k = cc.select(by, F.min("n").over(Window.partitionBy()).alias("k"))
    d = with_draw(df, seed, id_col)
    return first_k_mask(d, [by], "_u", id_col, k, out_col="_keep").where("_keep").drop("_u", "_keep")


def resample(df: DataFrame, strategy: str, seed: int = C.SEED, id_col: str = "id", **kw) -> DataFrame:
    """None / undersample / smote."""
    if strategy == "none":
        return df
    if strategy == "undersample":
        return undersample(df, seed, id_col)
    if strategy == "smote":
        from .knn import smote
        return smote(df, seed=seed, id_col=id_col, **kw)
    raise ValueError(f"no resampling named {strategy!r}: none, undersample and smote are there")


def balanced_weights(df: DataFrame, by: str = C.TARGET, out: str = "weight") -> DataFrame:
    """N / (n_classes * n_class) per row; class counts are a tiny broadcast table."""
    cc = class_counts(df, by)
    w = cc.select(by, (F.sum("n").over(Window.partitionBy()).cast("double")
                       / (F.count(F.lit(1)).over(Window.partitionBy()) * F.col("n"))).alias(out))
    return df.join(F.broadcast(w), by)


def class_report(steps: dict[str, DataFrame], by: str = C.TARGET) -> DataFrame:
    """Rows per class at each named step."""
    out = None
    for name, d in steps.items():
        part = d.groupBy(by).agg(F.count(F.lit(1)).alias("rows")).withColumn("step", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out.select("step", by, "rows")


def stratified_folds(df: DataFrame, k: int = C.CV_FOLDS, seed: int = C.SEED, id_col: str = "id",
                     by: str = C.TARGET, out: str = "fold") -> DataFrame:
    """fold = (rank within class in md5 order - 1) mod k."""
    d = with_draw(df, seed, id_col)
    r = uniform_rank(d, [by], "_u", id_col, "_rank")
    return r.withColumn(out, F.pmod(F.col("_rank") - 1, F.lit(k)).cast("int")).drop("_u", "_rank")
