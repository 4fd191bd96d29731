"""Exploratory statistics (G1-G13), exact and in a bounded number of passes."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import config as C
from ..functions.quantile import exact_quantiles, long_values


def describe(df: DataFrame, cols=None) -> DataFrame:
    """G1: count, mean, sample std, min, 25/50/75%, max per column (long form)."""
    cols = cols or [c for c in df.columns if c != "id"]
    long = long_values(df, cols)
    basic = long.groupBy("feature").agg(F.count(F.lit(1)).alias("count"), F.avg("value").alias("mean"),
                                      F.stddev_samp("value").alias("std"), F.min("value").alias("min"),
                                      F.max("value").alias("max"))
    q = exact_quantiles(df, cols, [0.25, 0.5, 0.75], long=long)
    return basic.join(q.select("feature", F.col("q_0").alias("q25"), F.col("q_1").alias("q50"),
                               F.col("q_2").alias("q75")), "feature")


def null_count(df: DataFrame) -> DataFrame:
    """Total null cells."""
    total = sum((F.count_if(F.col(c).isNull()) for c in df.columns), F.lit(0))
    return df.agg(total.cast("long").alias("null_cells"))


def duplicate_count(df: DataFrame, cols=None) -> DataFrame:
    """Rows beyond the first of each identical group (map-side partial counts)."""
    cols = cols or df.columns
    g = df.groupBy(*cols).agg(F.count(F.lit(1)).alias("_n"))
    return g.agg(F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).cast("long").alias("duplicates"))


def class_distribution(df: DataFrame, by: str = C.TARGET) -> DataFrame:
    """Count and percentage (3 dp) per class."""
    g = df.groupBy(by).agg(F.count(F.lit(1)).alias("count"))
    return g.withColumn("pct", F.round(F.col("count") * 100.0 / F.sum("count").over(Window.partitionBy()), 3))


def correlation_with_target(df: DataFrame, cols=None, target: str = C.TARGET) -> DataFrame:
    """Pearson correlation of every column with the target, one pass."""
    cols = cols or [c for c in df.columns if c not in ("id", target)]
    row = df.agg(*[F.corr(F.col(c).cast("double"), F.col(target).cast("double")).alias(c) for c in cols])
    return row.unpivot([], cols, "feature", "corr")


def top_correlations(corrs: DataFrame, n: int = 5) -> DataFrame:
    """N most positive and n most negative correlations."""
    pos = corrs.orderBy(F.desc("corr"), "feature").limit(n).withColumn("side", F.lit("positive"))
    neg = corrs.orderBy(F.asc("corr"), "feature").limit(n).withColumn("side", F.lit("negative"))
    return pos.unionByName(neg)


def strongest(df: DataFrame, cols, n: int = 10, target: str = C.TARGET) -> list[str]:
    """Names of the n columns with the largest absolute correlation with the target."""
    corrs = correlation_with_target(df, cols, target)
    return [r["feature"] for r in corrs.orderBy(F.desc(F.abs("corr")), "feature").limit(n).collect()]


def correlation_matrix(df: DataFrame, cols) -> DataFrame:
    """Full Pearson matrix in one aggregate, long form (a, b, corr)."""
    cols = list(cols)
    aggs = [F.corr(F.col(a).cast("double"), F.col(b).cast("double")).alias(f"{a}__{b}")
            for i, a in enumerate(cols) for b in cols[i:]]
    row = df.agg(*aggs)
    long = row.unpivot([], [f"{a}__{b}" for i, a in enumerate(cols) for b in cols[i:]], "pair", "corr")
    parts = F.split("pair", "__")
    one = long.select(parts[0].alias("a"), parts[1].alias("b"), "corr")
    mirror = one.where(F.col("a") != F.col("b")).select(F.col("b").alias("a"), F.col("a").alias("b"), "corr")
    return one.unionByName(mirror)


def histogram(df: DataFrame, col: str, bins: int = 50, by=()) -> DataFrame:
    """Equal-width bins over [min, max] per group, max in the last bin, density normalised."""
    v = F.col(col).cast("double")
    d = df.select(*by, v.alias("_x")).where(F.col("_x").isNotNull() & ~F.isnan("_x"))
    rng = d.groupBy(*by).agg(F.min("_x").alias("_lo"), F.max("_x").alias("_hi"), F.count(F.lit(1)).alias("_n"))
    width = (F.col("_hi") - F.col("_lo")) / bins
    idx = F.when(F.col("_hi") == F.col("_lo"), F.lit(0)) \
           .otherwise(F.least(F.floor((F.col("_x") - F.col("_lo")) / width), F.lit(bins - 1))).cast("int")
    # one row per group: the strata of the caller (classes, features)
    keys = list(by)
    if not keys:  # one global range row, joined on a constant key
        d, rng, keys = d.withColumn("_g", F.lit(0)), rng.withColumn("_g", F.lit(0)), ["_g"]
    j = d.join(F.broadcast(rng), keys)
    counts = j.groupBy(*by, idx.alias("bin"), "_lo", "_hi", "_n").agg(F.count(F.lit(1)).alias("count"))
    w = F.when(F.col("_hi") == F.col("_lo"), F.lit(1.0)).otherwise(width)
    return counts.select(*by, "bin", (F.col("_lo") + F.col("bin") * w).alias("left"),
                         (F.col("_lo") + (F.col("bin") + 1) * w).alias("right"), "count",
                         (F.col("count") / (F.col("_n") * w)).alias("density"))


def auto_bins(df: DataFrame, col: str) -> DataFrame:
    """Bin count = max(Sturges, Freedman-Diaconis), as numpy's 'auto'."""
    q = exact_quantiles(df, [col], [0.25, 0.75])
    rng = df.agg(F.min(F.col(col).cast("double")).alias("lo"), F.max(F.col(col).cast("double")).alias("hi"))
    j = q.withColumns({"lo": rng.select("lo").scalar(), "hi": rng.select("hi").scalar()})
    n = F.col("n").cast("double")
    sturges = (F.col("hi") - F.col("lo")) / (F.log2(n) + 1.0)
    fd = 2.0 * (F.col("q_1") - F.col("q_0")) * F.pow(n, -1.0 / 3.0)
    width = F.when(fd > 0, F.least(fd, sturges)).otherwise(sturges)
    bins = F.when(F.col("hi") == F.col("lo"), F.lit(1)) \
            .otherwise(F.ceil((F.col("hi") - F.col("lo")) / width)).cast("int")
    return j.select(F.lit(col).alias("feature"), "n", F.col("lo").alias("min"), F.col("hi").alias("max"),
                    width.alias("width"), bins.alias("bins"))


def class_histograms(df: DataFrame, cols=None, bins: int = 50, target: str = C.TARGET) -> DataFrame:
    """Per class and feature, 50-bin density with edges from that class."""
    cols = cols or C.V_COLS
    long = df.select(target, *cols).unpivot([target], cols, "feature", "value")
    return histogram(long, "value", bins, by=[target, "feature"])


def kde(df: DataFrame, col: str, points: int = 200) -> DataFrame:
    """Gaussian KDE, Scott bandwidth, evaluated on ``points`` over [min, max].

    Values are pre-aggregated to distinct (value, count); each task adds up the
    densities of its values at all points in one array."""
    v = F.col(col).cast("double")
    vals = df.select(v.alias("x")).where(F.col("x").isNotNull() & ~F.isnan("x"))
    st = vals.agg(F.count(F.lit(1)).alias("n"), F.stddev_samp("x").alias("sd"), F.min("x").alias("lo"), F.max("x").alias("hi")).first()
    if not st["n"] or not st["sd"]:
        return df.sparkSession.createDataFrame([], "k int, grid_x double, density double")
    n, bw = st["n"], st["sd"] * float(st["n"]) ** -0.2
    grid = np.array([st["lo"] + (st["hi"] - st["lo"]) * k / (points - 1) for k in range(points)])

    def run(batches):
        total = np.zeros(points)
        for b in batches:
            x, c = b.column("x").to_numpy(), b.column("c").to_numpy()
            for at in range(0, len(x), 1024):
                z = (grid[None, :] - x[at:at + 1024, None]) / bw
                total += c[at:at + 1024] @ np.exp(-0.5 * z * z)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(points), pa.int32()), pa.array(grid), pa.array(total)], ["k", "grid_x", "s"])

    sums = vals.groupBy("x").agg(F.count(F.lit(1)).alias("c")).mapInArrow(run, "k int, grid_x double, s double")
    return sums.groupBy("k", "grid_x").agg((F.sum("s") / (n * bw * math.sqrt(2 * math.pi))).alias("density"))


def histogram_auto(df: DataFrame, col: str) -> DataFrame:
    """The histogram over the automatic number of bins."""
    bins = auto_bins(df, col).first()["bins"]
    return histogram(df, col, bins)


def preview(df: DataFrame, order: str = "id", n: int = 5) -> DataFrame:
    """First rows in an explicit order."""
    return df.orderBy(order).limit(n)


def shape(df: DataFrame) -> DataFrame:
    """(position, column, type, rows, columns): the table's shape and its columns in order."""
    columns = F.array(*[F.struct(F.lit(i + 1).alias("position"), F.lit(f.name).alias("column"), F.lit(f.dataType.simpleString()).alias("type")) for i, f in enumerate(df.schema.fields)])
    return df.agg(F.count(F.lit(1)).alias("rows")).select("rows", F.lit(len(df.columns)).alias("columns"), F.explode(columns).alias("c")).select("c.*", "rows", "columns")


def drift_report(ref: DataFrame, cur: DataFrame, cols=None, bins: int = 10, eps: float = 1e-4) -> DataFrame:
    """Population stability index per feature over equal-width bins of the
    reference window (values outside fall in the end bins)."""
    cols = cols or C.V_COLS
    rl = ref.select(*cols).unpivot([], cols, "feature", "value")
    cl = cur.select(*cols).unpivot([], cols, "feature", "value")
    rng = rl.groupBy("feature").agg(F.min("value").alias("_lo"), F.max("value").alias("_hi"))
    width = (F.col("_hi") - F.col("_lo")) / bins

    def binned(x):
        j = x.join(F.broadcast(rng), "feature")
        idx = F.when(width == 0, F.lit(0)).otherwise(
            F.least(F.greatest(F.floor((F.col("value") - F.col("_lo")) / width), F.lit(0)), F.lit(bins - 1)))
        g = j.groupBy("feature", idx.cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("c"))
        return g.withColumn("share", F.col("c") / F.sum("c").over(Window.partitionBy("feature")))
    a = binned(rl).select("feature", "bin", F.col("share").alias("ref"))
    b = binned(cl).select("feature", "bin", F.col("share").alias("cur"))
    j = a.join(b, ["feature", "bin"], "full_outer")
    r = F.greatest(F.coalesce(F.col("ref"), F.lit(0.0)), F.lit(eps))
    c = F.greatest(F.coalesce(F.col("cur"), F.lit(0.0)), F.lit(eps))
    return j.groupBy("feature").agg(F.sum((c - r) * F.log(c / r)).alias("psi"))
