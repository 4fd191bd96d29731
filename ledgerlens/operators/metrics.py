"""Evaluation (E1-E14): confusion counts, threshold metrics, exact ranking metrics.

All metrics are computed per group (``by``: e.g. model and sampling), so one
pass over a long scored table evaluates any grid of runs.  Ranking metrics
move the rows once, into ranges of scores, and each task adds up its range.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import config as C
from ..functions.dist import BUCKET_ROWS, bucket_count, range_sums
from ..functions.numeric import safe_ratio
from ..session import cut_lineage


def confusion(df: DataFrame, label: str = "Class", pred: str = "prediction", by=()) -> DataFrame:
    """Tn, fp, fn, tp (zeros present) per group."""
    y, p = F.col(label), F.col(pred)
    return df.groupBy(*by).agg(
        F.count_if((y == 0) & (p == 0)).alias("tn"), F.count_if((y == 0) & (p == 1)).alias("fp"),
        F.count_if((y == 1) & (p == 0)).alias("fn"), F.count_if((y == 1) & (p == 1)).alias("tp"))


def confusion_long(cm: DataFrame, by=()) -> DataFrame:
    """E1 long form: (actual, predicted, n)."""
    stack = F.expr("stack(4, 0, 0, tn, 0, 1, fp, 1, 0, fn, 1, 1, tp) AS (actual, predicted, n)")
    return cm.select(*by, stack)


def confusion_normalised(cm: DataFrame, by=()) -> DataFrame:
    """Each count divided by its actual-class total."""
    long = confusion_long(cm, by)
    tot = F.sum("n").over(Window.partitionBy(*by, "actual"))
    return long.withColumn("share", safe_ratio(F.col("n"), tot))


def threshold_metrics(cm: DataFrame, digits: int = 4) -> DataFrame:
    """Accuracy, precision, recall, f1 from counts, zero division -> 0, rounded."""
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    prec = safe_ratio(tp, tp + fp)
    rec = safe_ratio(tp, tp + fn)
    f1 = safe_ratio(2 * tp, 2 * tp + fp + fn)
    acc = safe_ratio(tp + tn, tp + tn + fp + fn)
    return cm.withColumns({"accuracy": F.round(acc, digits), "precision": F.round(prec, digits),
                           "recall": F.round(rec, digits), "f1_score": F.round(f1, digits)})


def score_groups(df: DataFrame, label: str = "Class", score: str = "p", by=(),
                 n_buckets: int | None = None) -> DataFrame:
    """Distinct scores per group with positive/negative counts and, in
    descending score order, the positives/negatives strictly above (tp_above,
    fp_above) and up to and including (tp_cum, fp_cum) each score, a double."""
    hit = {"pos": F.col(label) == 1, "neg": F.col(label) != 1}
    rows, names = df.select(*by, score, *[F.coalesce(c, F.lit(False)).cast("long").alias(n) for n, c in hit.items()]), None
    if by:                              # groups travel as numbers
        names = cut_lineage(rows.select(*by).distinct().withColumn("_g", F.monotonically_increasing_id()), "score-groups")
        rows = rows.join(names, list(by))
    else:
        rows = rows.withColumn("_g", F.lit(0).cast("long"))
    rows = rows.select("_g", F.col(score).cast("double").alias(score), *hit)
    n = bucket_count(rows.count(), 5 * BUCKET_ROWS) if n_buckets is None else max(n_buckets, 1)
    # the sample chooses between two ways to the same rows
    told, distinct = rows.sample(0.01, seed=C.SEED).agg(F.count(F.lit(1)), F.approx_count_distinct(F.struct("_g", score))).first()
    if 2 * distinct < told:             # repeated scores are summed before they move
        rows = rows.groupBy("_g", score).agg(*[F.sum(c).alias(c) for c in hit])
    ranged = rows.repartitionByRange(n, F.col(score).desc(), "_g")
    r = range_sums(ranged, "_g", score, {"tp_cum": "pos", "fp_cum": "neg"})
    if by:
        r = r.join(names, "_g")
    return r.select(*by, score, "pos", "neg", "tp_cum", "fp_cum", (F.col("tp_cum") - F.col("pos")).alias("tp_above"), (F.col("fp_cum") - F.col("neg")).alias("fp_above"))


def ranking_metrics(groups: DataFrame, by=()) -> DataFrame:
    """E4 + E5: exact ROC AUC (ties averaged) and average precision per group.

    AUC = sum over scores of neg * (pos above + pos / 2) / (P * N);
    AP  = sum over scores of (pos / P) * precision at that score.
    A group with one class only gets 0 (undefined)."""
    agg = groups.groupBy(*by).agg(
        F.sum("pos").alias("P"), F.sum("neg").alias("N"),
        F.sum(F.col("neg").cast("double") * (F.col("tp_above") + F.col("pos") / 2.0)).alias("_pairs"),
        F.sum(F.col("pos") * safe_ratio(F.col("tp_cum"), F.col("tp_cum") + F.col("fp_cum"))).alias("_ap"))
    return agg.select(*by,
                      F.when((F.col("P") > 0) & (F.col("N") > 0), F.col("_pairs") / (F.col("P").cast("double") * F.col("N")))
                       .otherwise(0.0).alias("auc_roc"),
                      F.when(F.col("P") > 0, F.col("_ap") / F.col("P")).otherwise(0.0).alias("auc_pr"))


def _with_total_pos(groups: DataFrame, by=()) -> tuple[DataFrame, list[str]]:
    """Attach the group's positive count (one row per group, broadcast)."""
    keys = list(by)
    g = groups
    if not keys:
        g, keys = g.withColumn("_g", F.lit(0)), ["_g"]
    tot = g.groupBy(*keys).agg(F.sum("pos").alias("_P"))
    return g.join(tot, keys), keys


def pr_curve(groups: DataFrame, by=(), score: str = "p") -> DataFrame:
    """(threshold, recall, precision) per distinct score plus the end point
    (recall 0, precision 1, threshold null)."""
    groups, _ = _with_total_pos(groups, by)
    P = F.col("_P")
    pts = groups.select(*by, F.col(score).alias("threshold"),
                        F.when(P > 0, F.col("tp_cum") / P).otherwise(1.0).alias("recall"),
                        safe_ratio(F.col("tp_cum"), F.col("tp_cum") + F.col("fp_cum")).alias("precision"))
    ends = groups.select(*by).distinct().select(*by, F.lit(None).cast("double").alias("threshold"),
                                                 F.lit(0.0).alias("recall"), F.lit(1.0).alias("precision"))
    return pts.unionByName(ends)


def pr_area(groups: DataFrame, by=(), score: str = "p") -> DataFrame:
    """E6 area: trapezoid over the PR curve.  Consecutive points are adjacent
    distinct scores; each score's predecessor values come from its own running
    sums (tp_above/fp_above), so no lag across the whole curve is needed."""
    groups, _ = _with_total_pos(groups, by)
    P = F.col("_P")
    rec = F.col("tp_cum") / P
    prec = safe_ratio(F.col("tp_cum"), F.col("tp_cum") + F.col("fp_cum"))
    # the point before is the previous distinct score, or the (0, 1) end point
    prev_rec = F.col("tp_above") / P
    prev_prec = F.when(F.col("tp_above") + F.col("fp_above") == 0, F.lit(1.0)) \
                 .otherwise(F.col("tp_above") / (F.col("tp_above") + F.col("fp_above")))
    seg = (rec - prev_rec) * (prec + prev_prec) / 2.0
    return groups.withColumn("_seg", F.when(P > 0, seg).otherwise(0.0)).groupBy(*by) \
                 .agg(F.sum("_seg").alias("pr_auc_trapezoid"))


def evaluate(df: DataFrame, label: str = "Class", pred: str = "prediction", score: str | None = "p",
             by=(), digits: int = 4, n_buckets: int | None = None) -> DataFrame:
    """One metrics row per group (accuracy .. auc_pr, auc 0.0 without a score)."""
    cm = threshold_metrics(confusion(df, label, pred, by), digits)
    if score is None:
        out = cm.withColumn("auc_roc", F.lit(0.0)).withColumn("auc_pr", F.lit(0.0))
    else:
        rk = ranking_metrics(score_groups(df, label, score, by, n_buckets), by)
        rk = rk.select(*by, F.round("auc_roc", digits).alias("auc_roc"), F.round("auc_pr", digits).alias("auc_pr"))
        keys = list(by) or ["_g"]
        if not by:
            cm, rk = cm.withColumn("_g", F.lit(0)), rk.withColumn("_g", F.lit(0))
        out = cm.join(rk, keys)
    return out.select(*by, "accuracy", "precision", "recall", "f1_score", "auc_roc", "auc_pr")


def classification_report(cm: DataFrame, by=(), digits: int = 4) -> DataFrame:
    """Per-class precision/recall/f1/support, accuracy, macro and weighted averages."""
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    cls1 = cm.select(*by, F.lit("1").alias("row"), safe_ratio(tp, tp + fp).alias("precision"),
                     safe_ratio(tp, tp + fn).alias("recall"), safe_ratio(2 * tp, 2 * tp + fp + fn).alias("f1"),
                     (tp + fn).alias("support"))
    cls0 = cm.select(*by, F.lit("0").alias("row"), safe_ratio(tn, tn + fn).alias("precision"),
                     safe_ratio(tn, tn + fp).alias("recall"), safe_ratio(2 * tn, 2 * tn + fn + fp).alias("f1"),
                     (tn + fp).alias("support"))
    per = cls0.unionByName(cls1)
    tot = F.sum("support")
    macro = per.groupBy(*by).agg(F.lit("macro avg").alias("row"), F.avg("precision").alias("precision"),
                                 F.avg("recall").alias("recall"), F.avg("f1").alias("f1"), tot.alias("support"))
    wavg = per.groupBy(*by).agg(F.lit("weighted avg").alias("row"),
                                (F.sum(F.col("precision") * F.col("support")) / tot).alias("precision"),
                                (F.sum(F.col("recall") * F.col("support")) / tot).alias("recall"),
                                (F.sum(F.col("f1") * F.col("support")) / tot).alias("f1"), tot.alias("support"))
    acc = cm.select(*by, F.lit("accuracy").alias("row"), F.lit(None).cast("double").alias("precision"),
                    F.lit(None).cast("double").alias("recall"), safe_ratio(tp + tn, tp + tn + fp + fn).alias("f1"),
                    (tp + tn + fp + fn).alias("support"))
    out = per.unionByName(acc).unionByName(macro).unionByName(wavg)
    return out.select(*by, "row", *[F.round(c, digits).alias(c) for c in ("precision", "recall", "f1")],
                      F.col("support").cast("long").alias("support"))


TECHNIQUES = {"baseline (no sampling)": "Without Under-/Over-sampling", "none": "Without Under-/Over-sampling",
              "undersample": "With Under-sampling", "smote": "With SMOTE"}
METRIC_COLS = ["accuracy", "precision", "recall", "f1_score", "auc_roc", "auc_pr"]


def technique_summary(table: DataFrame) -> DataFrame:
    """Comparison rows indexed by (technique, model)."""
    m = F.create_map(*[x for k, v in TECHNIQUES.items() for x in (F.lit(k), F.lit(v))])
    return table.withColumn("technique", F.coalesce(m[F.col("sampling")], F.col("sampling")))


def melt_metrics(table: DataFrame, metrics=None) -> DataFrame:
    """Wide metrics -> (model, sampling, Metric, Score)."""
    metrics = [m for m in (metrics or METRIC_COLS[:4]) if m in table.columns]
    return table.unpivot(["model", "sampling"], metrics, "Metric", "Score")


def rank_models(table: DataFrame) -> DataFrame:
    """1-based rank by f1 desc, recall desc (model, sampling break ties)."""
    w = Window.orderBy(F.desc("f1_score"), F.desc("recall"), "model", "sampling")
    return table.withColumn("rank", F.row_number().over(w))


def sort_metric(table: DataFrame, metric: str) -> DataFrame:
    """The table ascending by one metric, for charts (model, sampling break ties)."""
    if metric not in METRIC_COLS:
        raise ValueError(f"{metric!r} is not one of {METRIC_COLS}")
    return table.orderBy(metric, "model", "sampling")


def best_model(table: DataFrame) -> DataFrame:
    """The top-ranked row."""
    return table.orderBy(F.desc("f1_score"), F.desc("recall"), "model", "sampling").limit(1)
