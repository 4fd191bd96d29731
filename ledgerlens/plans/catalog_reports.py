"""Checked queries of evaluation, EDA, scoring, history reports and the
synthetic tables (E, G, H, I, K).

Evaluation runs over ``runs``: every event scored once per (model, sampling)
run of the experiment grid, so each metric is computed for 12 groups in one
pass, as the comparison notebook does.
"""

from __future__ import annotations

import math
import uuid

from pyspark.sql import functions as F

from .. import config as C
from ..functions.numeric import sig_round, sql_sig_round
from ..functions.rand import sql_md5_uniform
from ..operators import clean, eda, history as hist, metrics as M, scoring as S, synth
from ..session import shared_dir
from ..sources import fixtures as fx
from .registry import query

W = fx.sql_with
BY = ["model", "sampling"]
SBY = "model, sampling"


def _sr(c, d=10):
    return sig_round(F.col(c), d).alias(c)


def _ss(expr, alias, d=10):
    return f"{sql_sig_round(expr, d)} AS {alias}"


def _q(c):
    return f'"{c}"' if c == "Time" else c


# ================================================================ E evaluation
_CM_SQL = ("cm AS (SELECT model, sampling, count_if(Class = 0 AND prediction = 0) AS tn, "
           "count_if(Class = 0 AND prediction = 1) AS fp, count_if(Class = 1 AND prediction = 0) AS fn, "
           "count_if(Class = 1 AND prediction = 1) AS tp FROM runs GROUP BY model, sampling)")


def _sql_div(a, b):
    return f"coalesce(CAST({a} AS DOUBLE) / nullif(CAST({b} AS DOUBLE), 0), 0.0)"


_TM_SQL = ("tm AS (SELECT model, sampling, tn, fp, fn, tp, "
           f"round({_sql_div('tp + tn', 'tp + tn + fp + fn')}, 4) AS accuracy, "
           f"round({_sql_div('tp', 'tp + fp')}, 4) AS precision, round({_sql_div('tp', 'tp + fn')}, 4) AS recall, "
           f"round({_sql_div('2 * tp', '2 * tp + fp + fn')}, 4) AS f1_score FROM cm)")

_RK_SQL = ("g AS (SELECT model, sampling, p, count_if(Class = 1) AS pos, count_if(Class <> 1) AS neg FROM runs "
           "GROUP BY model, sampling, p), "
           "cu AS (SELECT *, sum(pos) OVER w AS tp_cum, sum(neg) OVER w AS fp_cum FROM g "
           "WINDOW w AS (PARTITION BY model, sampling ORDER BY p DESC ROWS UNBOUNDED PRECEDING)), "
           "rk AS (SELECT model, sampling, sum(pos) AS n_pos, sum(neg) AS n_neg, "
           "sum(neg * (tp_cum - pos + pos / 2.0)) AS pairs, "
           f"sum(pos * {_sql_div('tp_cum', 'tp_cum + fp_cum')}) AS ap FROM cu GROUP BY model, sampling), "
           "rm AS (SELECT model, sampling, round(CASE WHEN n_pos > 0 AND n_neg > 0 THEN pairs / (n_pos * n_neg) ELSE 0.0 END, 4) AS auc_roc, "
           "round(CASE WHEN n_pos > 0 THEN ap / n_pos ELSE 0.0 END, 4) AS auc_pr FROM rk)")


def _runs(spark, d):
    return fx.runs_scored(spark, d)


@query("confusion", "E1", W("runs") + ", " + _CM_SQL + " SELECT * FROM cm")
def q_confusion(spark, d):
    return M.confusion(_runs(spark, d), by=BY)


@query("confusion_normalised", "E2",
       W("runs") + ", " + _CM_SQL + ", lg AS (SELECT model, sampling, 0 AS actual, 0 AS predicted, tn AS n FROM cm "
       "UNION ALL SELECT model, sampling, 0, 1, fp FROM cm UNION ALL SELECT model, sampling, 1, 0, fn FROM cm "
       "UNION ALL SELECT model, sampling, 1, 1, tp FROM cm) SELECT model, sampling, actual, predicted, n, "
       + _ss(_sql_div("n", "sum(n) OVER (PARTITION BY model, sampling, actual)"), "share") + " FROM lg")
def q_confusion_norm(spark, d):
    cm = M.confusion(_runs(spark, d), by=BY)
    return M.confusion_normalised(cm, BY).select(*BY, "actual", "predicted", "n", _sr("share"))


@query("threshold_metrics", "E3", W("runs") + ", " + _CM_SQL + ", " + _TM_SQL + " SELECT * FROM tm")
def q_threshold(spark, d):
    return M.threshold_metrics(M.confusion(_runs(spark, d), by=BY))


@query("ranking_metrics", "E4 E5", W("runs") + ", " + _RK_SQL + " SELECT * FROM rm")
def q_ranking(spark, d):
    r = M.ranking_metrics(M.score_groups(_runs(spark, d), by=BY), BY)
    return r.select(*BY, F.round("auc_roc", 4).alias("auc_roc"), F.round("auc_pr", 4).alias("auc_pr"))


@query("pr_curve", "E6",
       W("runs") + ", " + _RK_SQL + " SELECT cu.model, cu.sampling, cu.p AS threshold, "
       + _ss("CASE WHEN rk.n_pos > 0 THEN CAST(tp_cum AS DOUBLE) / rk.n_pos ELSE 1.0 END", "recall") + ", "
       + _ss(_sql_div("tp_cum", "tp_cum + fp_cum"), "precision")
       + " FROM cu JOIN rk USING (model, sampling) UNION ALL "
       "SELECT model, sampling, NULL, 0.0, 1.0 FROM rk")
def q_pr_curve(spark, d):
    c = M.pr_curve(M.score_groups(_runs(spark, d), by=BY), BY)
    return c.select(*BY, "threshold", _sr("recall"), _sr("precision"))


@query("pr_area", "E6",
       W("runs") + ", " + _RK_SQL + ", pts AS (SELECT cu.*, rk.n_pos, "
       "lag(CAST(tp_cum AS DOUBLE) / rk.n_pos, 1, 0.0) OVER w AS prev_rec, "
       "lag(" + _sql_div("tp_cum", "tp_cum + fp_cum") + ", 1, 1.0) OVER w AS prev_prec, "
       "CAST(tp_cum AS DOUBLE) / rk.n_pos AS rec, " + _sql_div("tp_cum", "tp_cum + fp_cum") + " AS prec "
       "FROM cu JOIN rk USING (model, sampling) WINDOW w AS (PARTITION BY model, sampling ORDER BY cu.p DESC)) "
       "SELECT model, sampling, " + _ss("sum(CASE WHEN n_pos > 0 THEN (rec - prev_rec) * (prec + prev_prec) / 2.0 ELSE 0.0 END)",
                                         "pr_auc_trapezoid", 8)
       + " FROM pts GROUP BY model, sampling")
def q_pr_area(spark, d):
    a = M.pr_area(M.score_groups(_runs(spark, d), by=BY), BY)
    return a.select(*BY, _sr("pr_auc_trapezoid", 8))


def _sql_cls_report():
    r = lambda x: f"round({x}, 4)"
    return (
        "SELECT model, sampling, '0' AS row, " + r(_sql_div("tn", "tn + fn")) + " AS precision, "
        + r(_sql_div("tn", "tn + fp")) + " AS recall, " + r(_sql_div("2 * tn", "2 * tn + fn + fp")) + " AS f1, "
        "tn + fp AS support FROM cm UNION ALL "
        "SELECT model, sampling, '1', " + r(_sql_div("tp", "tp + fp")) + ", " + r(_sql_div("tp", "tp + fn")) + ", "
        + r(_sql_div("2 * tp", "2 * tp + fp + fn")) + ", tp + fn FROM cm UNION ALL "
        "SELECT model, sampling, 'accuracy', NULL, NULL, " + r(_sql_div("tp + tn", "tp + tn + fp + fn"))
        + ", tp + tn + fp + fn FROM cm UNION ALL "
        "SELECT model, sampling, 'macro avg', " + r("(p0 + p1) / 2") + ", " + r("(r0 + r1) / 2") + ", "
        + r("(f0 + f1) / 2") + ", s0 + s1 FROM pc UNION ALL "
        "SELECT model, sampling, 'weighted avg', " + r("(p0 * s0 + p1 * s1) / (s0 + s1)") + ", "
        + r("(r0 * s0 + r1 * s1) / (s0 + s1)") + ", " + r("(f0 * s0 + f1 * s1) / (s0 + s1)") + ", s0 + s1 FROM pc")


@query("classification_report", "E7",
       W("runs") + ", " + _CM_SQL + ", pc AS (SELECT model, sampling, "
       + _sql_div("tn", "tn + fn") + " AS p0, " + _sql_div("tn", "tn + fp") + " AS r0, "
       + _sql_div("2 * tn", "2 * tn + fn + fp") + " AS f0, tn + fp AS s0, "
       + _sql_div("tp", "tp + fp") + " AS p1, " + _sql_div("tp", "tp + fn") + " AS r1, "
       + _sql_div("2 * tp", "2 * tp + fp + fn") + " AS f1, tp + fn AS s1 FROM cm) " + _sql_cls_report())
def q_cls_report(spark, d):
    return M.classification_report(M.confusion(_runs(spark, d), by=BY), BY)


def _display_sql(col):
    return ("CASE " + col + " " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in C.DISPLAY_NAMES.items())
            + f" ELSE {col} END")


_COMP_SQL = (W("runs") + ", " + _CM_SQL + ", " + _TM_SQL + ", " + _RK_SQL
             + ", comp AS (SELECT " + _display_sql("tm.model") + " AS model, tm.sampling, accuracy, precision, "
             "recall, f1_score, auc_roc, auc_pr FROM tm JOIN rm USING (model, sampling)) ")


def _comparison(spark, d):
    t = M.evaluate(_runs(spark, d), by=BY)
    return t.withColumn("model", clean.display_name(F.col("model")))


@query("comparison_table", "E8 E9", _COMP_SQL + "SELECT * FROM comp")
def q_comparison(spark, d):
    return _comparison(spark, d)


_TECH_SQL = ("CASE sampling " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in M.TECHNIQUES.items())
             + " ELSE sampling END")


@query("technique_summary", "E10", _COMP_SQL + f"SELECT *, {_TECH_SQL} AS technique FROM comp")
def q_technique(spark, d):
    return M.technique_summary(_comparison(spark, d))


@query("melt_metrics", "E11",
       _COMP_SQL + "SELECT model, sampling, Metric, Score FROM comp UNPIVOT (Score FOR Metric IN "
       "(accuracy, precision, recall, f1_score))")
def q_melt(spark, d):
    return M.melt_metrics(_comparison(spark, d))


@query("rank_models", "E12 E14",
       _COMP_SQL + "SELECT *, CAST(row_number() OVER (ORDER BY f1_score DESC, recall DESC, model, sampling) AS INTEGER) "
       "AS rank FROM comp")
def q_rank(spark, d):
    return M.rank_models(_comparison(spark, d))


@query("best_model", "E13", _COMP_SQL + "SELECT * FROM comp ORDER BY f1_score DESC, recall DESC, model, sampling LIMIT 1")
def q_best(spark, d):
    return M.best_model(_comparison(spark, d))


@query("exclude_baseline", "B9 B10",
       _COMP_SQL + "SELECT model, sampling FROM comp WHERE NOT coalesce(contains(lower(sampling), 'baseline'), false) "
       "AND (sampling IS NULL OR sampling <> 'undersample')")
def q_excl(spark, d):
    c = _comparison(spark, d)
    return clean.exclude_label(clean.exclude_baseline(c), "undersample").select("model", "sampling")


# ================================================================ G exploration
TXF = C.FEATURES + ["Class"]


@query("describe", "G1 A18",
       W("tx") + " " + " UNION ALL ".join(
           f"SELECT '{c}' AS feature, count({_q(c)}) AS count, {sql_sig_round(f'avg({_q(c)})')} AS mean, "
           f"{sql_sig_round(f'stddev_samp({_q(c)})')} AS std, CAST(min({_q(c)}) AS DOUBLE) AS min, "
           f"CAST(max({_q(c)}) AS DOUBLE) AS max, {sql_sig_round(f'quantile_cont({_q(c)}, 0.25)')} AS q25, "
           f"{sql_sig_round(f'quantile_cont({_q(c)}, 0.5)')} AS q50, "
           f"{sql_sig_round(f'quantile_cont({_q(c)}, 0.75)')} AS q75 FROM tx" for c in TXF))
def q_describe(spark, d):
    x = eda.describe(fx.tx(spark, d), TXF)
    return x.select("feature", "count", _sr("mean"), _sr("std"), "min", "max", _sr("q25"), _sr("q50"), _sr("q75"))


@query("duplicate_count", "G3",
       "SELECT CAST(coalesce(sum(n - 1), 0) AS BIGINT) AS duplicates FROM "
       "(SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, "
       "l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate)")
def q_dups(spark, d):
    return eda.duplicate_count(fx.table(spark, d, "lineitem"))


@query("class_distribution", "G4",
       W("tx_events") + "SELECT Class, count(*) AS count, round(count(*) * 100.0 / sum(count(*)) OVER (), 3) AS pct "
       "FROM tx_events GROUP BY Class")
def q_class_dist(spark, d):
    return eda.class_distribution(fx.tx_events(spark, d))


_CORR_SQL = W("tx") + ", cr AS (" + " UNION ALL ".join(
    f"SELECT '{c}' AS feature, corr({_q(c)}, CAST(Class AS DOUBLE)) AS corr FROM tx" for c in C.FEATURES) + ") "


@query("correlation_with_target", "G5", _CORR_SQL + "SELECT feature, " + _ss("corr", "corr", 8) + " FROM cr")
def q_corr(spark, d):
    return eda.correlation_with_target(fx.tx(spark, d), C.FEATURES).select("feature", _sr("corr", 8))


@query("top_correlations", "G6",
       _CORR_SQL + "SELECT feature, " + _ss("corr", "corr", 8) + ", side FROM ("
       "(SELECT *, 'positive' AS side FROM cr ORDER BY corr DESC, feature LIMIT 5) UNION ALL "
       "(SELECT *, 'negative' AS side FROM cr ORDER BY corr ASC, feature LIMIT 5))")
def q_top_corr(spark, d):
    c = eda.top_correlations(eda.correlation_with_target(fx.tx(spark, d), C.FEATURES))
    return c.select("feature", _sr("corr", 8), "side")


_LONG_SQL = ("lv AS (SELECT id, feature, value FROM (UNPIVOT (SELECT id, " + ", ".join(f"CAST({_q(c)} AS DOUBLE) AS {_q(c)}" for c in [*C.FEATURES, "Class"])
             + " FROM tx) ON " + ", ".join(_q(c) for c in [*C.FEATURES, "Class"]) + " INTO NAME feature VALUE value))")


@query("correlation_matrix", "G7",
       _CORR_SQL + ", pick AS (SELECT feature FROM (SELECT feature FROM cr ORDER BY abs(corr) DESC, feature LIMIT 10) UNION ALL SELECT 'Class'), "
       + _LONG_SQL + ", s AS (SELECT lv.* FROM lv JOIN pick USING (feature)) SELECT a.feature AS a, b.feature AS b, "
       + _ss("corr(a.value, b.value)", "corr", 8) + " FROM s a JOIN s b ON a.id = b.id GROUP BY 1, 2")
def q_corr_matrix(spark, d):
    """The ten features with the largest absolute correlation with Class, and Class."""
    t = fx.tx(spark, d)
    return eda.correlation_matrix(t, [*eda.strongest(t, C.FEATURES), C.TARGET]).select("a", "b", _sr("corr", 8))


def _sql_hist(src: str, col: str, by: list[str], bins: int = 50) -> str:
    keys = ", ".join(by)
    kj = " AND ".join(f"x.{k} = r.{k}" for k in by) or "TRUE"
    ksel = ", ".join(f"x.{k}" for k in by)
    w = "((r.hi - r.lo) / " + str(bins) + ")"
    idx = f"CAST(CASE WHEN r.hi = r.lo THEN 0 ELSE least(floor((x.v - r.lo) / {w}), {bins - 1}) END AS INTEGER)"
    ww = f"(CASE WHEN r.hi = r.lo THEN 1.0 ELSE {w} END)"
    pre = (f"hx AS (SELECT {keys + ', ' if keys else ''}CAST({col} AS DOUBLE) AS v FROM {src} "
           f"WHERE {col} IS NOT NULL AND NOT isnan({col})), "
           f"hr AS (SELECT {keys + ', ' if keys else ''}min(v) AS lo, max(v) AS hi, count(*) AS n FROM hx"
           f"{' GROUP BY ' + keys if keys else ''}) ")
    return (pre + f"SELECT {keys + ', ' if keys else ''}bin, {sql_sig_round('lo + bin * ww')} AS \"left\", "
            f"{sql_sig_round('lo + (bin + 1) * ww')} AS \"right\", count, "
            f"{sql_sig_round('count / (n * ww)')} AS density FROM ("
            f"SELECT {ksel + ', ' if ksel else ''}{idx} AS bin, r.lo, r.n, {ww} AS ww, count(*) AS count "
            f"FROM hx x JOIN hr r ON {kj} GROUP BY ALL)")


def _hist_out(h, by):
    return h.select(*by, "bin", _sr("left"), _sr("right"), "count", _sr("density"))


@query("histogram", "G8", W("tx_events") + ", " + _sql_hist("tx_events", "Amount", []))
def q_hist(spark, d):
    return _hist_out(eda.histogram(fx.tx_events(spark, d), "Amount", 50), [])


@query("histogram_auto", "G9",
       W("tx_events") + ", st AS (SELECT count(Amount) AS n, min(Amount) AS lo, max(Amount) AS hi, "
       "quantile_cont(Amount, 0.25) AS q1, quantile_cont(Amount, 0.75) AS q3 FROM tx_events), "
       "wd AS (SELECT *, (hi - lo) / (log2(n) + 1.0) AS sturges, 2.0 * (q3 - q1) * pow(n, -1.0 / 3.0) AS fd FROM st), "
       "w2 AS (SELECT *, CASE WHEN fd > 0 THEN least(fd, sturges) ELSE sturges END AS width FROM wd) "
       "SELECT 'Amount' AS feature, n, lo AS min, hi AS max, " + sql_sig_round("width") + " AS width, "
       "CAST(CASE WHEN hi = lo THEN 1 ELSE ceil((hi - lo) / width) END AS INTEGER) AS bins FROM w2")
def q_hist_auto(spark, d):
    a = eda.auto_bins(fx.tx_events(spark, d), "Amount")
    return a.select("feature", "n", "min", "max", _sr("width"), "bins")


@query("class_histograms", "G10",
       W("tx") + ", lv AS (SELECT Class, feature, value FROM (UNPIVOT (SELECT Class, " + ", ".join(C.V_COLS)
       + " FROM tx) ON " + ", ".join(C.V_COLS) + " INTO NAME feature VALUE value)), "
       + _sql_hist("lv", "value", ["Class", "feature"]))
def q_class_hist(spark, d):
    return _hist_out(eda.class_histograms(fx.tx(spark, d)), ["Class", "feature"])


@query("kde", "G11",
       W("tx") + ", st AS (SELECT count(Amount) AS n, stddev_samp(Amount) * pow(count(Amount), -0.2) AS bw, "
       "min(Amount) AS lo, max(Amount) AS hi FROM tx), dv AS (SELECT Amount AS x, count(*) AS c FROM tx GROUP BY Amount), "
       "gr AS (SELECT k, lo + (hi - lo) * k / 199.0 AS grid_x FROM range(200) t(k), st) "
       "SELECT k, " + sql_sig_round("grid_x") + " AS grid_x, "
       + sql_sig_round(f"sum(c * exp(-0.5 * ((grid_x - x) / bw) * ((grid_x - x) / bw))) / (any_value(n) * any_value(bw) * {math.sqrt(2 * math.pi)!r})", 8)
       + " AS density FROM gr, dv, st GROUP BY k, grid_x")
def q_kde(spark, d):
    k = eda.kde(fx.tx(spark, d), "Amount", 200)
    return k.select("k", _sr("grid_x"), _sr("density", 8))


@query("histogram_time", "G8", W("tx") + ", " + _sql_hist("tx", '"Time"', []))
def q_hist_time(spark, d):
    return _hist_out(eda.histogram(fx.tx(spark, d), "Time", 50), [])


def _sql_auto_hist(col):
    return (W("tx_events") + f", st AS (SELECT count({col}) AS n, min({col}) AS lo, max({col}) AS hi, quantile_cont({col}, 0.25) AS q1, quantile_cont({col}, 0.75) AS q3 FROM tx_events), "
            "wd AS (SELECT *, (hi - lo) / (log2(n) + 1.0) AS sturges, 2.0 * (q3 - q1) * pow(n, -1.0 / 3.0) AS fd FROM st), "
            "w2 AS (SELECT *, CASE WHEN hi = lo THEN 1 ELSE ceil((hi - lo) / CASE WHEN fd > 0 THEN least(fd, sturges) ELSE sturges END) END AS bins FROM wd), "
            f"bn AS (SELECT CAST(CASE WHEN hi = lo THEN 0 ELSE least(floor(({col} - lo) / ((hi - lo) / bins)), bins - 1) END AS INTEGER) AS bin, lo, hi, n, bins FROM tx_events, w2 WHERE {col} IS NOT NULL) "
            "SELECT bin, count(*) AS count, " + sql_sig_round("lo + bin * (hi - lo) / bins") + " AS \"left\", " + sql_sig_round("count(*) / (n * (hi - lo) / bins)") + " AS density FROM bn GROUP BY bin, lo, hi, n, bins")


@query("histogram_auto_bins", "G9", _sql_auto_hist("Amount"))
def q_hist_auto_bins(spark, d):
    return eda.histogram_auto(fx.tx_events(spark, d), "Amount").select("bin", "count", _sr("left"), _sr("density"))


@query("kde_time", "G11",
       W("tx") + ", st AS (SELECT count(\"Time\") AS n, stddev_samp(\"Time\") * pow(count(\"Time\"), -0.2) AS bw, "
       "min(\"Time\") AS lo, max(\"Time\") AS hi FROM tx), dv AS (SELECT \"Time\" AS x, count(*) AS c FROM tx GROUP BY 1), "
       "gr AS (SELECT k, lo + (hi - lo) * k / 199.0 AS grid_x FROM range(200) t(k), st) "
       "SELECT k, " + sql_sig_round("grid_x") + " AS grid_x, "
       + sql_sig_round(f"sum(c * exp(-0.5 * ((grid_x - x) / bw) * ((grid_x - x) / bw))) / (any_value(n) * any_value(bw) * {math.sqrt(2 * math.pi)!r})", 8)
       + " AS density FROM gr, dv, st GROUP BY k, grid_x")
def q_kde_time(spark, d):
    return eda.kde(fx.tx(spark, d), "Time", 200).select("k", _sr("grid_x"), _sr("density", 8))


@query("shape", "G12",
       W("tx") + "SELECT i AS position, c AS \"column\", CASE WHEN c = 'id' THEN 'bigint' WHEN c = 'Class' THEN 'int' ELSE 'double' END AS type, (SELECT count(*) FROM tx) AS rows, 32 AS columns FROM (VALUES "
       + ", ".join(f"({i + 1}, '{c}')" for i, c in enumerate(["id", *C.FEATURES, C.TARGET])) + ") v(i, c)")
def q_shape(spark, d):
    """Rows, columns and the column list of the transactions."""
    return eda.shape(fx.tx(spark, d))


@query("preview", "G12", W("tx") + "SELECT id, \"Time\", V1, V2, Amount, Class FROM tx ORDER BY id LIMIT 5")
def q_preview(spark, d):
    return eda.preview(fx.tx(spark, d)).select("id", "Time", "V1", "V2", "Amount", "Class")


def _sql_drift():
    half = '(SELECT max("Time") / 2 FROM tx)'
    lv = lambda cond: ("(SELECT feature, value FROM (UNPIVOT (SELECT " + ", ".join(C.V_COLS)
                       + f" FROM tx WHERE {cond}) ON " + ", ".join(C.V_COLS) + " INTO NAME feature VALUE value))")
    binned = lambda name, src: (
        f"{name} AS (SELECT feature, bin, CAST(c AS DOUBLE) / sum(c) OVER (PARTITION BY feature) AS share FROM ("
        f"SELECT l.feature, CAST(CASE WHEN r.hi = r.lo THEN 0 ELSE least(greatest(floor((l.value - r.lo) / ((r.hi - r.lo) / 10)), 0), 9) END AS INTEGER) AS bin, "
        f"count(*) AS c FROM {src} l JOIN rng r USING (feature) GROUP BY ALL))")
    return (W("tx") + f", rl AS {lv(f'\"Time\" < {half}')}, cl AS {lv(f'\"Time\" >= {half}')}, "
            "rng AS (SELECT feature, min(value) AS lo, max(value) AS hi FROM rl GROUP BY feature), "
            + binned("a", "rl") + ", " + binned("b", "cl") + " "
            "SELECT feature, " + sql_sig_round("sum((c - r) * ln(c / r))", 8) + " AS psi FROM ("
            "SELECT coalesce(a.feature, b.feature) AS feature, greatest(coalesce(a.share, 0.0), 1e-4) AS r, "
            "greatest(coalesce(b.share, 0.0), 1e-4) AS c FROM a FULL OUTER JOIN b ON a.feature = b.feature AND a.bin = b.bin) "
            "GROUP BY feature")


@query("drift_report", "G13", _sql_drift())
def q_drift(spark, d):
    t = fx.tx(spark, d)
    half = F.lit(t.agg(F.max("Time")).first()[0] / 2)
    # reference window: first half of the time range; current: the rest
    p = eda.drift_report(t.where(F.col("Time") < half), t.where(F.col("Time") >= half))
    return p.select("feature", _sr("psi", 8))


# ================================================================ H scoring
@query("normalise_proba", "H1",
       W("scores") + ", a AS (SELECT id, Class, CASE WHEN id % 97 = 0 THEN NULL ELSE [1.0 - p, 3.0 * p] END AS arr FROM scores) "
       "SELECT id, " + sql_sig_round("CASE WHEN arr IS NULL THEN CASE WHEN Class = 1 THEN 1.0 ELSE 0.0 END "
                                     "WHEN abs(arr[1]) + abs(arr[2]) = 0 THEN 0.5 "
                                     "ELSE least(greatest(abs(arr[2]) / (abs(arr[1]) + abs(arr[2])), 0.0), 1.0) END")
       + " AS p1 FROM a")
def q_normalise(spark, d):
    s = fx.scores(spark, d)
    arr = F.when(F.pmod(F.col("id"), F.lit(97)) == 0, F.lit(None)).otherwise(
        F.array(F.lit(1.0) - F.col("p"), F.lit(3.0) * F.col("p")))
    return s.select("id", sig_round(S.normalise_proba(arr, F.col("Class"))).alias("p1"))


@query("verdicts", "H2 H3 H4",
       W("scores") + ", c AS (SELECT id, least(greatest(1.5 * p - 0.25, 0.0), 1.0) AS fp FROM scores) "
       f"SELECT id, fp AS fraud_prob, CASE WHEN fp >= {C.FRAUD_THRESHOLD} THEN 'fraud' WHEN fp >= {C.SUSPECT_THRESHOLD} "
       f"THEN 'suspect' ELSE 'safe' END AS verdict, round(CASE WHEN fp >= {C.SUSPECT_THRESHOLD} THEN fp ELSE 1.0 - fp END, 4) "
       "AS confidence FROM c")
def q_verdicts(spark, d):
    s = fx.scores(spark, d).select("id", (F.lit(1.5) * F.col("p") - F.lit(0.25)).alias("fraud_prob"))
    return S.add_verdict(s, "fraud_prob").select("id", "fraud_prob", "verdict", "confidence")


@query("batch_ids", "H7",
       W("workbook_sheets") + "SELECT DISTINCT file, substr(md5(file || '|' || 'upload'), 1, 8) AS batch_id "
       "FROM workbook_sheets")
def q_batch_ids(spark, d):
    f = fx.workbook_sheets(spark, d).select("file").distinct()
    return f.select("file", S.new_batch_id(F.col("file"), F.lit("upload")).alias("batch_id"))


_H8_SQL = (W("history") + ", bs AS (SELECT batch_id, count(*) AS total, count_if(verdict = 'safe') AS safe, "
           "count_if(verdict = 'suspect') AS suspect, count_if(verdict = 'fraud') AS fraud FROM history "
           "WHERE batch_id IS NOT NULL GROUP BY batch_id) ")


@query("batch_summary", "H8", _H8_SQL + "SELECT * FROM bs")
def q_batch_summary(spark, d):
    h = clean.batch_rows(fx.history(spark, d))
    return S.batch_summary(h, ["batch_id"])


@query("batch_flag", "H9",
       _H8_SQL + "SELECT *, fraud > 0 AS has_fraud, CASE WHEN fraud > 0 THEN printf('Detected %d fraudulent of %d transactions', "
       "fraud, total) ELSE printf('All %d transactions look safe', total) END AS message FROM bs")
def q_batch_flag(spark, d):
    h = clean.batch_rows(fx.history(spark, d))
    return S.batch_flag(S.batch_summary(h, ["batch_id"]))


_LINES_SQL = (
    "ln AS (SELECT r.file, r.row_no - h.header_row AS line_no, coalesce(r.cells[1], '') AS date, "
    "coalesce(r.cells[2], '') AS time, coalesce(r.cells[3], '') AS description, coalesce(r.cells[6], '') AS amount_display "
    "FROM sheet_rows r JOIN (SELECT file, min(row_no) AS header_row FROM sheet_rows WHERE len(list_filter(cells, "
    "lambda x: lower(trim(x)) IN (" + ", ".join(f"'{m}'" for m in C.STATEMENT_HEADER_MARKERS) + "))) > 0 GROUP BY file) h "
    "ON r.file = h.file WHERE r.row_no > h.header_row)")
_TECH_ROWS_SQL = (
    "te AS (SELECT file, line_no, CAST(TRY_CAST(split_part(time, ':', 1) AS INTEGER) * 3600 + "
    "TRY_CAST(split_part(time, ':', 2) AS INTEGER) * 60 AS DOUBLE) AS \"Time\", "
    f"round(abs(TRY_CAST(regexp_replace(amount_display, '[^0-9.-]', '', 'g') AS DOUBLE)) / {C.VND_PER_USD}, 2) AS Amount, "
    "lpad(CAST(TRY_CAST(split_part(time, ':', 1) AS INTEGER) AS VARCHAR), 2, '0') || ':' || "
    "lpad(CAST(TRY_CAST(split_part(time, ':', 2) AS INTEGER) AS VARCHAR), 2, '0') AS hhmm FROM ln)")


@query("statement_to_technical", "K4", W("sheet_rows") + ", " + _LINES_SQL + ", " + _TECH_ROWS_SQL + " SELECT * FROM te")
def q_stmt_tech(spark, d):
    return synth.statement_to_technical(clean.statement_columns(clean.statement_body(fx.sheet_rows(spark, d))))


@query("attach_statement", "H6",
       W("sheet_rows") + ", " + _LINES_SQL + ", " + _TECH_ROWS_SQL + ", sc AS (SELECT te.*, "
       + sql_md5_uniform(C.SEED, "file", "line_no") + " AS fraud_prob FROM te) "
       "SELECT sc.file, sc.line_no, sc.fraud_prob, ln.date, ln.time, ln.description, ln.amount_display "
       "FROM sc LEFT JOIN ln ON sc.file = ln.file AND sc.line_no = ln.line_no")
def q_attach(spark, d):
    from ..functions.rand import md5_uniform
    lines = clean.statement_columns(clean.statement_body(fx.sheet_rows(spark, d)))
    tech = synth.statement_to_technical(lines)
    scored = tech.select("file", "line_no", md5_uniform(C.SEED, F.col("file"), F.col("line_no")).alias("fraud_prob"))
    return (scored.join(lines, ["file", "line_no"], "left")
                  .select("file", "line_no", "fraud_prob", "date", "time", "description", "amount_display"))


# ================================================================ I history reports
def _local(expr, minutes=False):
    fmt = "%Y-%m-%d %H:%M" if minutes else "%Y-%m-%d %H:%M:%S"
    return f"strftime({expr} + INTERVAL {C.LOCAL_OFFSET_HOURS} HOUR, '{fmt}')"


_RECENT_SQL = (W("history") + ", top AS (SELECT * FROM history WHERE batch_id IS NULL "
               "ORDER BY \"timestamp\" DESC, id DESC LIMIT 50) ")


@query("recent_history", "I1 B13 B14",
       _RECENT_SQL + "SELECT id, " + _local('"timestamp"') + " AS \"timestamp\", amount, verdict, probability, model_used FROM top")
def q_recent(spark, d):
    return hist.recent_history(fx.history(spark, d))


@query("reverse_index", "I12",
       _RECENT_SQL + "SELECT id, CAST(count(*) OVER () - row_number() OVER (ORDER BY \"timestamp\" DESC, id DESC) + 1 AS BIGINT) "
       "AS display_no FROM top")
def q_reverse(spark, d):
    top = hist.recent_history(fx.history(spark, d))
    raw = fx.history(spark, d).select("id", F.col("timestamp").alias("_ts"))
    j = top.join(raw, "id")
    return hist.reverse_index(j, [F.desc("_ts"), F.desc("id")]).select("id", F.col("display_no").cast("long"))


_UNPACK_SQL = ", ".join(f"coalesce(TRY_CAST(json_extract(v_features, '$.{v}') AS DOUBLE), 0.0) AS {v}" for v in C.V_COLS)


@query("history_items", "I2 B17",
       W("history") + "SELECT id, time_val AS \"Time\", amount AS Amount, " + _UNPACK_SQL
       + ", prediction, probability, verdict, model_used FROM history")
def q_items(spark, d):
    h = fx.history(spark, d)
    return h.select("id", F.col("time_val").alias("Time"), F.col("amount").alias("Amount"),
                    *clean.unpack_features(F.col("v_features")), "prediction", "probability", "verdict", "model_used")


@query("context_lines", "I3",
       W("history") + ", top AS (SELECT *, row_number() OVER (ORDER BY \"timestamp\" DESC, id DESC) AS pos FROM history "
       "WHERE batch_id IS NULL ORDER BY \"timestamp\" DESC, id DESC LIMIT 20) "
       "SELECT CAST(pos AS INTEGER) AS pos, id, printf('- %s: %.2f$ [%s] -> %s (%.1f%%)', CAST(\"timestamp\" AS VARCHAR), "
       "amount, model_used, verdict, probability * 100.0) AS line FROM top WHERE pos <= 10")
def q_ctx_lines(spark, d):
    return hist.context_lines(fx.history(spark, d))


@query("context_stats", "I4",
       W("history") + "SELECT " + sql_sig_round("coalesce(avg(CASE WHEN verdict = 'safe' THEN amount END), 0.0)")
       + " AS avg_safe_amount, count_if(verdict = 'safe') AS safe_count, count_if(verdict = 'fraud') AS fraud_count "
       "FROM history WHERE batch_id IS NULL")
def q_ctx_stats(spark, d):
    s = hist.context_stats(fx.history(spark, d))
    return s.select(_sr("avg_safe_amount"), "safe_count", "fraud_count")


@query("batch_meta", "I6",
       W("history") + "SELECT batch_id, min_by(customer_name, id) AS customer_name, min_by(bank_name, id) AS bank_name, "
       "min_by(model_used, id) AS model_used FROM history WHERE batch_id IS NOT NULL AND batch_id <> '' GROUP BY batch_id")
def q_batch_meta(spark, d):
    return hist.batch_meta(fx.history(spark, d))


@query("batch_counts", "I7",
       W("history") + "SELECT batch_id, count(*) AS total, coalesce(sum(CASE WHEN verdict = 'fraud' THEN 1 ELSE 0 END), 0) AS fraud, "
       "coalesce(sum(CASE WHEN verdict = 'suspect' THEN 1 ELSE 0 END), 0) AS suspect FROM history "
       "WHERE batch_id IS NOT NULL AND batch_id <> '' GROUP BY batch_id")
def q_batch_counts(spark, d):
    return hist.batch_counts(fx.history(spark, d))


@query("batch_risky", "I8",
       W("history") + "SELECT batch_id, id, time_val AS time_sec, amount AS amount_vnd, verdict, "
       "printf('%.1f%%', probability * 100.0) AS confidence, tx_description AS description FROM history "
       "WHERE batch_id IS NOT NULL AND batch_id <> '' AND verdict <> 'safe'")
def q_batch_risky(spark, d):
    return hist.batch_risky(fx.history(spark, d))


@query("batch_context_items", "I9",
       W("history") + "SELECT batch_id, CAST(row_number() OVER (PARTITION BY batch_id ORDER BY time_val, id) AS INTEGER) AS pos, "
       "time_val AS time, amount, verdict, tx_description AS \"desc\" FROM history WHERE batch_id IS NOT NULL")
def q_ctx_items(spark, d):
    j = hist.batch_context_json(fx.history(spark, d))
    items = F.from_json("context_json", "array<struct<time:double,amount:double,verdict:string,desc:string>>")
    return j.select("batch_id", F.posexplode(items).alias("pos", "t")).select(
        "batch_id", (F.col("pos") + 1).cast("int").alias("pos"), "t.time", "t.amount", "t.verdict", "t.desc")


@query("batch_context_fragments", "I9",
       W("history") + ", n AS (SELECT *, row_number() OVER (PARTITION BY batch_id ORDER BY time_val, id) AS pos FROM history WHERE batch_id IS NOT NULL) "
       "SELECT batch_id, CAST(pos AS INTEGER) AS pos, (pos - 1) // 20 AS fragment, time_val AS time, amount, verdict, tx_description AS \"desc\" FROM n")
def q_fragments(spark, d):
    """Rows of each batch read back, in order, from JSON fragments of twenty rows on file."""
    path = shared_dir(spark, f"contexts/{uuid.uuid4().hex}")
    hist.write_batch_contexts(fx.history(spark, d), path, rows=20)
    back = spark.read.schema("batch_id string, fragment long, n long, context_json string").json(path)
    items = F.from_json("context_json", "array<struct<time:double,amount:double,verdict:string,desc:string>>")
    return back.select("batch_id", "fragment", F.posexplode(items).alias("at", "t")).select(
        "batch_id", (F.col("fragment") * 20 + F.col("at") + 1).cast("int").alias("pos"), "fragment", "t.time", "t.amount", "t.verdict", "t.desc")


@query("batch_list", "I10 B12",
       W("history") + ", g AS (SELECT batch_id, customer_name, bank_name, model_used, count(*) AS total, "
       "sum(CASE WHEN verdict = 'safe' THEN 1 ELSE 0 END) AS safe, sum(CASE WHEN verdict = 'fraud' THEN 1 ELSE 0 END) AS fraud, "
       "min(\"timestamp\") AS first FROM history WHERE batch_id IS NOT NULL AND batch_id <> '' "
       "GROUP BY batch_id, customer_name, bank_name, model_used ORDER BY first DESC, batch_id, model_used LIMIT 50) "
       "SELECT batch_id, coalesce(nullif(customer_name, ''), '') AS customer_name, coalesce(nullif(bank_name, ''), '') AS bank_name, "
       "coalesce(nullif(model_used, ''), '') AS model_used, total, safe, fraud, " + _local("first", True) + " AS imported_at FROM g")
def q_batch_list(spark, d):
    return hist.batch_list(fx.history(spark, d))


@query("batch_detail", "I11 B12 B17",
       W("history") + "SELECT batch_id, id, CAST(\"timestamp\" AS VARCHAR) AS \"timestamp\", amount, verdict, probability, model_used, "
       "coalesce(nullif(tx_description, ''), '') AS description, coalesce(nullif(customer_name, ''), '') AS customer_name, "
       "coalesce(nullif(bank_name, ''), '') AS bank_name, coalesce(time_val, 0.0) AS time_val, " + _UNPACK_SQL
       + f", coalesce(nullif(model_id, ''), '{C.DEFAULT_MODEL_ID}') AS model_id FROM history "
       "WHERE batch_id IS NOT NULL AND batch_id <> ''")
def q_batch_detail(spark, d):
    return hist.batch_detail(fx.history(spark, d))


# ================================================================ K synthetic tables
def _sql_u(name, idc):
    return sql_md5_uniform(C.SEED, f"'{name}'", idc)


@query("gen_safe", "K1",
       "SELECT o_orderkey AS id, round(" + _sql_u("Time", "o_orderkey") + f" * {C.SAFE_TIME_MAX}, 0) AS \"Time\", "
       + ", ".join(f"round(({_sql_u(v, 'o_orderkey')} * 2.0 - 1.0) * {C.SAFE_V_HALF_WIDTH}, 6) AS {v}" for v in C.V_COLS)
       + f", round({C.SAFE_AMOUNT[0]} + {_sql_u('Amount', 'o_orderkey')} * {C.SAFE_AMOUNT[1] - C.SAFE_AMOUNT[0]}, 2) AS Amount, "
       "0 AS Class FROM orders")
def q_gen_safe(spark, d):
    return synth.gen_safe(fx.table(spark, d, "orders"), "o_orderkey")


def _sql_fraud_v(v):
    u = _sql_u(v, "c_custkey")
    if v in C.FRAUD_DRIVERS:
        return f"round({C.FRAUD_DRIVERS[v]} + ({u} * 2.0 - 1.0), 6) AS {v}"
    return f"round(({u} * 2.0 - 1.0) * {C.FRAUD_OTHER_V_HALF_WIDTH}, 6) AS {v}"


@query("gen_fraud", "K2",
       "SELECT c_custkey AS id, round(" + _sql_u("Time", "c_custkey") + f" * {C.FRAUD_TIME_MAX}, 0) AS \"Time\", "
       + ", ".join(_sql_fraud_v(v) for v in C.V_COLS)
       + f", round({C.FRAUD_AMOUNT[0]} + {_sql_u('Amount', 'c_custkey')} * {C.FRAUD_AMOUNT[1] - C.FRAUD_AMOUNT[0]}, 2) AS Amount, "
       "1 AS Class FROM customer")
def q_gen_fraud(spark, d):
    return synth.gen_fraud(fx.table(spark, d, "customer"), "c_custkey")


@query("running_balance", "K3",
       W("statement") + "SELECT account, seq, tx_date, amount_vnd, start_balance, "
       + sql_sig_round("start_balance + sum(amount_vnd) OVER (PARTITION BY account ORDER BY tx_date, seq "
                       "ROWS UNBOUNDED PRECEDING)") + " AS balance FROM statement")
def q_balance(spark, d):
    b = synth.running_balance(fx.statement(spark, d))
    return b.select("account", "seq", "tx_date", "amount_vnd", "start_balance", _sr("balance"))
