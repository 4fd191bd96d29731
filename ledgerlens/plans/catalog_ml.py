"""Checked queries of the k-NN, SMOTE and model layers (C6, C7, D, F, M).

The SQL side of the k-NN queries is brute force (every pair ranked), which
DuckDB runs comfortably on the check fixture; the Spark side is the banded
exact join of ``operators.knn``.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from .. import config as C
from ..functions.numeric import sig_round, sql_sig_round
from ..functions.rand import sql_md5_uniform
from ..operators import fitcheck, knn, metrics as M, models, prep, tuning
from ..session import reliable, spread
from ..sources import fixtures as fx
from .catalog import U_ID, _sql_alloc, _sql_ranked
from .registry import query

W = fx.sql_with
K = 5


def _q(c):
    return f'"{c}"' if c == "Time" else c


def _sql_dist(a: str, b: str, metric: str = "euclidean") -> str:
    if metric == "manhattan":
        return "(CAST(0 AS DOUBLE)" + "".join(f" + abs({a}.{_q(c)} - {b}.{_q(c)})" for c in C.FEATURES) + ")"
    terms = "".join(f" + ({a}.{_q(c)} - {b}.{_q(c)}) * ({a}.{_q(c)} - {b}.{_q(c)})" for c in C.FEATURES)
    return f"sqrt(CAST(0 AS DOUBLE){terms})"


def _sql_knn(qsrc: str, bsrc: str, k: int, metric: str = "euclidean", exclude_self: bool = False) -> str:
    self_cond = "WHERE q.id <> b.id" if exclude_self else ""
    return (f"SELECT q_id, b_id, dist, CAST(rnk AS INTEGER) AS rank FROM (SELECT *, row_number() OVER "
            f"(PARTITION BY q_id ORDER BY dist, b_id) AS rnk FROM (SELECT q.id AS q_id, b.id AS b_id, "
            f"{_sql_dist('q', 'b', metric)} AS dist FROM {qsrc} q, {bsrc} b {self_cond})) WHERE rnk <= {k}")


@query("knn_join", "C7",
       W("tx") + "SELECT q_id, b_id, " + sql_sig_round("dist") + " AS dist, rank FROM ("
       + _sql_knn("tx", "(SELECT * FROM tx WHERE Class = 0)", K) + ")")
def q_knn(spark, d):
    t = fx.tx(spark, d)
    r = knn.knn_join(t, t.where(F.col("Class") == 0), K)
    return r.select("q_id", "b_id", sig_round(F.col("dist")).alias("dist"), "rank")


@query("knn_join_manhattan", "C7",
       W("tx") + "SELECT q_id, b_id, " + sql_sig_round("dist") + " AS dist, rank FROM ("
       + _sql_knn("(SELECT * FROM tx WHERE Class = 1)", "(SELECT * FROM tx WHERE Class = 1)", K, "manhattan", True)
       + ")")
def q_knn_l1(spark, d):
    m = fx.tx(spark, d).where(F.col("Class") == 1)
    r = knn.knn_join(m, m, K, metric="manhattan", exclude_self=True)
    return r.select("q_id", "b_id", sig_round(F.col("dist")).alias("dist"), "rank")


def _sql_smote() -> str:
    feats = ", ".join(
        sql_sig_round(f"x.{_q(c)} + g.gap * (n.{_q(c)} - x.{_q(c)})") + f" AS {_q(c)}" for c in C.FEATURES)
    return (
        W("tx") + ", mino AS (SELECT * FROM tx WHERE Class = 1), "
        "cnt AS (SELECT (SELECT count(*) FROM tx WHERE Class = 0) - (SELECT count(*) FROM mino) AS n_new, "
        "(SELECT count(*) FROM mino) AS n_min), "
        f"kk AS (SELECT {K} AS kk), "
        f"rk AS (SELECT id, row_number() OVER (ORDER BY {U_ID}, id) AS base_rank FROM mino), "
        "nn AS (" + _sql_knn("mino", "mino", "(SELECT kk FROM kk)", "euclidean", True).replace(
            f"rnk <= (SELECT kk FROM kk)", "rnk <= (SELECT kk FROM kk)") + "), "
        "dr AS (SELECT i, CAST(floor(" + sql_md5_uniform(C.SEED, "'base'", "i") + " * (SELECT n_min FROM cnt)) + 1 AS BIGINT) AS base_rank, "
        "CAST(floor(" + sql_md5_uniform(C.SEED, "'nn'", "i") + " * (SELECT kk FROM kk)) + 1 AS INTEGER) AS nn_rank, "
        + sql_md5_uniform(C.SEED, "'gap'", "i") + " AS gap FROM (SELECT unnest(range(0, (SELECT n_new FROM cnt))) AS i)), "
        "g AS (SELECT dr.i, dr.gap, rk.id AS base_id, nn.b_id AS nn_id FROM dr JOIN rk USING (base_rank) "
        "JOIN nn ON nn.q_id = rk.id AND nn.rank = dr.nn_rank) "
        f"SELECT -1 - g.i AS id, {feats}, 1 AS Class FROM g JOIN mino x ON x.id = g.base_id JOIN mino n ON n.id = g.nn_id")


@query("smote", "C6 C8", _sql_smote())
def q_smote(spark, d):
    t = fx.tx(spark, d)
    s = knn.smote(t, k=K, synthetic_only=True)
    return s.select("id", *[sig_round(F.col(c)).alias(c) for c in C.FEATURES], F.col("Class"))


@query("smote_class_counts", "C6 C10",
       W("tx") + "SELECT Class, CASE WHEN Class = 1 THEN (SELECT count(*) FROM tx WHERE Class = 0) ELSE count(*) END "
       "AS rows FROM tx GROUP BY Class")
def q_smote_counts(spark, d):
    s = prep.resample(fx.tx(spark, d), "smote")
    return s.groupBy("Class").agg(F.count(F.lit(1)).alias("rows"))


_SPLIT = (", " + _sql_alloc("tx", f"floor({1.0 - C.TEST_SIZE!r}::DOUBLE * tot)", "n_train") + ", " + _sql_ranked("tx")
          + ", sp AS (SELECT rk.*, rk.rnk <= a.n - a.n_train AS is_test FROM rk JOIN alloc a USING (Class)), "
          "tr AS (SELECT * FROM sp WHERE NOT is_test), te AS (SELECT * FROM sp WHERE is_test)")


@query("knn_classifier", "D4 D8",
       W("tx") + _SPLIT + ", nb AS (" + _sql_knn("te", "tr", K) + ") "
       "SELECT nb.q_id AS id, avg(CAST(tr.Class = 1 AS DOUBLE)) AS p, "
       "CAST(avg(CAST(tr.Class = 1 AS DOUBLE)) > 0.5 AS INTEGER) AS prediction "
       "FROM nb JOIN tr ON tr.id = nb.b_id GROUP BY nb.q_id")
def q_knn_clf(spark, d):
    sp = prep.stratified_split(fx.tx(spark, d))
    train, test = sp.where(~F.col("is_test")), sp.where("is_test")
    model = knn.KNNClassifier(k=K).fit(train)
    return model.transform(test).select("id", "p", "prediction")


@query("knn_classifier_distance_votes", "D4",
       W("tx") + _SPLIT + ", nb AS (" + _sql_knn("te", "tr", 3, "manhattan") + "), "
       "wv AS (SELECT nb.q_id, tr.Class, CASE WHEN max(CAST(nb.dist = 0 AS INTEGER)) OVER (PARTITION BY nb.q_id) = 1 "
       "THEN CAST(nb.dist = 0 AS DOUBLE) ELSE 1.0 / nb.dist END AS w FROM nb JOIN tr ON tr.id = nb.b_id) "
       "SELECT q_id AS id, " + sql_sig_round("sum(w * CAST(Class = 1 AS DOUBLE)) / sum(w)") + " AS p "
       "FROM wv GROUP BY q_id")
def q_knn_clf_d(spark, d):
    sp = prep.stratified_split(fx.tx(spark, d))
    train, test = sp.where(~F.col("is_test")), sp.where("is_test")
    model = knn.KNNClassifier(k=3, weights="distance", metric="manhattan").fit(train)
    return model.transform(test).select("id", sig_round(F.col("p")).alias("p"))


def _sql_space(model: str, n: int = C.N_TRIALS) -> str:
    import json
    import math as m
    parts, vals = [], {}
    for name, kind, spec in tuning.SPACE[model]:
        u = sql_md5_uniform(C.SEED, f"'{model}'", f"'{name}'", "trial")

        def draw(kind, spec):
            if kind == "int_step":
                lo, hi, step = spec
                nn = (hi - lo) // step + 1
                return f"printf('%d', CAST({lo} + {step} * floor({u} * {nn}) AS BIGINT))"
            if kind == "float_log":
                lo, hi = spec
                return f"printf('%.6f', exp({m.log(lo)!r} + {u} * {m.log(hi) - m.log(lo)!r}))"
            if kind == "float":
                lo, hi = spec
                return f"printf('%.6f', {lo!r} + {u} * {hi - lo!r})"
            opts = "[" + ", ".join("'" + json.dumps(o) + "'" for o in spec) + "]"
            return f"list_extract({opts}, CAST(floor({u} * {len(spec)}) AS INTEGER) + 1)"
        if kind.endswith("_if"):
            dep, want, inner = spec
            v = f"CASE WHEN {vals[dep]} = '{json.dumps(want)}' THEN {draw('choice' if kind == 'choice_if' else 'int_step', inner)} END"
        else:
            v = draw(kind, spec)
        vals[name] = v
        parts.append(f"SELECT '{model}' AS model, trial, '{name}' AS param, {v} AS value FROM range({n}) t(trial)")
    return "SELECT * FROM (" + " UNION ALL ".join(parts) + ") WHERE value IS NOT NULL"


@query("search_space", "F3",
       " UNION ALL ".join(f"({_sql_space(mn)})" for mn in C.MODEL_NAMES))
def q_space(spark, d):
    out = None
    for mn in C.MODEL_NAMES:
        s = tuning.search_space(spark, mn)
        out = s if out is None else out.unionByName(s)
    return out


# ---- fitted models: SQL knows the rows, and what must hold of each prediction ------

def _prepared(spark, d):
    from .jobs import prepared
    return prepared(spark, fx.tx(spark, d))


_FIT_SQL = W("tx") + _SPLIT + " SELECT id, Class, TRUE AS p_in_range, TRUE AS agrees, TRUE AS learned FROM te"


def _fit_and_score(spark, d, name, params=None):
    """Held-out rows: whether p is a probability and the label follows from it, and
    whether the model learned its training rows, which no constant answer does."""
    train, test, _ = _prepared(spark, d)
    f = models.train_model(models.make_model(name, params), train)
    p, label = F.col("p"), F.col("prediction")
    # an SVM's label follows its margin, its probability a monotone function of that
    follows = label.isin(0, 1) if name == "svm" else (label == 1) == (p > 0.5)
    return f.predict(test).select("id", "Class", p.between(0, 1).alias("p_in_range"), follows.alias("agrees"),
                                  F.lit(fitcheck.learned(f, train)).alias("learned"))


@query("random_forest_scores", "D1 D2 D7 D8", _FIT_SQL)
def q_rf(spark, d):
    return _fit_and_score(spark, d, "random_forest")


@query("logistic_regression_scores", "D3 D7 D8", _FIT_SQL)
def q_lr(spark, d):
    return _fit_and_score(spark, d, "logistic_regression")


@query("svm_scores", "D5 D6 D8", _FIT_SQL)
def q_svm(spark, d):
    return _fit_and_score(spark, d, "svm")


@query("svm_poly_scores", "D5 D6", _FIT_SQL)
def q_svm_poly(spark, d):
    return _fit_and_score(spark, d, "svm", {"kernel": "poly", "degree": 2, "C": 0.5})


@query("reloaded_models", "A15 A16 M4",
       W("tx") + _SPLIT + " SELECT m.model, te.id, TRUE AS same FROM te, (VALUES "
       + ", ".join(f"('{m}')" for m in C.MODEL_NAMES) + ") m(model)")
def q_reloaded(spark, d):
    """Every model predicts the same after it was saved and loaded."""
    import uuid
    from ..session import shared_dir
    train, test, _ = _prepared(spark, d)
    out, root = None, shared_dir(spark, f"io/reloaded-{uuid.uuid4().hex[:8]}")
    for name in C.MODEL_NAMES:
        f = models.train_model(models.make_model(name), train)
        models.save_model(f, f"{root}/{name}")
        g = models.load_model(models.make_model(name), f"{root}/{name}")
        before = f.predict(test).select("id", F.col("p").alias("p0"), F.col("prediction").alias("y0"))
        after = g.predict(test).select("id", "p", "prediction")
        both = before.join(after, "id").select(F.lit(name).alias("model"), "id",
                                               ((F.abs(F.col("p") - F.col("p0")) < 1e-9) & (F.col("prediction") == F.col("y0"))).alias("same"))
        out = both if out is None else out.unionByName(both)
    return out


@query("feature_importance", "D9 D10 A6",
       "SELECT feature, TRUE AS not_negative, TRUE AS sums_to_one, TRUE AS as_splits FROM (VALUES " + ", ".join(f"('{c}')" for c in C.FEATURES) + ") f(feature)")
def q_importance(spark, d):
    """Importances of the forest, and whether the gains of its saved splits add up to them."""
    import uuid
    from ..session import shared_dir
    train, _, _ = _prepared(spark, d)
    f = models.train_model("random_forest", train)
    gains = fitcheck.split_gains(f, shared_dir(spark, f"io/splits-{uuid.uuid4().hex[:8]}")).withColumnRenamed("importance", "gain")
    top = models.top_importance(models.feature_importance(f), len(C.FEATURES)).join(gains, "feature")
    total = F.sum("importance").over(Window.partitionBy())          # 30 rows
    return top.select("feature", (F.col("importance") >= 0).alias("not_negative"), (F.abs(total - 1) < 1e-6).alias("sums_to_one"),
                      (F.abs(F.col("importance") - F.col("gain")) < 1e-6).alias("as_splits"))


def _grid_sql(models_, samplings):
    return ("SELECT m.model, s.sampling, TRUE AS in_range, TRUE AS recomputed FROM (VALUES "
            + ", ".join(f"('{C.DISPLAY_NAMES[m]}')" for m in models_) + ") m(model), (VALUES "
            + ", ".join(f"('{s}')" for s in samplings) + ") s(sampling)")


def checked_grid(table, scored=None):
    """Rows of a comparison table, whether its metrics are shares, and whether
    accuracy, recall and precision are what the scored rows give."""
    cols = ["accuracy", "precision", "recall", "f1_score", "auc_roc", "auc_pr"]
    ok = F.lit(True)
    for c in cols:
        ok = ok & F.col(c).between(0, 1)
    if scored is None:
        p, r = F.col("precision"), F.col("recall")
        f1 = F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0)
        return table.select("model", "sampling", ok.alias("in_range"), (F.abs(F.col("f1_score") - f1) < 2e-4).alias("recomputed"))
    from ..operators.clean import display_name
    hit, flagged, fraud = F.col("prediction") == F.col("Class"), F.col("prediction") == 1, F.col("Class") == 1
    again = scored.groupBy(display_name(F.col("model")).alias("model"), "sampling").agg(
        F.avg(hit.cast("double")).alias("_a"), F.coalesce(F.avg(F.when(fraud, flagged.cast("double"))), F.lit(0.0)).alias("_r"),
        F.coalesce(F.avg(F.when(flagged, fraud.cast("double"))), F.lit(0.0)).alias("_p"))
    near = lambda a, b: F.abs(F.col(a) - F.col(b)) <= 5.1e-5
    return table.join(again, ["model", "sampling"]).select("model", "sampling", ok.alias("in_range"),
                                                           (near("accuracy", "_a") & near("recall", "_r") & near("precision", "_p")).alias("recomputed"))


@query("model_comparison_smote", "M3 E8 E9", _grid_sql(C.MODEL_NAMES, ["smote"]))
def q_comparison(spark, d):
    from .jobs import comparison, run_models
    train, test, _ = _prepared(spark, d)
    res = spread(prep.resample(train, "smote"))
    scored, _ = run_models(res, test, C.MODEL_NAMES, "smote")
    return checked_grid(comparison(scored), scored)


@query("cv_f1", "F1 F2")
def q_cv(spark, d):
    """Mean F1 over five folds of each family with its defaults (tested against
    brute force and against fits one by one on small tables)."""
    folded = spread(prep.stratified_folds(fx.tx(spark, d)))
    rows = [(m, float(tuning.SHARED[m](folded, {0: {}})[0])) for m in C.MODEL_NAMES]
    return spark.createDataFrame(rows, "model string, cv_f1 double")


@query("tune_knn", "F4 F5 E15")
def q_tune(spark, d):
    best = tuning.tune_all(fx.tx(spark, d), ["knn"])
    return tuning.tuning_summary(best, spark)


# ---- J attribution --------------------------------------------------------------
from ..operators import explain  # noqa: E402

_W = explain.rule_weights()
_W_SQL = "(VALUES " + ", ".join(f"('{c}', {w!r})" for c, w in _W.items()) + ") wt(feature, w)"
_ATTR_SQL = (W("tx") + ", lv AS (SELECT id, feature, value FROM (UNPIVOT (SELECT id, " + ", ".join(_q(c) for c in C.FEATURES)
             + " FROM tx) ON " + ", ".join(_q(c) for c in C.FEATURES) + " INTO NAME feature VALUE value)), "
             f"attr AS (SELECT lv.id, lv.feature, lv.value * wt.w AS shap, 0.0 AS base FROM lv JOIN {_W_SQL} USING (feature)), "
             "rk AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY abs(shap) DESC, feature) AS rank FROM attr) ")


def _linear_attr(spark, d):
    t = fx.tx(spark, d)
    return explain.shapley(t, explain.LinearScore(_W))


@query("shapley_additivity", "J1", W("tx") + _SPLIT + " SELECT id, TRUE AS additive FROM te")
def q_shap_add(spark, d):
    sp = prep.stratified_split(fx.tx(spark, d))
    train, test = sp.where(~F.col("is_test")), sp.where("is_test")
    f = models.train_model("logistic_regression", train)
    a = explain.shapley(test, f)
    return a.groupBy("id").agg(F.sum("shap").alias("sum_shap"), F.first("fx").alias("fx"), F.first("base").alias("base")) \
            .select("id", (F.abs(F.col("sum_shap") - (F.col("fx") - F.col("base"))) < 1e-9).alias("additive"))


@query("top_features", "J1 J2",
       _ATTR_SQL + "SELECT id, CAST(rank AS INTEGER) AS rank, feature, round(shap, 4) AS shap, "
       "CASE WHEN shap > 0 THEN 'raise risk' ELSE 'lower risk' END AS direction FROM rk WHERE rank <= 5")
def q_top_features(spark, d):
    return explain.top_features(_linear_attr(spark, d))


@query("waterfall", "J3",
       _ATTR_SQL + ", g AS (SELECT id, CASE WHEN rank < 10 THEN rank ELSE 10 END AS bar, "
       "CASE WHEN rank < 10 THEN feature ELSE 'other' END AS label, shap FROM rk), "
       "b AS (SELECT id, CAST(bar AS INTEGER) AS bar, any_value(label) AS label, sum(shap) AS value FROM g GROUP BY id, bar) "
       "SELECT id, bar, label, " + sql_sig_round("value", 8) + " AS value, "
       + sql_sig_round("sum(value) OVER (PARTITION BY id ORDER BY bar ROWS UNBOUNDED PRECEDING) - value", 8) + " AS start, "
       + sql_sig_round("sum(value) OVER (PARTITION BY id ORDER BY bar ROWS UNBOUNDED PRECEDING)", 8) + " AS \"end\" FROM b")
def q_waterfall(spark, d):
    w = explain.waterfall(_linear_attr(spark, d))
    return w.select("id", "bar", "label", *[sig_round(F.col(c), 8).alias(c) for c in ("value", "start", "end")])


@query("attribution_text", "J4",
       _ATTR_SQL + "SELECT id, string_agg(printf('  - %s: SHAP = %+.4f (%s)', feature, round(shap, 4), "
       "CASE WHEN shap > 0 THEN 'raise risk' ELSE 'lower risk' END), chr(10) ORDER BY rank) AS text FROM rk "
       "WHERE rank <= 5 GROUP BY id")
def q_attr_text(spark, d):
    return explain.attribution_text(_linear_attr(spark, d))
