"""Composed jobs (M1-M7) and the flagship query.

Each job is one Spark job graph: the scaled and split table is cut from its
lineage once (``checkpoint`` into the cluster's checkpoint folder), the
resampled training rows are cut again, and every model of a run is trained
and scored from those two tables.
"""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import config as C
from ..operators import clean, metrics as M, models, prep, scoring as S
from ..session import cut_lineage, ensure_checkpoint_dir, reliable, spread
from ..sources import fixtures as fx
from ..sources import io

log = logging.getLogger(__name__)

# ---- fixed values: sampling labels written into comparison tables ------------
BASELINE_LABEL = "baseline (no sampling)"


def prepared(spark: SparkSession, df: DataFrame, seed: int = C.SEED, fit_scope: str = "all",
             scaler: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Scale (C1+C2) and split (C3).  Returns (train, test, scaler params).

    ``fit_scope='all'`` fits the scaler on every row before the split, as the
    original pipeline does (T4); ``'train'`` fits it on training rows only.
    """
    ensure_checkpoint_dir(spark)
    split = spread(prep.stratified_split(df, seed=seed))
    if scaler is None:
        basis = split if fit_scope == "all" else split.where(~F.col("is_test"))
        scaler = reliable(prep.fit_robust_scaler(basis))
    scaled = prep.apply_robust_scaler(split, scaler)
    return scaled.where(~F.col("is_test")).drop("is_test"), scaled.where("is_test").drop("is_test"), scaler


def run_models(train: DataFrame, test: DataFrame, names, sampling_label: str,
               params: dict | None = None, keep=()) -> tuple[DataFrame, dict]:
    """Fit each model on ``train`` and score ``test``: (long scored table, fitted).
    ``keep``: further columns of ``test`` that the table holds.  The evaluation reads the
    table several times, so it is written once and no model scores its rows again."""
    params = params or {}
    fitted, parts = {}, []
    for name in names:
        f = models.train_model(models.make_model(name, params.get(name)), train)
        log.info("trained %s (%s) in %.1fs", name, sampling_label, f.seconds)
        fitted[name] = f
        sc = f.predict(test).select("id", C.TARGET, "prediction", "p", *keep)
        parts.append(sc.withColumn("model", F.lit(name)).withColumn("sampling", F.lit(sampling_label)))
    scored = parts[0]
    for p in parts[1:]:
        scored = scored.unionByName(p)
    return reliable(scored), fitted


def comparison(scored: DataFrame) -> DataFrame:
    """E9 over a long scored table: one metrics row per (model, sampling), kept for those
    who write and return it."""
    t = M.evaluate(scored, by=["model", "sampling"])
    return reliable(t.withColumn("model", clean.display_name(F.col("model"))))


def baseline_job(spark: SparkSession, df: DataFrame, out_dir: str | None = None,
                 names=None) -> DataFrame:
    """M1: four models, default parameters, no resampling."""
    train, test, _ = prepared(spark, df)
    scored, _ = run_models(train, test, names or C.MODEL_NAMES, BASELINE_LABEL)
    table = comparison(scored)
    if out_dir:
        io.write_metrics(table, out_dir, "baseline")
    return table


def tuned_params(spark: SparkSession, out_dir: str) -> dict[str, dict]:
    """Parameters of the tuned record in ``out_dir``, by model; a model that was
    not tuned has none and is trained with its defaults."""
    rows = io.read_best_params(spark, out_dir).collect()  # one row per model
    tuned = {r["model"]: io.decode_params(r["params"]) for r in rows if r["params"]}
    for name in C.MODEL_NAMES:
        if name not in tuned:
            log.warning("no tuned parameters of %s in %s: defaults", name, out_dir)
    return tuned


def record_run(table: DataFrame, fitted: dict, scored: DataFrame, root: str, sampling: str) -> None:
    """The run's rows in the three run tables: a model's metrics, its feature
    importances, and every scored test row."""
    spark = table.sparkSession
    io.create_tables(spark, root)
    io.append_rows(io.metrics_rows(table), root, "model_metrics")
    for name, f in fitted.items():
        imp = models.feature_importance(f).withColumns({"model_name": F.lit(name), "sampling": F.lit(sampling)})
        if f.spec.name == "random_forest":
            io.append_rows(imp, root, "feature_importance")
    told = scored.select(F.col("model").alias("model_name"), F.to_json(F.struct(*C.FEATURES)).alias("features_json"), "prediction", F.col("p").alias("probability"))
    io.append_rows(told, root, "predictions_log")


def train_job(spark: SparkSession, df: DataFrame, sampling: str = "smote", names=None,
              out_dir: str | None = None, params: dict | None = None, tables: str | None = None) -> DataFrame:
    """M3: resample, train, evaluate, save, and add the run's rows to the run tables.

    Without ``params`` the tuned record in ``out_dir`` is used; models that have
    none there are trained with their defaults."""
    if params is None:
        params = tuned_params(spark, out_dir) if out_dir else {}
    train, test, scaler = prepared(spark, df)
    res = spread(prep.resample(train, sampling))
    scored, fitted = run_models(res, test, names or C.MODEL_NAMES, sampling, params, keep=C.FEATURES if tables else ())
    table = comparison(scored.drop(*C.FEATURES))
    if tables:
        record_run(table, fitted, scored, tables, sampling)
    if out_dir:
        io.save_scaler(scaler, out_dir)
        for name, f in fitted.items():
            models.save_model(f, f"{out_dir}/models/{name}_{sampling}")
            imp = models.feature_importance(f)
            if f.spec.name == "random_forest":
                io.write_feature_importance(imp, out_dir, name, sampling)
        io.write_metrics(table, out_dir, sampling)
    return table


def evaluate_job(spark: SparkSession, df: DataFrame, model_dir: str, sampling: str = "smote",
                 names=None) -> DataFrame:
    """M4: reuse the saved scaler and models on the test rows."""
    scaler = io.load_scaler(spark, model_dir)
    _, test, _ = prepared(spark, df, scaler=scaler)
    parts = []
    for name in names or C.MODEL_NAMES:
        f = models.load_model(models.make_model(name), f"{model_dir}/models/{name}_{sampling}")
        sc = f.predict(test).select("id", C.TARGET, "prediction", "p")
        parts.append(sc.withColumn("model", F.lit(name)).withColumn("sampling", F.lit(f"{sampling}_reeval")))
    scored = parts[0]
    for p in parts[1:]:
        scored = scored.unionByName(p)
    table = comparison(reliable(scored))
    io.write_metrics(table, model_dir, f"{sampling}_reeval")
    return table


def experiment_grid(spark: SparkSession, df: DataFrame, names=None) -> DataFrame:
    """M6: every model x {none, undersample, smote} on one split (E10 summary)."""
    train, test, _ = prepared(spark, df)
    tables = []
    for strategy, label in (("none", BASELINE_LABEL), ("undersample", "undersample"), ("smote", "smote")):
        res = prep.resample(train, strategy)
        res = spread(res) if strategy != "none" else res
        scored, _ = run_models(res, test, names or C.MODEL_NAMES, label)
        tables.append(comparison(scored))
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return M.technique_summary(out)


def tune_job(spark: SparkSession, df: DataFrame, sampling: str = "smote", names=None,
             n_trials: int = C.N_TRIALS, out_dir: str | None = None, trials: dict | None = None) -> DataFrame:
    """M2: resample the training rows and tune each model by CV F1; ``trials``
    takes the table of all trials of each model."""
    from ..operators import tuning
    train, _, _ = prepared(spark, df)
    res = spread(prep.resample(train, sampling))
    best = tuning.tune_all(res, names or C.MODEL_NAMES, n_trials=n_trials, trials=trials)
    if out_dir:
        io.write_best_params(best, out_dir)
    return best


def all_job(spark: SparkSession, df: DataFrame, out_dir: str, sampling: str = "smote",
            n_trials: int = C.N_TRIALS) -> DataFrame:
    """M5: baseline, then tune, then train with the tuned parameters, whose rows go
    to the run tables in ``<out_dir>/tables``."""
    baseline_job(spark, df, out_dir)
    tune_job(spark, df, sampling, n_trials=n_trials, out_dir=out_dir)
    return train_job(spark, df, sampling, out_dir=out_dir, tables=f"{out_dir}/tables")


def batch_import(spark: SparkSession, upload: DataFrame, model: "models.Fitted", scaler: DataFrame,
                 statement: DataFrame | None = None, batch_id: str | None = None, source: str | None = None,
                 align: str = "row", history: str | None = None, model_id: str = C.DEFAULT_MODEL_ID,
                 customer: str | None = None, bank: str | None = None) -> tuple[DataFrame, DataFrame]:
    """M7: check (B2), coerce (B3), scale (C2), score (D8, H2-H4), attach statement
    lines (H6) and append to the history table (A11); returns the scored rows and
    their summary (H8).

    Scored rows hold the source's ``Row``, ``row_no`` (1-based among valid rows),
    the raw ``time_val``, ``amount`` and ``v_features``, and ``probability``, the
    confidence in the verdict.  Statement lines (``line_no``, ...) join on ``Row``, or with
    ``align='survivor'`` on ``row_no``, as the original did.  ``source`` names the
    upload (a path with length and time of change); without it the batch id is new.
    """
    absent = [c for c in C.REQUIRED_UPLOAD if c not in upload.columns]
    if absent:
        raise ValueError(clean.missing_message(absent))
    # the parsed rows are read by the row-number passes and the scoring: they are cut from the
    # upload's lineage once, and rows are dropped after that, or each cell would be parsed for the filter as well
    valid = cut_lineage(clean.parse_numeric(upload), "upload").dropna(subset=C.REQUIRED_UPLOAD)
    valid = S.row_numbers(valid, "Row", "row_no").withColumns({
        "time_val": F.col("Time"), "amount_raw": F.col("Amount")})
    bid = batch_id or batch_id_of(source)
    scaled = prep.apply_robust_scaler(valid.withColumn("id", F.col("Row").cast("long")), scaler)
    scored = S.add_verdict(model.predict(scaled).withColumnRenamed("p", "fraud_prob"), "fraud_prob")
    name = F.lit(C.SERVING_MODELS.get(model_id, model_id))
    told = [
        "Row", "row_no", "time_val", F.col("amount_raw").alias("amount"), clean.pack_features(scored).alias("v_features"), F.col("prediction").cast("int").alias("prediction"),
        "fraud_prob", F.col("confidence").alias("probability"), "verdict", F.lit(bid).alias("batch_id"), F.lit(model_id).alias("model_id"),
        name.alias("model_used"), F.lit(customer).cast("string").alias("customer_name"), F.lit(bank).cast("string").alias("bank_name")]
    if statement is not None:
        # the join moves the features as numbers; their text, thrice as large, is made of the joined rows
        key = {"row": "Row", "survivor": "row_no"}[align]
        lines = statement.toDF(*[f"_statement{i}" for i in range(len(statement.columns))])
        line = F.col(f"_statement{statement.columns.index('line_no')}")
        scored = scored.join(lines, F.col(key).cast("long") == line.cast("long"), "left")
        told += [F.col(f"_statement{i}").alias(c) for i, c in enumerate(statement.columns) if c != "line_no"]
    scored = cut_lineage(scored.select(*told), "scored-batch")
    if history is not None:
        described = scored.withColumn("tx_description", F.col("description") if "description" in scored.columns else F.lit(None).cast("string"))
        io.append_history(described.withColumns({"id": F.xxhash64("batch_id", "Row"), "timestamp": F.current_timestamp()}), history)
    return scored, S.batch_summary(scored)


def batch_id_of(source: str | None) -> str:
    """H7 for a whole upload: from what tells the file apart, or fresh."""
    import hashlib
    import uuid
    return hashlib.md5(source.encode()).hexdigest()[:8] if source else uuid.uuid4().hex[:8]


def flagship_job(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scale, split, weight and fit a logistic regression on the transactions,
    score the held-out rows and summarise verdicts next to the test metrics."""
    t = fx.tx(spark, sf_dir)
    train, test, _ = prepared(spark, t)
    f = models.train_model("logistic_regression", train)
    scored = f.predict(test).withColumnRenamed("p", "fraud_prob")
    verdicts = S.add_verdict(scored, "fraud_prob")
    summary = S.batch_summary(verdicts).withColumn("_g", F.lit(0))
    m = M.evaluate(verdicts.withColumnRenamed("fraud_prob", "p")).withColumn("_g", F.lit(0))
    return summary.join(m, "_g").drop("_g")
