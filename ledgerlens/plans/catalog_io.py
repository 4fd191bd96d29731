"""Checked queries of the sources, sinks and history store
and the composed jobs (H5, M1-M7).

Sinks are checked by writing to the shared checkpoint folder and reading
back: what a sink wrote must equal what SQL computes from the inputs.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import config as C
from ..operators import clean, eda, history as hist, metrics as M, models, prep, scoring as S
from ..session import cut_lineage, reliable, shared_dir
from ..sources import fixtures as fx
from ..sources import io
from . import jobs, sheets
from .catalog_ml import _grid_sql, _q, _sql_space, checked_grid
from .catalog_reports import _COMP_SQL, _comparison
from .registry import query

W = fx.sql_with


def _scratch(spark, name):
    return shared_dir(spark, f"io/{name}-{uuid.uuid4().hex[:8]}")


@query("metrics_csv_roundtrip", "A5 A8", _COMP_SQL + "SELECT * FROM comp")
def q_metrics_csv(spark, d):
    out = _scratch(spark, "reports")
    table = _comparison(spark, d)
    for s in ("baseline (no sampling)", "undersample", "smote"):
        io.write_metrics(table.where(F.col("sampling") == s), out, s.split()[0])
    back = io.read_comparisons(spark, f"{out}/model_comparison_*.csv")
    return back.drop("source_file")


@query("metrics_table_load", "A9 A10",
       _COMP_SQL + "SELECT model AS model_name, sampling, accuracy, precision AS precision_score, recall, f1_score, "
       "auc_roc, auc_pr FROM comp")
def q_metrics_table(spark, d):
    out = _scratch(spark, "tables")
    csv = io.write_metrics(_comparison(spark, d), out, "smote_all")
    io.load_metrics_csv_into_table(spark, csv, out)
    return spark.read.parquet(f"{out}/model_metrics").drop("created_at")


def _biggest_batch_sql():
    return ("(SELECT batch_id FROM history WHERE batch_id IS NOT NULL GROUP BY batch_id "
            "ORDER BY count(*) DESC, batch_id LIMIT 1)")


@query("history_store", "A11 A12 A13 A14",
       W("history") + "SELECT batch_id, count(*) AS n FROM history WHERE (batch_id IS NULL OR batch_id <> "
       + _biggest_batch_sql() + ") AND id <> (SELECT max(id) FROM history WHERE batch_id IS NULL) GROUP BY batch_id")
def q_history_store(spark, d):
    path = _scratch(spark, "history")
    h = fx.history(spark, d)
    io.append_history(h, path)
    io.migrate_schema(spark, path)  # nothing missing: a no-op on a current table
    # delete the largest batch (ties: smallest id) and the newest single-scoring row
    big = (h.where(F.col("batch_id").isNotNull()).groupBy("batch_id").count()
            .orderBy(F.desc("count"), "batch_id").first()["batch_id"])
    newest = h.where(F.col("batch_id").isNull()).agg(F.max("id")).first()[0]
    assert io.delete_batch(spark, path, big) > 0
    assert io.delete_by_id(spark, path, newest) == 1
    back = io.read_history(spark, path)
    return back.groupBy("batch_id").agg(F.count(F.lit(1)).alias("n"))


_REG_SQL = ("(VALUES " + ", ".join(f"('{m}', '{n}', '{t}')" for m, n, t in io.MODEL_REGISTRY)
            + ") reg(model_id, name, description)")


@query("model_registry", "A17",
       W("history") + f"SELECT reg.model_id, reg.name, reg.description, reg.model_id = '{C.DEFAULT_MODEL_ID}' AS is_default "
       f"FROM {_REG_SQL} JOIN (SELECT DISTINCT model_id FROM history) h USING (model_id)")
def q_registry(spark, d):
    have = fx.history(spark, d).select("model_id")
    ok, _missing = io.model_registry(spark, have)
    return ok


@query("list_inputs", "A4", "SELECT * FROM (VALUES ('a.csv', TRUE), ('b.xlsx', TRUE)) v(name, sized)")
def q_list_inputs(spark, d):
    """Files of an upload folder; only .csv and .xlsx are listed."""
    out = _scratch(spark, "inputs")
    rows = fx.table(spark, d, "nation").select(F.to_json(F.struct("*")).alias("content"))
    data = rows.agg(F.concat_ws("\n", F.sort_array(F.collect_list("content")))).first()[0]      # 25 nations
    jvm = spark._jvm
    for name in ("a.csv", "b.xlsx", "c.txt"):
        p = jvm.org.apache.hadoop.fs.Path(f"{out}/{name}")
        stream = p.getFileSystem(spark._jsc.hadoopConfiguration()).create(p)
        stream.write(bytearray(data.encode()))
        stream.close()
    return io.list_inputs(spark, out).select("name", (F.col("size") == len(data.encode())).alias("sized"))


_BEST_SQL = " UNION ALL ".join(f"SELECT '{C.DISPLAY_NAMES[m]}' AS model, param, value FROM ({_sql_space(m, 1)})" for m in C.MODEL_NAMES)


@query("best_params_roundtrip", "A7 E15", _BEST_SQL)
def q_best_params(spark, d):
    """Every model's first trial, with its F1 from the comparison table, written,
    read and unpacked again."""
    from ..operators import tuning
    out = _scratch(spark, "params")
    comp = _comparison(spark, d).where(F.col("sampling") == "smote")
    f1 = {r["model"]: r["f1_score"] for r in comp.collect()}  # one row per model
    rows = [(m, float(f1.get(C.DISPLAY_NAMES[m], 0.0)), io.encode_params(tuning.trial_params(tuning.search_space(spark, m, 1))[0]))
            for m in C.MODEL_NAMES]
    io.write_best_params(spark.createDataFrame(rows, "model string, best_f1 double, params map<string,string>"), out)
    back = tuning.tuning_summary(io.read_best_params(spark, out), spark).where(~F.col("missing"))
    return back.select("model", F.explode(F.from_json("params", "map<string,string>")).alias("param", "value"))


@query("missing_columns", "B2",
       "SELECT * FROM (VALUES (1, 'Amount'), (2, 'V13')) v(position, \"column\")")
def q_missing(spark, d):
    up = fx.dirty_upload(spark, d).drop("V13", "Amount")
    return clean.missing_columns(spark, up).select(F.row_number().over(Window.orderBy("position")).alias("position"), "column")


@query("sort_metric", "E14",
       _COMP_SQL + "SELECT m.metric, c.model, c.sampling, row_number() OVER (PARTITION BY m.metric ORDER BY "
       "CASE m.metric WHEN 'recall' THEN c.recall WHEN 'f1_score' THEN c.f1_score ELSE c.auc_roc END, c.model, c.sampling) AS place "
       "FROM comp c, (VALUES ('recall'), ('f1_score'), ('auc_roc')) m(metric)")
def q_sort_metric(spark, d):
    """Place of each row when the table is sorted for the three charts."""
    table = reliable(_comparison(spark, d))
    out = None
    for m in ("recall", "f1_score", "auc_roc"):
        ordered = M.sort_metric(table, m).select(F.lit(m).alias("metric"), "model", "sampling", F.monotonically_increasing_id().alias("at"))
        ordered = ordered.withColumn("place", F.row_number().over(Window.partitionBy("metric").orderBy("at"))).drop("at")
        out = ordered if out is None else out.unionByName(ordered)
    return out


@query("csv_load", "A1 A2 B1 B5",
       W("tx") + "SELECT count(*) AS rows, sum(Class) AS frauds, round(100.0 * avg(Class), 3) AS fraud_pct, CAST(0 AS BIGINT) AS null_cells, "
       "30 AS n_features, count(*) AS n_targets FROM tx")
def q_csv_load(spark, d):
    """The transactions written as CSV, loaded with the fixed schema and checked."""
    out = _scratch(spark, "transactions.csv")
    fx.tx(spark, d).select("Time", *C.V_COLS, "Amount", "Class").write.option("header", True).csv(out)
    back = io.load_transactions(spark, out)
    x, y = clean.split_xy(back)
    return io.assert_loaded(back).withColumns({"n_features": F.lit(len(clean.feature_order(x).columns)), "n_targets": F.lit(y.count())})


@query("upload_csv", "A3 B3",
       W("dirty_upload") + "SELECT count(*) AS n_rows, count(DISTINCT \"Row\") AS n_ids FROM dirty_upload WHERE \"Row\" % 50 <> 0 OR Amount = ' 2.5 '")
def q_upload_csv(spark, d):
    """An upload with its columns in another order and one too many, as CSV."""
    out = _scratch(spark, "upload.csv")
    up = fx.dirty_upload(spark, d)
    up.select(F.lit("x").alias("note"), *reversed(up.columns)).write.option("header", True).option("ignoreLeadingWhiteSpace", False) \
        .option("ignoreTrailingWhiteSpace", False).csv(out)
    back = clean.coerce_numeric(io.read_upload(spark, out))
    return back.agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct("Row").alias("n_ids"))


@query("describe_export", "A18",
       W("tx") + "SELECT feature, TRUE AS same FROM (UNPIVOT (SELECT " + ", ".join(f'max({_q(c)}) AS {_q(c)}' for c in C.FEATURES)
       + " FROM tx) ON " + ", ".join(_q(c) for c in C.FEATURES) + " INTO NAME feature VALUE v)")
def q_describe_export(spark, d):
    summary = reliable(eda.describe(fx.tx(spark, d), C.FEATURES))
    path = io.export_describe(summary, _scratch(spark, "eda"))
    back = spark.read.option("header", True).schema(summary.schema).csv(path)
    return back.join(summary.select("feature", F.col("mean").alias("_m"), F.col("max").alias("_x")), "feature") \
        .select("feature", ((F.col("mean") == F.col("_m")) & (F.col("max") == F.col("_x"))).alias("same"))


@query("history_ids", "A11 A12 A13 B8",
       "SELECT c_custkey AS id, CASE c_custkey % 4 WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN lpad(CAST(c_custkey AS VARCHAR), 8, '0') "
       "ELSE 'b/' || c_custkey || '=x' END AS batch_id FROM customer WHERE c_custkey % 4 <> 3 OR c_custkey <> (SELECT max(c_custkey) FROM customer WHERE c_custkey % 4 = 3)")
def q_history_ids(spark, d):
    """Empty, null, all-digit and odd batch ids come back as they were; one batch
    with an id that a path would have to escape is deleted."""
    path = _scratch(spark, "history-ids")
    key = F.col("c_custkey")
    kind = F.pmod(key, F.lit(4))
    rows = fx.table(spark, d, "customer").select(
        key.alias("id"), F.timestamp_seconds(key * 5000).alias("timestamp"),
        F.when(kind == 0, F.lit(None)).when(kind == 1, F.lit("")).when(kind == 2, F.lpad(key.cast("string"), 8, "0"))
         .otherwise(F.concat(F.lit("b/"), key.cast("string"), F.lit("=x"))).alias("batch_id"))
    io.append_history(rows, path)
    io.migrate_schema(spark, path)
    last = rows.where(F.col("id") % 4 == 3).agg(F.max("id")).first()[0]
    assert last is None or io.delete_batch(spark, path, f"b/{last}=x") == 1
    return io.read_history(spark, path).select("id", "batch_id")


#: The history schema with a column more and a wider prediction.
WIDER_HISTORY = T.StructType([T.StructField("prediction", T.LongType()) if f.name == "prediction" else f for f in io.HISTORY_SCHEMA.fields]
                             + [T.StructField("note", T.StringType())])


@query("history_migration", "A11 A12",
       "SELECT c_custkey AS id, CASE WHEN c_custkey % 2 = 0 THEN c_custkey % 7 ELSE 1099511627776 + c_custkey END AS prediction, "
       "CASE WHEN c_custkey % 2 = 1 THEN c_mktsegment END AS note, CASE WHEN c_custkey % 2 = 0 THEN CAST(c_custkey % 7 AS INTEGER) END AS old_prediction FROM customer")
def q_history_migration(spark, d):
    """Rows of both parities of key, written before and after a column was added
    and a type widened, read by the new schema and by the old one."""
    path = _scratch(spark, "history-migration")
    key = F.col("c_custkey")
    rows = fx.table(spark, d, "customer").select(key.alias("id"), F.timestamp_seconds(key * 5000).alias("timestamp"), F.col("c_mktsegment").alias("note"))
    io.append_history(rows.where(F.col("id") % 2 == 0).withColumn("prediction", F.col("id") % 7).drop("note"), path)
    io.migrate_schema(spark, path, WIDER_HISTORY)
    io.append_history(rows.where(F.col("id") % 2 == 1).withColumn("prediction", F.lit(2 ** 40) + F.col("id")), path)
    new = io.read_history(spark, path, WIDER_HISTORY).select("id", "prediction", "note")
    return new.join(io.read_history(spark, path).select("id", F.col("prediction").alias("old_prediction")), "id")


_CTX_SQL = (W("history") + ", st AS (SELECT count_if(verdict = 'safe') AS safe_count, "
            "coalesce(avg(CASE WHEN verdict = 'safe' THEN amount END), 0.0) AS avg_safe, count_if(verdict = 'fraud') AS fraud_count "
            "FROM history WHERE batch_id IS NULL), top AS (SELECT *, row_number() OVER (ORDER BY \"timestamp\" DESC, id DESC) AS pos "
            "FROM history WHERE batch_id IS NULL ORDER BY \"timestamp\" DESC, id DESC LIMIT 20), "
            "ln AS (SELECT string_agg(printf('- %s: %.2f$ [%s] -> %s (%.1f%%)', CAST(\"timestamp\" AS VARCHAR), amount, model_used, "
            "verdict, probability * 100.0), chr(10) ORDER BY pos) AS recent FROM top WHERE pos <= 10) "
            "SELECT printf('SYSTEM OVERVIEW:\n- Safe transactions: %d\n- Average safe amount: %.2f$\n"
            "- Fraud cases blocked: %d\n\nRECENT TRANSACTIONS:\n', safe_count, avg_safe, fraud_count) || coalesce(recent, '') "
            "AS context FROM st, ln")


@query("context_text", "I5", _CTX_SQL)
def q_ctx_text(spark, d):
    return hist.context_text(fx.history(spark, d))


# ---- composed jobs: SQL knows their rows and what must hold of them ------------------

@query("score_batch", "H5 M7 H6 H7 H8 A11",
       W("dirty_upload") + 'SELECT "Row", row_number() OVER (ORDER BY "Row") AS row_no, CAST("Time" AS DOUBLE) AS time_val, '
       "CASE WHEN \"Row\" % 50 = 0 THEN 2.5 ELSE CAST(Amount AS DOUBLE) END AS amount, 'line ' || CAST(\"Row\" AS VARCHAR) AS description, "
       "TRUE AS p_in_range, TRUE AS verdict_follows, TRUE AS stored FROM dirty_upload WHERE \"Row\" % 50 <> 0 OR Amount = ' 2.5 '")
def q_score_batch(spark, d):
    """An upload with bad cells scored, joined to its statement lines by source
    row, appended to the history table and read back from it."""
    train, _, scaler = jobs.prepared(spark, fx.tx(spark, d))
    model = models.train_model("logistic_regression", train)
    up = fx.dirty_upload(spark, d)
    lines = up.select(F.col("Row").alias("line_no"), F.concat(F.lit("line "), F.col("Row").cast("string")).alias("description"))
    path = _scratch(spark, "import-history")
    scored, summary = jobs.batch_import(spark, up, model, scaler, statement=lines, history=path, source=f"{d}/upload")
    total = summary.first()["total"]
    kept = io.read_history(spark, path)
    whole = kept.groupBy("batch_id").agg((F.count(F.lit(1)) == total).alias("whole"))      # one row: the rows of a batch meet in no task
    back = kept.join(F.broadcast(whole), "batch_id").select(F.col("tx_description").alias("description"), F.col("probability").alias("_p"), "whole")
    p = F.col("fraud_prob")
    return scored.join(back, "description").select(
        "Row", "row_no", "time_val", "amount", "description", p.between(0, 1).alias("p_in_range"), (F.col("verdict") == S.verdict(p)).alias("verdict_follows"),
        (F.col("whole") & (F.abs(F.col("_p") - F.col("probability")) < 1e-12)).alias("stored"))


_BOOKS_SQL = (W("dirty_upload") + ", b AS (SELECT u.*, e.user_id, 'stmt_' || e.user_id || '.xlsx' AS file, e.user_id % 10 AS kind FROM dirty_upload u "
              "JOIN events e ON e.event_id = u.\"Row\" JOIN customer c ON c.c_custkey = e.user_id) ")


@query("import_workbooks", "M7 B2 B3 B18 B19 B20 B21 H5 H6 H7 A11",
       _BOOKS_SQL + ", v AS (SELECT *, row_number() OVER (PARTITION BY file ORDER BY \"Row\") AS line_no FROM b WHERE kind < 8 AND (\"Row\" % 50 <> 0 OR Amount = ' 2.5 ')) "
       "SELECT file, line_no, substr(md5(file || '|upload'), 1, 8) AS batch_id, CAST(\"Time\" AS DOUBLE) AS time_val, CASE WHEN \"Row\" % 50 = 0 THEN 2.5 ELSE CAST(Amount AS DOUBLE) END AS amount, "
       "c_name AS customer_name, c_mktsegment AS bank_name, CASE line_no WHEN 1 THEN 'Chuyen tien' WHEN 2 THEN 'Nhan luong' WHEN 3 THEN 'Thanh toan online' ELSE '' END AS description, "
       "CASE line_no WHEN 1 THEN '-250000' WHEN 2 THEN '15000000' WHEN 3 THEN '-9800000' ELSE '' END AS amount_display, TRUE AS p_in_range, TRUE AS verdict_follows, TRUE AS stored "
       "FROM v JOIN customer ON c_custkey = user_id")
def q_import_workbooks(spark, d):
    """A workbook for each customer, all scored in one job and read back from the history store."""
    train, _, scaler = jobs.prepared(spark, fx.tx(spark, d))
    model = models.train_model("logistic_regression", train)
    path = _scratch(spark, "workbooks")
    told, _, _ = sheets.import_workbooks(spark, fx.workbook_rows(spark, d), model, scaler, history=path, stamp="upload")
    back = io.read_history(spark, path).select("batch_id", F.col("time_val").alias("_t"), F.col("amount").alias("_a"), F.col("tx_description").alias("_d"), F.col("id").alias("_id"))
    p = F.col("fraud_prob")
    joined = told.withColumn("_id", F.xxhash64("batch_id", "row")).join(back, ["batch_id", "_id"])
    stored = (F.col("_t") == F.col("time_val")) & (F.col("_a") == F.col("amount")) & (F.col("_d") == F.col("description"))
    return joined.select("file", F.col("row").alias("line_no"), "batch_id", "time_val", "amount", "customer_name", "bank_name", "description", "amount_display", p.between(0, 1).alias("p_in_range"),
                         (F.col("verdict") == S.verdict(p)).alias("verdict_follows"), stored.alias("stored"))


@query("rejected_workbooks", "M7 B2 B19",
       _BOOKS_SQL + "SELECT DISTINCT file, CASE kind WHEN 9 THEN 'technical sheet not found' ELSE 'Missing 1 required columns: V5...' END AS error FROM b WHERE kind >= 8 "
       "UNION ALL SELECT file, 'no valid rows' FROM b WHERE kind < 8 GROUP BY file HAVING count_if(\"Row\" % 50 <> 0 OR Amount = ' 2.5 ') = 0")
def q_rejected_workbooks(spark, d):
    """Files that give no transactions, and why."""
    rows = cut_lineage(fx.workbook_rows(spark, d), "sheets-read")
    picks = cut_lineage(clean.pick_sheets(rows.select("file", "sheet", "sheet_no").distinct()), "sheets-picked")
    tech = cut_lineage(sheets.technical_rows(rows, picks), "sheets-rows")
    return sheets.rejected(picks, tech, clean.coerce_numeric(tech.where(F.size("absent") == 0)))


@query("baseline_job", "M1 D7", _grid_sql(C.MODEL_NAMES, [jobs.BASELINE_LABEL]))
def q_baseline(spark, d):
    return checked_grid(jobs.baseline_job(spark, fx.tx(spark, d), out_dir=_scratch(spark, "baseline")))


@query("train_and_reevaluate", "M3 M4 A15 A16", _grid_sql(C.MODEL_NAMES, ["undersample_reeval"]))
def q_train_eval(spark, d):
    """All models trained and saved, then loaded and evaluated again: the metrics
    must be those of the training run."""
    out = _scratch(spark, "models")
    t = fx.tx(spark, d)
    first = reliable(jobs.train_job(spark, t, "undersample", out_dir=out))
    again = jobs.evaluate_job(spark, t, out, "undersample")
    kept = ["accuracy", "precision", "recall", "f1_score", "auc_roc", "auc_pr"]
    same = F.lit(True)
    for c in kept:
        same = same & (F.abs(F.col(c) - F.col(f"_{c}")) <= 1e-9)
    return (again.join(first.select("model", *[F.col(c).alias(f"_{c}") for c in kept]), "model")
            .select("model", "sampling", F.col("accuracy").between(0, 1).alias("in_range"), same.alias("recomputed")))


@query("experiment_grid", "M6 E10", _grid_sql(C.MODEL_NAMES, [jobs.BASELINE_LABEL, "undersample", "smote"]))
def q_grid(spark, d):
    return checked_grid(jobs.experiment_grid(spark, fx.tx(spark, d)))


@query("tune_job", "M2 F4 F5 A7",
       "SELECT model, TRUE AS f1_in_range, TRUE AS in_space, TRUE AS better_than_median FROM (VALUES " + ", ".join(f"('{m}')" for m in C.MODEL_NAMES) + ") m(model)")
def q_tune_job(spark, d):
    """All four families tuned over all trials on undersampled rows, read back
    from the saved record: ``in_space``, the parameters are one of the trials;
    ``better_than_median``, no less than half of the trials do worse."""
    out, tables = _scratch(spark, "tune"), {}
    jobs.tune_job(spark, fx.tx(spark, d), "undersample", out_dir=out, trials=tables)
    best = io.read_best_params(spark, out)
    every = None
    for t in tables.values():
        every = t if every is None else every.unionByName(t)
    told = every.groupBy("model").agg(F.percentile("cv_f1", 0.5).alias("_m"), F.collect_set("params").alias("_all"))     # fifty trials of a model
    fits = F.exists("_all", lambda t: F.size(F.map_filter(F.from_json(t, T.MapType(T.StringType(), T.StringType())),
                                                          lambda k, v: ~F.coalesce(F.trim(F.col("params")[k], F.lit('"')) == F.coalesce(v, F.lit("null")), F.lit(False)))) == 0)
    return best.join(told, "model").select("model", F.col("best_f1").between(0, 1).alias("f1_in_range"), fits.alias("in_space"), (F.col("best_f1") >= F.col("_m")).alias("better_than_median"))


@query("all_job", "M5 D7 A9",
       "SELECT m.model, TRUE AS tuned, TRUE AS in_range, TRUE AS recorded "
       "FROM (VALUES " + ", ".join(f"('{C.DISPLAY_NAMES[m]}')" for m in C.MODEL_NAMES) + ") m(model)")
def q_all_job(spark, d):
    """Baseline, tuning and training with the tuned record in one job.  ``tuned``:
    the saved model has the record's parameters; ``recorded``: the run tables hold
    the returned metrics and one logged prediction for every test row."""
    out = _scratch(spark, "all")
    t = fx.tx(spark, d)
    table = reliable(jobs.all_job(spark, t, out, "undersample"))
    tuned = jobs.tuned_params(spark, out)
    kept = {m: models.load_model(models.make_model(m), f"{out}/models/{m}_undersample").spec.params for m in C.MODEL_NAMES}
    same = spark.createDataFrame([(C.DISPLAY_NAMES[m], all(kept[m].get(k) == v for k, v in tuned[m].items()) and bool(tuned[m])) for m in C.MODEL_NAMES], "model string, tuned boolean")
    run = spark.read.parquet(f"{out}/tables/model_metrics").select(F.col("model_name").alias("model"), F.col("f1_score").alias("_f1"), F.col("accuracy").alias("_acc"))
    n_test = prep.stratified_split(t).where("is_test").count()
    logged = spark.read.parquet(f"{out}/tables/predictions_log").groupBy(clean.display_name(F.col("model_name")).alias("model")).agg((F.count("*") == n_test).alias("_all"))
    ok = F.col("accuracy").between(0, 1) & F.col("f1_score").between(0, 1) & F.col("auc_roc").between(0, 1)
    return (table.join(same, "model").join(run, "model").join(logged, "model")
            .select("model", "tuned", ok.alias("in_range"), (F.col("_all") & (F.abs(F.col("_f1") - F.col("f1_score")) < 1e-9) & (F.abs(F.col("_acc") - F.col("accuracy")) < 1e-9)).alias("recorded")))
