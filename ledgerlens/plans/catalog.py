"""Checked queries over the driver tables: one per operator of the inventory.

Each entry has a Spark builder (the library code path) and, where SQL can
express it, DuckDB text over the same parquet tables.  Reported floating
values that come from sums are rounded to 10 significant digits on both sides
(summation order differs between engines and partitionings).
"""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import config as C
from ..functions.numeric import sig_round, sql_sig_round
from ..functions.rand import sql_md5_uniform
from ..operators import clean, eda, history as hist, metrics as M, prep, scoring as S
from ..sources import fixtures as fx
from .registry import query

W = fx.sql_with
U_ID = sql_md5_uniform(C.SEED, "id")
FEATS = ", ".join(f'"{c}"' if c == "Time" else c for c in C.FEATURES)


def _sr(col, d=10):
    return sig_round(F.col(col), d).alias(col)


def _ssr(expr, alias, d=10):
    return f"{sql_sig_round(expr, d)} AS {alias}"


# ---------------------------------------------------------------- sources, B
@query("load_transactions", "A1 B1 B5",
       W("tx") + f'SELECT id, {FEATS}, Class FROM tx')
def q_load(spark, d):
    t = fx.tx(spark, d)
    return t.select("id", *clean.feature_order(t).columns, "Class")


@query("load_check", "A2 G2",
       W("tx") + "SELECT count(*) AS rows, sum(Class) AS frauds, round(100.0 * avg(Class), 3) AS fraud_pct, "
       "CAST(" + " + ".join(f'count_if({c} IS NULL)' for c in ['"Time"', 'Amount', 'Class'] + C.V_COLS)
       + " AS BIGINT) AS null_cells FROM tx")
def q_load_check(spark, d):
    t = fx.tx(spark, d)
    nulls = eda.null_count(t.drop("id")).select("null_cells").scalar()
    return t.agg(F.count(F.lit(1)).alias("rows"), F.sum("Class").alias("frauds"),
                 F.round(F.avg("Class") * 100.0, 3).alias("fraud_pct")).withColumn("null_cells", nulls)


_GUARD = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?[dDfF]$"


def _sql_guard(c):
    return f"(CASE WHEN regexp_matches(trim({c}), '{_GUARD}') THEN NULL ELSE TRY_CAST({c} AS DOUBLE) END)"


_REQ_Q = ['"Time"', "Amount"] + C.V_COLS


@query("coerce_numeric", "A3 B3",
       W("dirty_upload") + 'SELECT * FROM (SELECT "Row", '
       + ", ".join(f"{_sql_guard(c)} AS {c}" for c in _REQ_Q) + " FROM dirty_upload) WHERE "
       + " AND ".join(f"{c} IS NOT NULL AND NOT isnan({c})" for c in _REQ_Q))
def q_coerce(spark, d):
    return clean.coerce_numeric(fx.dirty_upload(spark, d)).select("Row", *C.REQUIRED_UPLOAD)


@query("coerce_rejects", "B4",
       W("dirty_upload") + 'SELECT "Row", array_to_string(list_filter(['
       + ", ".join(f"CASE WHEN {_sql_guard(c)} IS NULL OR isnan({_sql_guard(c)}) THEN '{c.strip(chr(34))}' END"
                   for c in _REQ_Q)
       + "], lambda x: x IS NOT NULL), ',') AS bad_columns FROM dirty_upload WHERE bad_columns <> ''")
def q_rejects(spark, d):
    r = clean.coerce_rejects(fx.dirty_upload(spark, d))
    return r.select("Row", F.array_join("bad_columns", ",").alias("bad_columns"))


def _sql_range_viol():
    parts = [f"CASE WHEN \"Time\" < {C.TIME_RANGE[0]} OR \"Time\" > {C.TIME_RANGE[1]} THEN 'Time' END",
             f"CASE WHEN Amount < {C.AMOUNT_RANGE[0]} OR Amount > {C.AMOUNT_RANGE[1]} THEN 'Amount' END"]
    parts += [f"CASE WHEN {v} < {C.V_RANGE[0]} OR {v} > {C.V_RANGE[1]} THEN '{v}' END" for v in C.V_COLS]
    return "list_filter([" + ", ".join(parts) + "], lambda x: x IS NOT NULL)"


@query("range_check", "B6",
       W("tx") + f"SELECT id, array_to_string({_sql_range_viol()}, ',') AS violations, "
       f"len({_sql_range_viol()}) = 0 AS valid FROM tx")
def q_range(spark, d):
    r = clean.range_check(fx.tx(spark, d))
    return r.select("id", F.array_join("violations", ",").alias("violations"), "valid")


@query("history_fraud_rows", "B7",
       W("history") + "SELECT id, verdict, prediction FROM history WHERE coalesce(verdict = 'fraud' OR prediction = 1, false)")
def q_hist_fraud(spark, d):
    return clean.history_filter(fx.history(spark, d), "fraud").select("id", "verdict", "prediction")


@query("history_safe_rows", "B7",
       W("history") + "SELECT id, verdict, prediction FROM history WHERE coalesce(verdict = 'safe' OR prediction = 0, false)")
def q_hist_safe(spark, d):
    return clean.history_filter(fx.history(spark, d), "safe").select("id", "verdict", "prediction")


@query("demo_and_batch_rows", "B8",
       W("history") + "SELECT CASE WHEN batch_id IS NULL THEN 'demo' ELSE 'batch' END AS kind, count(*) AS n "
       "FROM history WHERE batch_id IS NULL OR batch_id <> '' GROUP BY 1")
def q_demo_batch(spark, d):
    h = fx.history(spark, d)
    a = clean.demo_rows(h).agg(F.count(F.lit(1)).alias("n")).withColumn("kind", F.lit("demo"))
    b = clean.batch_rows(h).agg(F.count(F.lit(1)).alias("n")).withColumn("kind", F.lit("batch"))
    return a.unionByName(b).where(F.col("n") > 0).select("kind", "n")


_DISPLAY_SQL = "CASE m " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in C.DISPLAY_NAMES.items()) + " ELSE m END"


@query("history_display", "B11 B12 B13 B14 B15",
       W("history") + "SELECT id, strftime(\"timestamp\" + INTERVAL 7 HOUR, '%Y-%m-%d %H:%M:%S') AS local_time, "
       "strftime(\"timestamp\" + INTERVAL 7 HOUR, '%Y-%m-%d %H:%M') AS local_minute, "
       "round(time_val / 60.0, 1) AS minutes, "
       + _DISPLAY_SQL.replace("m ", "replace(model_id, '_smote', '') ", 1).replace("ELSE m", "ELSE replace(model_id, '_smote', '')")
       + " AS model_label, coalesce(nullif(customer_name, ''), 'n/a') AS customer FROM history")
def q_display(spark, d):
    h = fx.history(spark, d)
    return h.select("id", clean.display_time(F.col("timestamp").cast("string")).alias("local_time"),
                    clean.display_time(F.col("timestamp").cast("string"), True).alias("local_minute"),
                    clean.seconds_to_minutes(F.col("time_val")).alias("minutes"),
                    clean.display_name(F.regexp_replace("model_id", "_smote", "")).alias("model_label"),
                    clean.falsy_default(F.col("customer_name"), "n/a").alias("customer"))


@query("features_roundtrip", "B16 B17",
       W("tx") + "SELECT id, " + ", ".join(C.V_COLS) + " FROM tx")
def q_roundtrip(spark, d):
    t = fx.tx(spark, d)
    packed = t.select("id", clean.pack_features(t).alias("js"))
    return packed.select("id", *clean.unpack_features(F.col("js"), strict=True))


@query("statement_metadata", "B18",
       W("sheet_rows") + "SELECT file, max_by(CASE WHEN c THEN txt END, CASE WHEN c THEN row_no END) AS customer_name, "
       "max_by(CASE WHEN NOT c AND b THEN txt END, CASE WHEN NOT c AND b THEN row_no END) AS bank_name FROM ("
       "SELECT file, row_no, (lower(cells[1]) LIKE '%khách hàng%' OR lower(cells[1]) LIKE '%kh:%') AS c, "
       "(lower(cells[1]) LIKE '%ngân hàng%' OR lower(cells[1]) LIKE '%nh:%') AS b, "
       "CASE WHEN contains(cells[1], ':') THEN trim(regexp_extract(cells[1], '^[^:]*:(.*)$', 1)) ELSE trim(cells[1]) END AS txt "
       "FROM sheet_rows WHERE row_no < 4 AND len(cells) > 0 AND cells[1] <> '') GROUP BY file")
def q_meta(spark, d):
    return clean.statement_metadata(fx.sheet_rows(spark, d))


@query("pick_sheets", "B19",
       W("workbook_sheets") + "SELECT file, "
       "max_by(CASE WHEN t THEN sheet END, CASE WHEN t THEN sheet_no END) AS tech_sheet, "
       "max_by(CASE WHEN s THEN sheet END, CASE WHEN s THEN sheet_no END) AS statement_sheet, "
       "CASE WHEN max_by(CASE WHEN t THEN sheet END, CASE WHEN t THEN sheet_no END) IS NULL "
       "THEN 'technical sheet not found' END AS error FROM (SELECT *, "
       + "(" + " OR ".join(f"contains(lower(trim(sheet)), '{h}')" for h in C.TECH_SHEET_HINTS) + ") AS t, "
       + "(" + " OR ".join(f"contains(lower(trim(sheet)), '{h}')" for h in C.STATEMENT_SHEET_HINTS) + ") AS s "
       "FROM workbook_sheets) GROUP BY file")
def q_sheets(spark, d):
    return clean.pick_sheets(fx.workbook_sheets(spark, d))


@query("statement_lines", "B20 B21",
       W("sheet_rows") + "SELECT r.file, r.row_no - h.header_row AS line_no, "
       "coalesce(r.cells[1], '') AS date, coalesce(r.cells[2], '') AS time, coalesce(r.cells[3], '') AS description, "
       "coalesce(r.cells[6], '') AS amount_display FROM sheet_rows r JOIN ("
       "SELECT file, min(row_no) AS header_row FROM sheet_rows WHERE len(list_filter(cells, lambda x: lower(trim(x)) IN ("
       + ", ".join(f"'{m}'" for m in C.STATEMENT_HEADER_MARKERS) + "))) > 0 GROUP BY file) h "
       "ON r.file = h.file WHERE r.row_no > h.header_row")
def q_lines(spark, d):
    return clean.statement_columns(clean.statement_body(fx.sheet_rows(spark, d)))


# ---------------------------------------------------------------- C, F1
@query("robust_scaler_fit", "C1 A16",
       W("tx_events") + "SELECT feature, " + _ssr("q50", "center") + ", "
       + _ssr("CASE WHEN q75 - q25 = 0 THEN 1.0 ELSE q75 - q25 END", "scale") + " FROM ("
       "SELECT 'Amount' AS feature, quantile_cont(Amount, 0.25) AS q25, quantile_cont(Amount, 0.5) AS q50, "
       "quantile_cont(Amount, 0.75) AS q75 FROM tx_events UNION ALL "
       "SELECT 'Time', quantile_cont(\"Time\", 0.25), quantile_cont(\"Time\", 0.5), quantile_cont(\"Time\", 0.75) FROM tx_events)")
def q_scaler_fit(spark, d):
    p = prep.fit_robust_scaler(fx.tx_events(spark, d))
    return p.select("feature", _sr("center"), _sr("scale"))


@query("robust_scaled", "C2",
       W("tx_events") + "SELECT id, "
       + _ssr("(Amount - (SELECT quantile_cont(Amount, 0.5) FROM tx_events)) / (SELECT CASE WHEN q = 0 THEN 1.0 ELSE q END "
              "FROM (SELECT quantile_cont(Amount, 0.75) - quantile_cont(Amount, 0.25) AS q FROM tx_events))", "Amount") + ", "
       + _ssr("(\"Time\" - (SELECT quantile_cont(\"Time\", 0.5) FROM tx_events)) / (SELECT CASE WHEN q = 0 THEN 1.0 ELSE q END "
              "FROM (SELECT quantile_cont(\"Time\", 0.75) - quantile_cont(\"Time\", 0.25) AS q FROM tx_events))", '"Time"')
       + " FROM tx_events")
def q_scaled(spark, d):
    t = fx.tx_events(spark, d)
    s = prep.apply_robust_scaler(t, prep.fit_robust_scaler(t))
    return s.select("id", _sr("Amount"), _sr("Time"))


def _sql_alloc(src: str, ndraw_expr: str, out: str) -> str:
    """approximate-mode allocation of ``ndraw_expr`` rows over classes of ``src``."""
    return (f"cc AS (SELECT Class, count(*) AS n FROM {src} GROUP BY Class), "
            f"nd AS (SELECT {ndraw_expr} AS nd FROM (SELECT sum(n) AS tot FROM cc)), "
            "ct AS (SELECT Class, n, CAST(n AS DOUBLE) * nd / (SELECT sum(n) FROM cc) AS cont, nd FROM cc, nd), "
            "fl AS (SELECT *, floor(cont) AS fl, nd - sum(floor(cont)) OVER () AS need, "
            "row_number() OVER (ORDER BY cont - floor(cont) DESC, Class) AS ord FROM ct), "
            f"alloc AS (SELECT Class, n, CAST(fl + CAST(ord <= need AS INTEGER) AS BIGINT) AS {out} FROM fl)")


def _sql_ranked(src: str) -> str:
    return f"rk AS (SELECT *, row_number() OVER (PARTITION BY Class ORDER BY {U_ID}, id) AS rnk FROM {src})"


@query("stratified_split", "C3",
       W("tx_events") + ", " + _sql_alloc("tx_events", f"floor({1.0 - C.TEST_SIZE!r}::DOUBLE * tot)", "n_train")
       + ", " + _sql_ranked("tx_events")
       + " SELECT rk.id, rk.Class, rk.rnk <= a.n - a.n_train AS is_test FROM rk JOIN alloc a USING (Class)")
def q_split(spark, d):
    return prep.stratified_split(fx.tx_events(spark, d)).select("id", "Class", "is_test")


@query("stratified_subsample", "C4",
       W("tx_events") + ", " + _sql_alloc("tx_events", f"floor({C.TUNE_FRACTION!r}::DOUBLE * tot)", "k")
       + ", " + _sql_ranked("tx_events")
       + " SELECT rk.id, rk.Class FROM rk JOIN alloc a USING (Class) WHERE rk.rnk <= a.k")
def q_subsample(spark, d):
    return prep.stratified_subsample(fx.tx_events(spark, d)).select("id", "Class")


@query("undersample", "C5 C8",
       W("tx_events") + ", " + _sql_ranked("tx_events")
       + " SELECT id, Class FROM rk WHERE rnk <= (SELECT min(c) FROM (SELECT count(*) AS c FROM tx_events GROUP BY Class))")
def q_under(spark, d):
    return prep.resample(fx.tx_events(spark, d), "undersample").select("id", "Class")


@query("balanced_weights", "C9",
       W("tx_events") + ", cc AS (SELECT Class, count(*) AS n FROM tx_events GROUP BY Class) "
       "SELECT t.id, t.Class, " + _ssr("CAST((SELECT sum(n) FROM cc) AS DOUBLE) / ((SELECT count(*) FROM cc) * cc.n)", "weight")
       + " FROM tx_events t JOIN cc USING (Class)")
def q_weights(spark, d):
    return prep.balanced_weights(fx.tx_events(spark, d)).select("id", "Class", _sr("weight"))


@query("class_report", "C10",
       W("tx_events") + ", " + _sql_alloc("tx_events", f"floor({1.0 - C.TEST_SIZE!r}::DOUBLE * tot)", "n_train")
       + ", " + _sql_ranked("tx_events")
       + ", sp AS (SELECT rk.id, rk.Class, rk.rnk <= a.n - a.n_train AS is_test FROM rk JOIN alloc a USING (Class)) "
       "SELECT 'all' AS step, Class, count(*) AS rows FROM tx_events GROUP BY Class UNION ALL "
       "SELECT CASE WHEN is_test THEN 'test' ELSE 'train' END, Class, count(*) FROM sp GROUP BY 1, 2")
def q_class_report(spark, d):
    t = fx.tx_events(spark, d)
    s = prep.stratified_split(t)
    return prep.class_report({"all": t, "train": s.where(~F.col("is_test")), "test": s.where("is_test")})


@query("stratified_folds", "F1",
       W("tx_events") + ", " + _sql_ranked("tx_events") + " SELECT id, Class, CAST((rnk - 1) % 5 AS INTEGER) AS fold FROM rk")
def q_folds(spark, d):
    return prep.stratified_folds(fx.tx_events(spark, d)).select("id", "Class", "fold")
