"""Canonical views of the transaction data model over the driver tables.

Each view exists twice: as a Spark DataFrame builder and as DuckDB SQL text
(``SQL_VIEWS``) used by the oracle.  Both read whole tables; nothing is sampled.

* ``tx``         every event with the embedding of its id modulo their number: Time, V1..V28, Amount, Class
* ``tx_events``  every event as a (long, imbalanced) transaction
* ``scores``     ``tx_events`` with a repeatable score pulled towards Class
* ``history``    scored rows as the scoring-history table
* ``statement``  orders as account statement lines
* ``sheet_rows`` a statement sheet (metadata, header, body) per customer
* ``dirty_upload`` ``tx`` as text with unparseable cells planted
* ``metrics_ts`` events as metric samples (counter + gauge per user series)
* ``arrivals``   ``metrics_ts`` in four deliveries, a tenth of them late by one
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import config as C
from ..functions.rand import md5_uniform, sql_md5_uniform

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _time_col(events: DataFrame) -> Column:
    first = events.select(F.min("ts")).scalar()
    micros = F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(first.cast("timestamp"))
    return micros.cast("double") / F.lit(1e6)


def tx(spark: SparkSession, sf_dir: str, rows: DataFrame | None = None, keep=()) -> DataFrame:
    """``rows``: other rows with the columns of ``events``, whose further columns
    ``keep`` the result holds; times still count from the first of all events."""
    ev = table(spark, sf_dir, "events")
    rows = ev if rows is None else rows
    emb = table(spark, sf_dir, "embeddings")
    n = emb.count()
    # every event takes the features of one embedding; many events share each
    joined = rows.join(emb, emb.vec_id == F.pmod(rows.event_id, F.lit(n)))
    return joined.select(
        F.col("event_id").alias("id"),
        *keep,
        _time_col(ev).alias("Time"),
        *[F.col("embedding")[i].cast("double").alias(f"V{i + 1}") for i in range(28)],
        F.col("value").alias("Amount"),
        (F.col("label") == 0).cast("int").alias("Class"),
    )


def tx_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = table(spark, sf_dir, "events")
    return ev.select(
        F.col("event_id").alias("id"),
        _time_col(ev).alias("Time"),
        F.col("value").alias("Amount"),
        ((F.col("event_type") == "error") & (F.col("value") >= 150)).cast("int").alias("Class"),
    )


def score_expr(id_col: str = "id", class_col: str = "Class") -> Column:
    u = md5_uniform(C.SEED, F.col(id_col))
    return F.least(F.lit(1.0), F.lit(0.6) * u + F.lit(0.4) * F.col(class_col).cast("double"))


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (tx_events(spark, sf_dir)
            .withColumn("p", score_expr())
            .withColumn("prediction", (F.col("p") >= 0.5).cast("int")))


def _model_id(id_col: Column) -> Column:
    ids = list(C.SERVING_MODELS)
    return F.element_at(F.array(*[F.lit(m) for m in ids]), (F.pmod(id_col, F.lit(len(ids))) + 1).cast("int"))


def history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scoring history: one row per event, batch rows carry customer metadata."""
    from ..operators.scoring import verdict, confidence
    ev = table(spark, sf_dir, "events")
    cust = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment")
    p = score_expr("event_id", "_cls")
    batch = F.when(F.pmod(F.col("user_id"), F.lit(4)) != 0, F.lpad(F.hex(F.col("user_id")), 8, "0"))
    base = (ev.withColumn("_cls", ((F.col("event_type") == "error") & (F.col("value") >= 150)).cast("int"))
              .withColumn("fraud_prob", p)
              .withColumn("batch_id", batch)
              .join(cust, F.col("c_custkey") == F.col("user_id"), "left"))
    model_id = _model_id(F.col("event_id"))
    names = F.create_map(*[x for k, v in C.SERVING_MODELS.items() for x in (F.lit(k), F.lit(v))])
    in_batch = F.col("batch_id").isNotNull()
    return base.select(
        F.col("event_id").alias("id"),
        F.col("ts").alias("timestamp"),
        names[model_id].alias("model_used"),
        _time_col(ev).alias("time_val"),
        F.col("value").alias("amount"),
        F.col("props").alias("v_features"),
        (F.col("fraud_prob") >= 0.5).cast("int").alias("prediction"),
        F.col("fraud_prob"),
        confidence(F.col("fraud_prob")).alias("probability"),
        verdict(F.col("fraud_prob")).alias("verdict"),
        F.col("batch_id"),
        model_id.alias("model_id"),
        F.when(in_batch, F.col("c_name")).alias("customer_name"),
        F.when(in_batch, F.col("c_mktsegment")).alias("bank_name"),
        F.when(in_batch, F.col("event_type")).alias("tx_description"),
    )


def statement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as statement lines; credits are settled orders (status F)."""
    o = table(spark, sf_dir, "orders")
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal")
    return (o.join(c, o.o_custkey == c.c_custkey, "left")
             .select(F.col("o_custkey").alias("account"),
                     F.col("o_orderkey").alias("seq"),
                     F.col("o_orderdate").alias("tx_date"),
                     F.when(F.col("o_orderstatus") == "F", F.col("o_totalprice"))
                      .otherwise(-F.col("o_totalprice")).alias("amount_vnd"),
                     F.coalesce(F.col("c_acctbal"), F.lit(0.0)).alias("start_balance")))


# ---- fixed values: statement sheet template (cell text per row) -------------
SHEET_TEMPLATE = [
    ["Khách hàng: {name}"],
    ["Ngân hàng: {bank}"],
    ["Số tài khoản: {acct}"],
    [],
    ["Ngày GD", "Giờ GD", "Nội dung/Diễn giải", "Tài khoản", "Loại GD", "Số tiền (VNĐ)", "Số dư (VNĐ)", "Ghi chú"],
    ["01/03/2024", "08:15", "Chuyen tien", "{acct}", "Chi", "-250000", "4750000", ""],
    ["01/03/2024", "12:40", "Nhan luong", "{acct}", "Thu", "15000000", "19750000", ""],
    ["02/03/2024", "02:05", "Thanh toan online", "{acct}", "Chi", "-9800000", "9950000", "check"],
    ["02/03/2024", "09:30"],
]
SHEET_NAMES = ["Sao ke giao dich", "Du lieu ky thuat"]


def sheet_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(file, sheet, sheet_no, row_no, cells) for a statement sheet per customer."""
    cust = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment")
    rows = []
    for r, cells in enumerate(SHEET_TEMPLATE):
        arr = F.array(*[
            F.replace(F.replace(F.replace(F.lit(c), F.lit("{name}"), F.col("c_name")),
                                F.lit("{bank}"), F.col("c_mktsegment")),
                      F.lit("{acct}"), F.col("c_custkey").cast("string"))
            for c in cells]) if cells else F.array().cast("array<string>")
        rows.append(F.struct(F.lit(r).cast("long").alias("row_no"), arr.alias("cells")))
    return (cust.select(F.concat(F.lit("stmt_"), F.col("c_custkey").cast("string"), F.lit(".xlsx")).alias("file"),
                        F.lit(SHEET_NAMES[0]).alias("sheet"), F.lit(0).alias("sheet_no"),
                        F.explode(F.array(*rows)).alias("r"))
                .select("file", "sheet", "sheet_no", "r.row_no", "r.cells"))


def workbook_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of a workbook for each customer with events: the statement sheet of
    ``sheet_rows`` and a technical sheet with the customer's rows of ``dirty_upload``.
    Of ten customers one has no technical sheet and one lacks a column in it."""
    key = F.regexp_extract("file", r"(\d+)", 1).cast("long")
    cols = ["Time", *C.V_COLS, "Amount"]
    ev = table(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("_user"))
    cust = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("_user"))
    # the narrow rows meet their customers before they take their features: no shuffle moves cells
    owned = table(spark, sf_dir, "events").join(ev, "event_id").join(cust, "_user")
    file = F.concat(F.lit("stmt_"), F.col("_user").cast("string"), F.lit(".xlsx")).alias("file")
    body = dirty_upload(spark, sf_dir, owned, ["_user"]).select(file, (F.col("Row") + 1).alias("row_no"), F.array(*cols).alias("cells"))
    head = body.select("file").distinct().select("file", F.lit(0).cast("long").alias("row_no"), F.array(*[F.lit(c) for c in cols]).alias("cells"))
    short = F.when(F.pmod(key, F.lit(10)) == 8, F.transform("cells", lambda c, i: F.when(i == 5, F.lit("other")).otherwise(c))).otherwise(F.col("cells"))
    head = head.withColumn("cells", short)
    sheet = F.when(F.pmod(key, F.lit(10)) == 9, F.lit("Notes")).otherwise(F.lit(SHEET_NAMES[1]))
    tech = body.unionByName(head).withColumns({"sheet": sheet, "sheet_no": F.lit(1)})
    return sheet_rows(spark, sf_dir).join(head.select("file"), "file", "left_semi").unionByName(tech)


# ---- fixed values: planted bad cells of the dirty upload --------------------
DIRTY_VALUES = ["abc", "", "1d", "nan", " 2.5 "]


def dirty_upload(spark: SparkSession, sf_dir: str, rows: DataFrame | None = None, keep=()) -> DataFrame:
    if rows is None:        # a file has few row groups, and its rows grow to thirty cells of text
        rows = table(spark, sf_dir, "events").repartition(2 * spark.sparkContext.defaultParallelism)
    t = tx(spark, sf_dir, rows, keep)
    bad = F.element_at(F.array(*[F.lit(v) for v in DIRTY_VALUES]),
                       (F.pmod(F.floor(F.col("id") / 50), F.lit(len(DIRTY_VALUES))) + 1).cast("int"))
    amount = F.when(F.pmod(F.col("id"), F.lit(50)) == 0, bad).otherwise(F.col("Amount").cast("string"))
    return t.select(F.col("id").alias("Row"), *keep, F.col("Time").cast("string").alias("Time"),
                    amount.alias("Amount"), *[F.col(v).cast("string").alias(v) for v in C.V_COLS])


def metrics_ts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metric samples: per user series a daily-reset error counter and a value gauge.

    The running count is taken with the bucketed running-sum helper, so a user
    with a large share of one day's events does not end up in a single task."""
    from ..functions.dist import quantile_bucket, running_sums
    ev = table(spark, sf_dir, "events")
    d = ev.withColumn("_day", F.to_date(F.col("ts"))) \
          .withColumn("_ord", F.unix_micros(F.col("ts").cast("timestamp")).cast("double"))
    b = quantile_bucket(d, "_ord")
    r = running_sums(b, [F.col("ts"), F.col("event_id")], {"_cnt": (F.col("event_type") == "error").cast("long")},
                     partition_by=["user_id", "_day"])
    return r.select(
        F.col("event_id").alias("sample_id"),
        F.col("ts").cast("timestamp").alias("ts"),
        F.col("user_id").cast("string").alias("series"),
        F.col("_cnt").cast("double").alias("counter"),
        F.col("value").alias("gauge"),
        F.col("event_type"),
    )


SLICES = 4


def arrivals(samples: DataFrame, spark: SparkSession) -> DataFrame:
    """``samples`` with ``slice``, the delivery they come with: equal spans of
    time, but every tenth sample comes with the next delivery."""
    us = F.unix_micros("ts")
    lo, hi = samples.agg(F.min(us), F.max(us)).first()
    width = (hi - lo) // SLICES + 1
    return samples.withColumn("slice", F.least(F.lit(SLICES - 1), F.floor((us - F.lit(lo)) / F.lit(width)) + F.when(F.pmod("sample_id", F.lit(10)) == 3, 1).otherwise(0)).cast("int"))


DELIVERY_ROWS = 250_000         # rows of a file of a large delivery


def sample_stream(spark: SparkSession, sf_dir: str, path: str) -> DataFrame:
    """``metrics_ts`` as a stream of deliveries, one to a micro-batch.  Each is written as
    the same number of files, as many as the smallest fills, so no task writes a large delivery alone."""
    from ..session import reliable
    told = reliable(arrivals(metrics_ts(spark, sf_dir), spark))
    rows = {r["slice"]: r["count"] for r in told.groupBy("slice").count().collect()}        # SLICES rows
    n = max(1, min(rows.get(i, 0) for i in range(SLICES)) // DELIVERY_ROWS)
    for i in range(SLICES):
        part = told.where(F.col("slice") == i).drop("slice")
        (part.coalesce(1) if n == 1 else part.repartition(n)).write.mode("append").parquet(path)
    return spark.readStream.schema(told.drop("slice").schema).option("maxFilesPerTrigger", n).parquet(path)


def delivery_files(spark: SparkSession, path: str) -> int:
    """Files of each delivery that :func:`sample_stream` wrote."""
    return len(spark.read.parquet(path).inputFiles()) // SLICES


# ---------------------------------------------------------------------------
# DuckDB text of the same views (the oracle side)
# ---------------------------------------------------------------------------

_TIME_SQL = "(CAST(epoch_us(ts) - (SELECT epoch_us(min(ts)) FROM events) AS DOUBLE) / 1e6)"
_U_ID = sql_md5_uniform(C.SEED, "id")

SQL_VIEWS: dict[str, str] = {
    "tx": "SELECT e.event_id AS id, " + _TIME_SQL.replace("epoch_us(ts)", "epoch_us(e.ts)", 1) + ' AS "Time", '
          + ", ".join(f"CAST(m.embedding[{i + 1}] AS DOUBLE) AS V{i + 1}" for i in range(28))
          + ", e.value AS Amount, CAST(m.label = 0 AS INTEGER) AS Class "
          "FROM events e JOIN embeddings m ON m.vec_id = e.event_id % (SELECT count(*) FROM embeddings)",
    "tx_events": "SELECT event_id AS id, " + _TIME_SQL + ' AS "Time", value AS Amount, '
                 "CAST(event_type = 'error' AND value >= 150 AS INTEGER) AS Class FROM events",
    "scores": "SELECT *, CAST(p >= 0.5 AS INTEGER) AS prediction FROM ("
              f"SELECT *, least(1.0::DOUBLE, 0.6::DOUBLE * {_U_ID} + 0.4::DOUBLE * CAST(Class AS DOUBLE)) AS p "
              "FROM tx_events)",
    "history": (
        "SELECT s.id, e.ts AS \"timestamp\", "
        "CASE s.id % 4 " + " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(C.SERVING_MODELS.values()))
        + " END AS model_used, s.\"Time\" AS time_val, s.Amount AS amount, e.props AS v_features, "
        "CAST(s.p >= 0.5 AS INTEGER) AS prediction, s.p AS fraud_prob, "
        f"CASE WHEN s.p >= {C.FRAUD_THRESHOLD} OR s.p >= {C.SUSPECT_THRESHOLD} THEN s.p ELSE 1.0::DOUBLE - s.p END AS probability, "
        f"CASE WHEN s.p >= {C.FRAUD_THRESHOLD} THEN 'fraud' WHEN s.p >= {C.SUSPECT_THRESHOLD} THEN 'suspect' ELSE 'safe' END AS verdict, "
        "CASE WHEN e.user_id % 4 <> 0 THEN lpad(upper(to_hex(e.user_id)), 8, '0') END AS batch_id, "
        "CASE s.id % 4 " + " ".join(f"WHEN {i} THEN '{k}'" for i, k in enumerate(C.SERVING_MODELS))
        + " END AS model_id, "
        "CASE WHEN e.user_id % 4 <> 0 THEN c.c_name END AS customer_name, "
        "CASE WHEN e.user_id % 4 <> 0 THEN c.c_mktsegment END AS bank_name, "
        "CASE WHEN e.user_id % 4 <> 0 THEN e.event_type END AS tx_description "
        "FROM scores s JOIN events e ON e.event_id = s.id LEFT JOIN customer c ON c.c_custkey = e.user_id"),
    "statement": (
        "SELECT o.o_custkey AS account, o.o_orderkey AS seq, o.o_orderdate AS tx_date, "
        "CASE WHEN o.o_orderstatus = 'F' THEN o.o_totalprice ELSE -o.o_totalprice END AS amount_vnd, "
        "coalesce(c.c_acctbal, 0.0::DOUBLE) AS start_balance "
        "FROM orders o LEFT JOIN customer c ON o.o_custkey = c.c_custkey"),
    "metrics_ts": (
        "SELECT event_id AS sample_id, ts, CAST(user_id AS VARCHAR) AS series, "
        "CAST(sum(CAST(event_type = 'error' AS BIGINT)) OVER (PARTITION BY user_id, CAST(ts AS DATE) "
        "ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS DOUBLE) AS counter, "
        "value AS gauge, event_type FROM events"),
    "arrivals": (
        "SELECT m.*, CAST(least(3, (epoch_us(ts) - lo) // ((hi - lo) // 4 + 1) + CASE WHEN sample_id % 10 = 3 THEN 1 ELSE 0 END) AS INTEGER) AS slice "
        "FROM metrics_ts m, (SELECT min(epoch_us(ts)) AS lo, max(epoch_us(ts)) AS hi FROM metrics_ts)"),
}

# which views each view needs first (for assembling WITH clauses)
SQL_DEPS = {"tx": [], "tx_events": [], "scores": ["tx_events"], "history": ["scores"],
            "statement": [], "metrics_ts": [], "arrivals": ["metrics_ts"]}


def sql_with(*views: str) -> str:
    """``WITH`` clause defining the requested views (and what they depend on)."""
    order: list[str] = []

    def add(v):
        for d in SQL_DEPS.get(v, []):
            add(d)
        if v not in order:
            order.append(v)
    for v in views:
        add(v)
    return "WITH " + ",\n".join(f"{v} AS ({SQL_VIEWS[v]})" for v in order) + "\n"


# ---------------------------------------------------------------------------
# Views used by the sheet, upload and run-grid queries
# ---------------------------------------------------------------------------

# ---- fixed values: the run grid of the experiment notebook (model x sampling)
RUN_SAMPLINGS = ["baseline (no sampling)", "undersample", "smote"]
RUNS = [(m, s) for s in RUN_SAMPLINGS for m in C.MODEL_NAMES]


def runs_scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every transaction scored once per (model, sampling) run: a long table."""
    t = tx_events(spark, sf_dir)
    arr = F.array(*[F.struct(F.lit(i).alias("run"), F.lit(m).alias("model"), F.lit(s).alias("sampling"))
                    for i, (m, s) in enumerate(RUNS)])
    t = t.select("id", "Class").repartition(2 * spark.sparkContext.defaultParallelism)     # a file has few row groups, and each row is scored twelve times
    x = t.select("id", "Class", F.explode(arr).alias("r")).select("id", "Class", "r.*")
    u = md5_uniform(C.SEED, F.col("run"), F.col("id"))
    p = F.least(F.lit(1.0), F.lit(0.6) * u + F.lit(0.4) * F.col("Class").cast("double"))
    return x.withColumn("p", p).withColumn("prediction", (F.col("p") >= 0.5).cast("int"))


# ---- fixed values: sheets of every uploaded workbook --------------------------
WORKBOOK_SHEETS = ["Sao ke giao dich", "Du lieu ky thuat", "Ghi chu"]


def workbook_sheets(spark: SparkSession, sf_dir: str) -> DataFrame:
    cust = table(spark, sf_dir, "customer").select("c_custkey")
    arr = F.array(*[F.struct(F.lit(s).alias("sheet"), F.lit(i).alias("sheet_no"))
                    for i, s in enumerate(WORKBOOK_SHEETS)])
    return cust.select(F.concat(F.lit("stmt_"), F.col("c_custkey").cast("string"), F.lit(".xlsx")).alias("file"),
                       F.explode(arr).alias("s")).select("file", "s.sheet", "s.sheet_no")


def _sql_cell(text: str) -> str:
    t = "'" + text.replace("'", "''") + "'"
    return (f"replace(replace(replace({t}, '{{name}}', c_name), '{{bank}}', c_mktsegment), "
            f"'{{acct}}', CAST(c_custkey AS VARCHAR))")


def _sql_sheet_rows() -> str:
    cases = " ".join(
        f"WHEN {r} THEN " + ("[" + ", ".join(_sql_cell(c) for c in cells) + "]" if cells else "CAST([] AS VARCHAR[])")
        for r, cells in enumerate(SHEET_TEMPLATE))
    values = ", ".join(f"({r})" for r in range(len(SHEET_TEMPLATE)))
    return (f"SELECT 'stmt_' || CAST(c_custkey AS VARCHAR) || '.xlsx' AS file, '{SHEET_NAMES[0]}' AS sheet, "
            f"0 AS sheet_no, CAST(t.row_no AS BIGINT) AS row_no, CASE t.row_no {cases} END AS cells "
            f"FROM customer CROSS JOIN (VALUES {values}) t(row_no)")


def _sql_runs() -> str:
    values = ", ".join(f"({i}, '{m}', '{s}')" for i, (m, s) in enumerate(RUNS))
    u = sql_md5_uniform(C.SEED, "r.run", "t.id")
    return ("SELECT *, CAST(p >= 0.5 AS INTEGER) AS prediction FROM ("
            f"SELECT t.id, t.Class, r.run, r.model, r.sampling, "
            f"least(1.0::DOUBLE, 0.6::DOUBLE * {u} + 0.4::DOUBLE * CAST(t.Class AS DOUBLE)) AS p "
            f"FROM tx_events t CROSS JOIN (VALUES {values}) r(run, model, sampling))")


def _sql_dirty() -> str:
    bad = "[" + ", ".join("'" + v + "'" for v in DIRTY_VALUES) + "]"
    return ('SELECT id AS "Row", CAST("Time" AS VARCHAR) AS "Time", '
            f"CASE WHEN id % 50 = 0 THEN list_extract({bad}, CAST(floor(id / 50) % {len(DIRTY_VALUES)} AS INTEGER) + 1) "
            "ELSE CAST(Amount AS VARCHAR) END AS Amount, "
            + ", ".join(f"CAST({v} AS VARCHAR) AS {v}" for v in C.V_COLS) + " FROM tx")


def _sql_sheets() -> str:
    values = ", ".join(f"('{s}', {i})" for i, s in enumerate(WORKBOOK_SHEETS))
    return ("SELECT 'stmt_' || CAST(c_custkey AS VARCHAR) || '.xlsx' AS file, s.sheet, s.sheet_no "
            f"FROM customer CROSS JOIN (VALUES {values}) s(sheet, sheet_no)")


SQL_VIEWS.update({"sheet_rows": _sql_sheet_rows(), "runs": _sql_runs(), "dirty_upload": _sql_dirty(),
                  "workbook_sheets": _sql_sheets()})
SQL_DEPS.update({"sheet_rows": [], "runs": ["tx_events"], "dirty_upload": ["tx"], "workbook_sheets": []})
