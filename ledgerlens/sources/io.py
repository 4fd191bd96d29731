"""Sources and sinks (A1-A18): files, reports, tables and the history store.

Tables are plain parquet directories (a catalog is optional): the history
table is partitioned by day and a hash bucket of the batch id, so a delete
reads and rewrites few of them.  Rows that replace data are written aside
first, because Spark cannot overwrite a path it is reading from.
"""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import config as C
from ..session import cut_lineage
from . import files

TX_SCHEMA = T.StructType(
    [T.StructField("Time", T.DoubleType())]
    + [T.StructField(v, T.DoubleType()) for v in C.V_COLS]
    + [T.StructField("Amount", T.DoubleType()), T.StructField("Class", T.IntegerType())])

HISTORY_SCHEMA = T.StructType([
    T.StructField("id", T.LongType()), T.StructField("timestamp", T.TimestampType()),
    T.StructField("model_used", T.StringType()), T.StructField("time_val", T.DoubleType()),
    T.StructField("amount", T.DoubleType()), T.StructField("v_features", T.StringType()),
    T.StructField("prediction", T.IntegerType()), T.StructField("probability", T.DoubleType()),
    T.StructField("verdict", T.StringType()), T.StructField("batch_id", T.StringType()),
    T.StructField("model_id", T.StringType()), T.StructField("customer_name", T.StringType()),
    T.StructField("bank_name", T.StringType()), T.StructField("tx_description", T.StringType()),
])

METRICS_SCHEMA = T.StructType([
    T.StructField("model", T.StringType()), T.StructField("sampling", T.StringType()),
    T.StructField("accuracy", T.DoubleType()), T.StructField("precision", T.DoubleType()),
    T.StructField("recall", T.DoubleType()), T.StructField("f1_score", T.DoubleType()),
    T.StructField("auc_roc", T.DoubleType()), T.StructField("auc_pr", T.DoubleType()),
])


# ---- A1 / A3 ------------------------------------------------------------------

def load_transactions(spark: SparkSession, path: str, fmt: str = "csv") -> DataFrame:
    """A1: the 31-column training table with an explicit schema (no inference)."""
    if fmt == "csv":
        return spark.read.schema(TX_SCHEMA).option("header", True).option("mode", "FAILFAST").csv(path)
    return spark.read.schema(TX_SCHEMA).parquet(path)


def assert_loaded(df: DataFrame, target: str = C.TARGET) -> DataFrame:
    """A2: target present and no null cell; one aggregate row (rows, frauds, pct, nulls)."""
    if target not in df.columns:
        raise ValueError(f"Target column '{target}' not found")
    nulls = sum((F.count_if(F.col(c).isNull()) for c in df.columns), F.lit(0))
    return df.agg(F.count(F.lit(1)).alias("rows"), F.sum(target).alias("frauds"),
                  F.round(F.avg(target) * 100.0, 3).alias("fraud_pct"), nulls.cast("long").alias("null_cells"))


def read_upload(spark: SparkSession, path: str) -> DataFrame:
    """A3: batch CSV, any column order, extra columns kept, every cell as text."""
    return (spark.read.option("header", True).option("inferSchema", False).csv(path)
                 .withColumn("source_file", F.input_file_name()))


def list_inputs(spark: SparkSession, directory: str) -> DataFrame:
    """A4: name and size of the .csv / .xlsx files of a folder (contents not read)."""
    df = (spark.read.format("binaryFile").option("pathGlobFilter", "*.{csv,xlsx}")
               .load(directory).select("path", "length"))
    return df.select(F.regexp_extract("path", r"([^/]+)$", 1).alias("name"), F.col("length").alias("size")) \
             .orderBy("name")


# ---- A5 - A8 reports -----------------------------------------------------------

def write_metrics(df: DataFrame, out_dir: str, sampling: str) -> str:
    """A5: comparison table as CSV with header (one folder per report)."""
    path = f"{out_dir}/model_comparison_{sampling}.csv"
    df.coalesce(1).write.mode("overwrite").option("header", True).csv(path)
    return path


def write_feature_importance(imp: DataFrame, out_dir: str, model: str, sampling: str) -> str:
    """Importance table sorted descending."""
    path = f"{out_dir}/feature_importance_{model}_{sampling}.csv"
    imp.orderBy(F.desc("importance"), "feature").coalesce(1).write.mode("overwrite") \
       .option("header", True).csv(path)
    return path


def encode_params(params: dict) -> dict:
    return {k: json.dumps(v) for k, v in params.items()}


def decode_params(m: dict | None) -> dict:
    return {k: json.loads(v) for k, v in (m or {}).items()}


def write_best_params(best: DataFrame, out_dir: str) -> str:
    """(model, best_f1, params map<string,json>) for every tuned model."""
    path = f"{out_dir}/best_params"
    best.select("model", "best_f1", "params").write.mode("overwrite").json(path)
    return path


BEST_SCHEMA = "model string, best_f1 double, params map<string,string>"


def read_best_params(spark: SparkSession, out_dir: str, models=None) -> DataFrame:
    """The tuned record of every model; a model without one gets an empty map."""
    wanted = spark.createDataFrame([(m,) for m in (models or C.MODEL_NAMES)], "model string")
    path = f"{out_dir}/best_params"
    if _exists(spark, path):
        got = spark.read.schema(BEST_SCHEMA).json(path)
    else:                                           # nothing tuned yet
        got = spark.createDataFrame([], BEST_SCHEMA)
    return (wanted.join(got, "model", "left")
                  .withColumn("params", F.coalesce("params", F.create_map().cast("map<string,string>"))))


def read_comparisons(spark: SparkSession, pattern: str) -> DataFrame:
    """Every comparison CSV matching a glob, unioned by name."""
    return spark.read.option("header", True).schema(METRICS_SCHEMA).csv(pattern) \
                .withColumn("source_file", F.input_file_name())


# ---- A9 / A10 tables ----------------------------------------------------------

TABLE_DDL = {
    "model_metrics": "model_name string, sampling string, accuracy double, precision_score double, "
                     "recall double, f1_score double, auc_roc double, auc_pr double, created_at timestamp",
    "feature_importance": "model_name string, sampling string, feature string, importance double, "
                          "created_at timestamp",
    "predictions_log": "model_name string, features_json string, prediction int, probability double, "
                       "created_at timestamp",
}


def create_tables(spark: SparkSession, root: str) -> None:
    """Create the three run tables where they do not exist yet."""
    for name, ddl in TABLE_DDL.items():
        path = f"{root}/{name}"
        if not _exists(spark, path):
            spark.createDataFrame([], ddl).write.mode("append").parquet(path)


def append_rows(df: DataFrame, root: str, table: str) -> None:
    """Append rows with ``created_at`` = now, in the table's column order."""
    cols = [f.split()[0] for f in TABLE_DDL[table].split(", ")]
    out = df.withColumn("created_at", F.current_timestamp())
    out.select(*cols).write.mode("append").parquet(f"{root}/{table}")


def metrics_rows(csv_rows: DataFrame) -> DataFrame:
    """A10: comparison rows renamed to the table's columns, absent AUCs -> 0."""
    d = csv_rows.withColumnsRenamed({"model": "model_name", "precision": "precision_score"})
    for c in ("auc_roc", "auc_pr"):
        d = d.withColumn(c, F.coalesce(F.col(c), F.lit(0.0)) if c in d.columns else F.lit(0.0))
    return d.select("model_name", "sampling", "accuracy", "precision_score", "recall", "f1_score",
                    "auc_roc", "auc_pr")


def load_metrics_csv_into_table(spark: SparkSession, csv_path: str, root: str) -> None:
    """A10: comparison CSV -> ``model_metrics``."""
    rows = spark.read.option("header", True).option("inferSchema", False).csv(csv_path)
    for c in ("accuracy", "precision", "recall", "f1_score", "auc_roc", "auc_pr"):
        if c in rows.columns:
            rows = rows.withColumn(c, F.col(c).try_cast("double"))
    create_tables(spark, root)
    append_rows(metrics_rows(rows), root, "model_metrics")


# ---- A11 - A14 history store ----------------------------------------------------
# Partitions are (slot of the timestamp's day, hash bucket of the batch id, writer,
# micro-batch): their number follows micro-batches, neither batch ids nor the days that
# the rows span, and all rows of a batch lie in one bucket of the slots of its days.
# The column of the slot is named day, and stores whose folders hold the days themselves
# are read as well.  batch_id itself is a column, so '', NULL and all-digit ids stay apart.  Rows of a stream's micro-batch are seen once its number is
# committed in ``_commits``; what a writer that died has left is not seen, and the replay
# removes it.  ``_schema`` holds the store's schema once it was changed.

HISTORY_BUCKETS = 16
HISTORY_SLOTS = 16              # days share them by their hash
PACKING = "zstd"                # of the store's files; those packed otherwise are read as well
DIRECT = "direct"               # the writer of rows that no stream appended
_PARTS = ["day", "bucket", "writer", "batch"]
_LAYOUT = T.StructType([T.StructField("day", T.StringType()), T.StructField("bucket", T.IntegerType()),
                        T.StructField("writer", T.StringType()), T.StructField("batch", T.LongType())])


def _bucket(batch_id) -> F.Column:
    """Bucket of a batch id; rows without one are dealt by their own id."""
    return F.pmod(F.xxhash64(F.coalesce(batch_id, F.concat(F.lit("row "), F.col("id").cast("string")))), F.lit(HISTORY_BUCKETS)).cast("int")


def _slot(timestamp) -> F.Column:
    """Slot of a timestamp's day; rows without a timestamp share one of their own."""
    slot = F.pmod(F.xxhash64(F.date_format(timestamp, "yyyyMMdd")), F.lit(HISTORY_SLOTS))
    return F.when(timestamp.isNotNull(), F.format_string("slot%02d", slot)).otherwise(F.lit("none"))


def _placed(scored: DataFrame, path: str, writer: str, batch: int) -> DataFrame:
    """Rows in the store's schema, with their partitions."""
    d = scored
    fields = store_schema(scored.sparkSession, path).fields
    for f in fields:
        if f.name not in d.columns:
            d = d.withColumn(f.name, F.lit(None).cast(f.dataType))
    d = d.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in fields])
    d = d.withColumns({"day": _slot(F.col("timestamp")), "bucket": _bucket(F.col("batch_id")),
                       "writer": F.lit(writer), "batch": F.lit(batch).cast("long")})
    return d.hint("rebalance", "day", "bucket")


def append_history(scored: DataFrame, path: str) -> None:
    """Append scored rows (a null batch id means single scoring)."""
    _placed(scored, path, DIRECT, 0).write.mode("append").option("compression", PACKING).partitionBy(*_PARTS).parquet(path)


def committed(spark: SparkSession, path: str) -> dict[str, int]:
    """The last committed micro-batch of each stream that writes to the store."""
    told = {}
    for name in files.children(spark, f"{path}/_commits"):
        if name.endswith(".json"):
            entry = json.loads(files.read_text(spark, f"{path}/_commits/{name}"))
            told[entry["writer"]] = entry["batch"]
    return told


def append_once(scored: DataFrame, path: str, writer: str, batch_id: int) -> bool:
    """A11 for a stream: append micro-batch ``batch_id`` of ``writer`` exactly once.

    Micro-batches of a stream come in order.  One that is committed already is
    left alone (False); files that an attempt left without a commit are removed;
    then the rows are written and the commit renamed into its place."""
    spark = scored.sparkSession
    if writer == DIRECT:
        raise ValueError(f"'{DIRECT}' is no name for a stream")
    if batch_id <= committed(spark, path).get(writer, -1):
        return False
    label = files.partition_name(spark, "writer", writer)
    for left in files.matching(spark, f"{path}/day=*/bucket=*/{label}/batch={batch_id}"):
        files.delete(spark, left)
    _placed(scored, path, writer, batch_id).write.mode("append").option("compression", PACKING).partitionBy(*_PARTS).parquet(path)
    name = hashlib.md5(writer.encode()).hexdigest()
    files.commit_text(spark, f"{path}/_commits/{name}.json", json.dumps({"writer": writer, "batch": batch_id}))
    return True


def _stored(spark: SparkSession, path: str) -> DataFrame:
    """Committed rows in the store's schema, with their partitions."""
    seen = F.col("writer") == DIRECT
    for writer, batch in sorted(committed(spark, path).items()):
        seen = seen | ((F.col("writer") == writer) & (F.col("batch") <= batch))
    return spark.read.schema(T.StructType(store_schema(spark, path).fields + _LAYOUT.fields)).parquet(path).where(seen)


def read_history(spark: SparkSession, path: str, schema: T.StructType = HISTORY_SCHEMA) -> DataFrame:
    """History rows in a fixed schema, older or newer than the store's: columns
    that the store or older files lack are NULL, and a value that a narrower type
    cannot hold is NULL (A12)."""
    rows = _stored(spark, path)
    return rows.select(*[(F.col(f.name).try_cast(f.dataType) if f.name in rows.columns else F.lit(None).cast(f.dataType)).alias(f.name) for f in schema.fields])


#: Types that hold all values of another and that Parquet files of that one are read as.
WIDER = {("int", "bigint"), ("int", "double"), ("float", "double"), ("smallint", "int"), ("smallint", "bigint"), ("tinyint", "int"), ("tinyint", "bigint")}


def store_schema(spark: SparkSession, path: str) -> T.StructType:
    """The schema that the store was last migrated to."""
    told = files.read_text(spark, f"{path}/_schema/current.json")
    return T.StructType.fromJson(json.loads(told)) if told else HISTORY_SCHEMA


def migrate_schema(spark: SparkSession, path: str, needed: T.StructType = HISTORY_SCHEMA) -> list[str]:
    """Add the columns that the store lacks and widen types; returns the changes.

    No row is rewritten: files keep the columns and types they were written with,
    and the store's schema, committed as one small file, says how they are read.
    A change that is no widening raises and changes nothing."""
    current = store_schema(spark, path)
    fields, changes = {f.name: f for f in current.fields}, []
    for f in needed.fields:
        old = fields.get(f.name)
        if old is None:
            changes.append(f.name)
        elif old.dataType != f.dataType:
            pair = (old.dataType.simpleString(), f.dataType.simpleString())
            if pair[::-1] in WIDER:
                continue                                # the store is wider already
            if pair not in WIDER:
                raise ValueError(f"column {f.name} cannot change from {pair[0]} to {pair[1]}")
            changes.append(f"{f.name}: {pair[0]} to {pair[1]}")
        else:
            continue
        fields[f.name] = T.StructField(f.name, f.dataType)
    if changes:
        files.commit_text(spark, f"{path}/_schema/current.json", T.StructType(list(fields.values())).json())
    return changes


def _exists(spark: SparkSession, path: str) -> bool:
    return files.exists(spark, path)


def _remove(spark: SparkSession, path: str, where: F.Column, hit: F.Column) -> int:
    """Delete the rows ``hit`` among those ``where`` prunes to; returns their number.

    Survivors of the touched partitions are written aside first and then replace
    them in one dynamic overwrite, whose files appear when the job commits;
    partitions without survivors are removed last.
    """
    rows = _stored(spark, path).where(where)
    touched = {tuple(r[c] for c in _PARTS): r["n"] for r in
               rows.where(hit).groupBy(*_PARTS).agg(F.count(F.lit(1)).alias("n")).collect()}     # partitions of a batch
    if not touched:
        return 0
    part = F.struct(*_PARTS)
    same = part.isin(*[F.struct(F.lit(k[0]), F.lit(k[1]).cast("int"), F.lit(k[2]), F.lit(k[3]).cast("long")) for k in sorted(touched)])
    for i, c in enumerate(_PARTS):
        same = F.col(c).isin(sorted({k[i] for k in touched})) & same
    rest = cut_lineage(_stored(spark, path).where(same & ~F.coalesce(hit, F.lit(False))), "history-rest")
    left = {tuple(r) for r in rest.select(*_PARTS).distinct().collect()}
    if left:
        rest.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", PACKING).partitionBy(*_PARTS).parquet(path)
    for day, bucket, writer, batch in set(touched) - left:
        files.delete(spark, f"{path}/day={day}/bucket={bucket}/{files.partition_name(spark, 'writer', writer)}/batch={batch}")
    return sum(touched.values())


def delete_by_id(spark: SparkSession, path: str, row_id: int) -> int:
    """Delete one row; only its partition is rewritten.  Returns rows deleted
    (0 = not found)."""
    return _remove(spark, path, F.lit(True), F.col("id") == row_id)


def delete_batch(spark: SparkSession, path: str, batch_id: str) -> int:
    """Delete every row of a batch; reads and rewrites its bucket only."""
    return _remove(spark, path, F.col("bucket") == _bucket(F.lit(batch_id)), F.col("batch_id") == batch_id)


# ---- A16 / A17 / A18 --------------------------------------------------------------

def save_scaler(params: DataFrame, out_dir: str) -> None:
    """The 2-row (feature, center, scale) table."""
    params.coalesce(1).write.mode("overwrite").parquet(f"{out_dir}/scaler")


def load_scaler(spark: SparkSession, out_dir: str) -> DataFrame:
    return spark.read.parquet(f"{out_dir}/scaler")


# ---- production models offered for scoring, with descriptions of our own ---------
MODEL_REGISTRY = [
    ("random_forest_smote", "Random Forest", "Ensemble of decision trees, SMOTE-trained"),
    ("logistic_regression_smote", "Logistic Regression", "Linear baseline, SMOTE-trained"),
    ("knn_smote", "KNN", "Nearest-neighbour vote, SMOTE-trained"),
    ("svm_smote", "SVM", "Kernel support vector machine, SMOTE-trained"),
]


def model_registry(spark: SparkSession, artefacts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Registered models whose artefact exists (inner join) and the
    registered ones that are missing (anti join, the warnings)."""
    reg = spark.createDataFrame(MODEL_REGISTRY, "model_id string, name string, description string")
    reg = reg.withColumn("is_default", F.col("model_id") == C.DEFAULT_MODEL_ID)
    have = artefacts.select("model_id").distinct()
    return reg.join(have, "model_id"), reg.join(have, "model_id", "left_anti")


def export_describe(summary: DataFrame, out_dir: str) -> str:
    """Summary statistics (G1) as CSV."""
    path = f"{out_dir}/eda_summary_statistics.csv"
    summary.coalesce(1).write.mode("overwrite").option("header", True).csv(path)
    return path
