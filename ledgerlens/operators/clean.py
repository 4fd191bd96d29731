"""Projection, validation and scalar helpers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import config as C

# a number pandas would parse: no trailing type suffix such as 1d / 1f
_SUFFIXED = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?[dDfF]$"


def feature_order(df: DataFrame) -> DataFrame:
    """B1: model input columns in model order."""
    return df.select(*C.FEATURES)


def missing_columns(spark: SparkSession, df: DataFrame, required=None) -> DataFrame:
    """B2: required names absent from ``df`` (position kept) and the message."""
    required = required or C.REQUIRED_UPLOAD
    missing = [c for c in required if c not in df.columns]
    rows = [(i + 1, c) for i, c in enumerate(missing)]
    return spark.createDataFrame(rows, "position int, column string")


def missing_message(missing: list[str]) -> str:
    return f"Missing {len(missing)} required columns: {', '.join(missing[:5])}..."


def guarded_double(c: Column) -> Column:
    """Text -> double as pandas.to_numeric would (T12): suffixed numbers are rejected.
    Only a text that holds a suffix's letter is matched with the pattern."""
    text = c.cast("string")
    lettered = text.contains("d") | text.contains("f") | text.contains("D") | text.contains("F")
    return F.when(lettered & F.trim(c).rlike(_SUFFIXED), F.lit(None).cast("double")).otherwise(c.try_cast("double"))


def parse_numeric(df: DataFrame, required=None) -> DataFrame:
    """B3 before rows are dropped: required columns to double, unparseable -> null."""
    return df.withColumns({c: guarded_double(F.col(c)) for c in required or C.REQUIRED_UPLOAD})


def coerce_numeric(df: DataFrame, required=None) -> DataFrame:
    """Required columns to double, unparseable -> null, then drop rows with null/NaN."""
    return parse_numeric(df, required).dropna(subset=required or C.REQUIRED_UPLOAD)


def coerce_rejects(df: DataFrame, required=None, key: str = "Row") -> DataFrame:
    """The rows B3 drops, with the names of the failing columns."""
    required = required or C.REQUIRED_UPLOAD
    checks = F.array(*[F.when(guarded_double(F.col(c)).isNull() | F.isnan(guarded_double(F.col(c))),
                              F.lit(c)) for c in required])
    return (df.select(key, F.filter(checks, lambda x: x.isNotNull()).alias("bad_columns"))
              .where(F.size("bad_columns") > 0))


def split_xy(df: DataFrame, target: str = C.TARGET) -> tuple[DataFrame, DataFrame]:
    """Features without the target, and the target alone."""
    return df.drop(target), df.select(target)


def range_violations(df: DataFrame) -> Column:
    """Array of every column outside its allowed range."""
    def out(c, lo, hi):
        return F.when((F.col(c) < lo) | (F.col(c) > hi), F.lit(c))
    checks = [out("Time", *C.TIME_RANGE), out("Amount", *C.AMOUNT_RANGE)]
    checks += [out(v, *C.V_RANGE) for v in C.V_COLS]
    return F.filter(F.array(*checks), lambda x: x.isNotNull())


def range_check(df: DataFrame) -> DataFrame:
    return df.withColumn("violations", range_violations(df)).withColumn("valid", F.size("violations") == 0)


def history_filter(df: DataFrame, kind: str) -> DataFrame:
    """All / fraud / safe rows of the history table (null-aware OR)."""
    if kind == "all":
        return df
    if kind == "fraud":
        cond = (F.col("verdict") == "fraud") | (F.col("prediction") == 1)
    elif kind == "safe":
        cond = (F.col("verdict") == "safe") | (F.col("prediction") == 0)
    else:
        raise ValueError(f"unknown history filter {kind!r}")
    return df.where(F.coalesce(cond, F.lit(False)))


def demo_rows(df: DataFrame) -> DataFrame:
    """Rows scored one at a time (no batch)."""
    return df.where(F.col("batch_id").isNull())


def batch_rows(df: DataFrame) -> DataFrame:
    """Rows of an imported batch (id present and non-empty)."""
    return df.where(F.col("batch_id").isNotNull() & (F.col("batch_id") != ""))


def exclude_baseline(df: DataFrame, col: str = "sampling") -> DataFrame:
    """Drop rows whose sampling mentions 'baseline' (any case); nulls kept."""
    return df.where(~F.coalesce(F.lower(F.col(col)).contains("baseline"), F.lit(False)))


def exclude_label(df: DataFrame, label: str = "baseline (no sampling)", col: str = "sampling") -> DataFrame:
    """Drop one exact sampling label; nulls kept."""
    return df.where(F.col(col).isNull() | (F.col(col) != label))


def display_name(c: Column) -> Column:
    """Model code -> label, unknown codes unchanged."""
    m = F.create_map(*[x for k, v in C.DISPLAY_NAMES.items() for x in (F.lit(k), F.lit(v))])
    return F.coalesce(m[c], c)


def falsy_default(c: Column, default) -> Column:
    """Empty string, 0 and NULL all become ``default``."""
    d = F.lit(default)
    if isinstance(default, str):
        return F.coalesce(F.nullif(c.cast("string"), F.lit("")), d)
    return F.coalesce(F.nullif(c, F.lit(0)), d)


def parse_timestamp(s: Column) -> Column:
    """Two accepted text formats (with and without fraction)."""
    return F.coalesce(F.try_to_timestamp(s, F.lit("yyyy-MM-dd HH:mm:ss")),
                      F.try_to_timestamp(s, F.lit("yyyy-MM-dd HH:mm:ss.SSSSSS")))


def to_local(ts: Column, minutes_only: bool = False) -> Column:
    """UTC -> local (+7 h), as text to seconds or minutes."""
    fmt = "yyyy-MM-dd HH:mm" if minutes_only else "yyyy-MM-dd HH:mm:ss"
    return F.date_format(ts + F.expr(f"INTERVAL {C.LOCAL_OFFSET_HOURS} HOURS"), fmt)


def display_time(raw: Column, minutes_only: bool = False) -> Column:
    """B13+B14: a parsed timestamp shifted to local time, else the raw text."""
    parsed = parse_timestamp(raw.cast("string"))
    return F.coalesce(to_local(parsed, minutes_only), raw.cast("string"))


def seconds_to_minutes(c: Column) -> Column:
    """Seconds as minutes, one decimal."""
    return F.round(c / 60.0, 1)


def pack_features(df: DataFrame) -> Column:
    """V1..V28 -> JSON object text."""
    keys = F.array(*[F.lit(v) for v in C.V_COLS])
    vals = F.array(*[F.col(v).cast("double") for v in C.V_COLS])
    return F.to_json(F.map_from_arrays(keys, vals))


def unpack_features(js: Column, strict: bool = False) -> list[Column]:
    """JSON/map text -> V1..V28 columns.

    Lenient: malformed text gives an empty map and a missing key gives 0.
    Strict: missing keys stay NULL.
    """
    m = F.from_json(js, "map<string,double>")
    if not strict:
        m = F.coalesce(m, F.create_map().cast("map<string,double>"))
    cols = []
    for v in C.V_COLS:
        x = F.try_element_at(m, F.lit(v))
        cols.append((x if strict else F.coalesce(x, F.lit(0.0))).alias(v))
    return cols


# ---- statement sheets (B18-B21) -------------------------------------------

def statement_metadata(rows: DataFrame) -> DataFrame:
    """Customer and bank from the first four lines of each statement sheet."""
    first = F.lower(F.col("cells")[0])
    text = F.trim(F.regexp_extract(F.col("cells")[0], r"^[^:]*:(.*)$", 1))
    # a cell without ':' keeps its whole text (split(':',1)[-1])
    text = F.when(F.col("cells")[0].contains(":"), text).otherwise(F.trim(F.col("cells")[0]))
    is_cust = F.lit(False)
    for m in C.CUSTOMER_MARKERS:
        is_cust = is_cust | first.contains(m)
    is_bank = F.lit(False)
    for m in C.BANK_MARKERS:
        is_bank = is_bank | first.contains(m)
    head = rows.where((F.col("row_no") < 4) & (F.size("cells") > 0) & (F.col("cells")[0] != ""))
    # the last matching line wins, as in a top-down scan
    return (head.groupBy("file")
                .agg(F.max_by(F.when(is_cust, text), F.when(is_cust, F.col("row_no"))).alias("customer_name"),
                     F.max_by(F.when(~is_cust & is_bank, text),
                              F.when(~is_cust & is_bank, F.col("row_no"))).alias("bank_name")))


def pick_sheets(sheets: DataFrame) -> DataFrame:
    """Technical and statement sheet per file; the last match wins."""
    name = F.lower(F.trim(F.col("sheet")))
    tech = F.lit(False)
    for h in C.TECH_SHEET_HINTS:
        tech = tech | name.contains(h)
    disp = F.lit(False)
    for h in C.STATEMENT_SHEET_HINTS:
        disp = disp | name.contains(h)
    return (sheets.groupBy("file")
                  .agg(F.max_by(F.when(tech, F.col("sheet")), F.when(tech, F.col("sheet_no"))).alias("tech_sheet"),
                       F.max_by(F.when(disp, F.col("sheet")), F.when(disp, F.col("sheet_no"))).alias("statement_sheet"))
                  .withColumn("error", F.when(F.col("tech_sheet").isNull(), F.lit("technical sheet not found"))))


def statement_body(rows: DataFrame) -> DataFrame:
    """The rows after the first header row of each statement sheet."""
    markers = F.array(*[F.lit(m) for m in C.STATEMENT_HEADER_MARKERS])
    is_header = F.exists("cells", lambda x: F.array_contains(markers, F.lower(F.trim(x))))
    header = rows.where(is_header).groupBy("file").agg(F.min("row_no").alias("header_row"))
    # one header row per file: bounded by the number of files, joined on file
    return (rows.join(header, "file").where(F.col("row_no") > F.col("header_row"))
                .withColumn("line_no", (F.col("row_no") - F.col("header_row")).cast("long")))


def statement_columns(body: DataFrame) -> DataFrame:
    """Date, time, description, amount text; empty text on short rows."""
    def cell(i):
        return F.coalesce(F.try_element_at(F.col("cells"), F.lit(i + 1)), F.lit(""))
    return body.select("file", "line_no", cell(0).alias("date"), cell(1).alias("time"),
                       cell(2).alias("description"), cell(5).alias("amount_display"))
