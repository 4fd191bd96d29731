"""Sample store of the rule streams: folders by day and micro-batch, and
retention (L10) that drops whole days.

``drop_days`` first commits the horizon, the first day that is kept, in a file
written aside and renamed, and removes the older folders afterwards.  Readers go
by the horizon, so they see the same rows whether the folders are gone yet or
not, and a job that dies in between is finished by the next.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import config as C
from ..sources.files import children, commit_text, delete, read_text

PLACE = [T.StructField("day", T.StringType()), T.StructField("batch", T.LongType())]
HORIZON = "_retention/horizon.json"


def put(batch: DataFrame, store: str, batch_id: int, ts: str = "ts") -> None:
    """Add a micro-batch; a replay replaces it."""
    (batch.withColumn("day", F.date_format(ts, "yyyyMMdd")).withColumn("batch", F.lit(batch_id).cast("long"))
     .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day", "batch").parquet(store))


def horizon(spark: SparkSession, store: str) -> str:
    """First day that is kept, as yyyyMMdd; '' if nothing was ever dropped."""
    told = read_text(spark, f"{store}/{HORIZON}")
    return json.loads(told)["first_day"] if told else ""


def samples(spark: SparkSession, store: str, schema: T.StructType) -> DataFrame:
    """Samples kept, with their ``day`` and ``batch``."""
    return spark.read.schema(T.StructType([*schema.fields, *PLACE])).parquet(store).where(F.col("day") >= horizon(spark, store))


def drop_days(spark: SparkSession, store: str, days: int = C.RETENTION_DAYS, now: str | None = None) -> list[str]:
    """L10 for a store: drop the days that end ``days`` days or more before the
    day ``now`` (yyyyMMdd; default: the latest one held).  Returns the days dropped.

    Only folder names are read, so no sample is touched."""
    held = sorted(n.removeprefix("day=") for n in children(spark, store) if n.startswith("day=") and n != "day=__HIVE_DEFAULT_PARTITION__")
    if not held:
        return []
    row = spark.range(1).select(F.date_format(F.date_sub(F.to_date(F.lit(now or held[-1]), "yyyyMMdd"), days), "yyyyMMdd").alias("d")).first()
    first = max(row["d"], horizon(spark, store))
    gone = [d for d in held if d < first]
    commit_text(spark, f"{store}/{HORIZON}", json.dumps({"first_day": first, "dropped": gone}))
    for d in gone:
        delete(spark, f"{store}/day={d}")
    return gone
