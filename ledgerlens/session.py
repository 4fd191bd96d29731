"""Session construction and cluster-shared locations."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession


def build_session(cpus: int | str = "*", shuffle_partitions: int | None = None,
                  app_name: str = "ledgerlens") -> SparkSession:
    """Local session for tests and benchmarks.

    On a cluster, use the session the platform provides; nothing in the
    library depends on these settings except the UTC time zone.
    """
    parts = shuffle_partitions or (os.cpu_count() if cpus == "*" else int(cpus))
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app_name)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", str(parts))
        .config("spark.default.parallelism", str(parts))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "16g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder the cluster names.

    A scratch folder of this machine is set only where the session has none
    and runs in one process; on a cluster that is an error.
    """
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current
    conf_dir = spark.conf.get("spark.checkpoint.dir", None)
    if not conf_dir:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        conf_dir = tempfile.mkdtemp(prefix="ledgerlens-ckpt-")
    spark.sparkContext.setCheckpointDir(conf_dir)
    return spark.sparkContext.getCheckpointDir() or conf_dir


def reliable(df):
    """``df.checkpoint()`` into the shared folder."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def spread(df):
    """:func:`reliable`, with the rows in two partitions or more for each core.

    Adaptive execution packs the rows of a small table into one partition, and
    fits and distances over them would then run in a single task."""
    kept = reliable(df)
    wanted = 2 * df.sparkSession.sparkContext.defaultParallelism
    return kept if kept.rdd.getNumPartitions() >= wanted else reliable(kept.repartition(wanted))


def shared_dir(spark: SparkSession, name: str) -> str:
    """A sub-folder of the checkpoint location, for tables written to cut lineage."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/{name}"


def cut_lineage(df, name: str):
    """Write ``df`` as parquet under the shared checkpoint folder and read it back.

    Used instead of ``checkpoint()`` for wide plans of many derived columns,
    where copying the plan's inferred constraints into the checkpoint is
    expensive.  Survives executor loss like a checkpoint.  Packed with zstd, since
    wide rows and their texts take most of a job's disk.
    """
    import uuid
    spark = df.sparkSession
    path = shared_dir(spark, f"cut/{name}-{uuid.uuid4().hex[:12]}")
    df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    return spark.read.parquet(path)
