"""Tables kept on the way, and the history store, are packed with zstd."""

import glob

import pyarrow.parquet as pq
from pyspark.sql import functions as F

from ledgerlens.session import cut_lineage
from ledgerlens.sources import io


def _packing(folder):
    files = glob.glob(f"{folder.removeprefix('file:')}/**/*.parquet", recursive=True)
    return {pq.ParquetFile(f).metadata.row_group(g).column(c).compression for f in files
            for g in range(pq.ParquetFile(f).metadata.num_row_groups) for c in range(pq.ParquetFile(f).metadata.num_columns)}


def _rows(spark):
    return spark.range(300).select("id", F.lit("b1").alias("batch_id"), F.timestamp_seconds(F.col("id") * 9000).alias("timestamp"),
                                   F.concat_ws(",", F.col("id"), F.rand(3)).alias("v_features"))


def test_cut_tables_are_packed_and_whole(spark):
    kept = cut_lineage(_rows(spark), "packed")
    assert _packing(kept.inputFiles()[0].rsplit("/", 1)[0].replace("file://", "")) == {"ZSTD"}
    assert sorted(kept.collect()) == sorted(_rows(spark).collect())


def test_history_is_packed_and_whole(spark, tmp_path):
    path = str(tmp_path / "history")
    io.append_history(_rows(spark), path)
    assert _packing(path) == {"ZSTD"}
    back = io.read_history(spark, path).select("id", "batch_id", "timestamp", "v_features")
    assert sorted(back.collect()) == sorted(_rows(spark).collect())
    _rows(spark).where("id < 20").withColumn("batch_id", F.lit("b2")).selectExpr("id + 1000 AS id", "batch_id", "timestamp", "v_features").transform(lambda d: io.append_history(d, path) or d)
    assert io.read_history(spark, path).count() == 320
