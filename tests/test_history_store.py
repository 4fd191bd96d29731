"""The history store: exactly-once appends of streams, schema changes on a
populated store, deletes across writers."""

import uuid

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlens.session import shared_dir
from ledgerlens.sources import files, io
from ledgerlens.streaming import jobs as SJ


@pytest.fixture
def store(spark):
    return shared_dir(spark, f"tests/{uuid.uuid4().hex}/store")


def rows(spark, ids, day=1):
    return spark.createDataFrame([(i, 1_700_000_000 + 86_400 * day + i, f"b{i % 3}", float(i)) for i in ids], "id long, t long, batch_id string, amount double") \
        .select("id", F.timestamp_seconds("t").alias("timestamp"), "batch_id", "amount")


def ids(spark, store):
    return sorted(r.id for r in io.read_history(spark, store).collect())


def test_a_committed_batch_is_left_alone(spark, store):
    assert io.append_once(rows(spark, range(5)), store, "s", 0)
    assert not io.append_once(rows(spark, range(5)), store, "s", 0)
    io.append_history(rows(spark, [100]), store)
    assert io.append_once(rows(spark, range(5, 9)), store, "a/b=c", 0)
    assert ids(spark, store) == [*range(9), 100]
    assert io.committed(spark, store) == {"s": 0, "a/b=c": 0}


def test_killed_between_write_and_commit(spark, store, monkeypatch):
    """Rows without a commit aren't seen; the replay, whose rows fall on another day, leaves no copies."""
    io.append_once(rows(spark, range(3)), store, "s", 0)

    def dies(*_):
        raise OSError("killed")

    with monkeypatch.context() as m:
        m.setattr(files, "commit_text", dies)
        with pytest.raises(OSError):
            io.append_once(rows(spark, range(3, 8)), store, "s", 1)
    assert files.matching(spark, f"{store}/day=*/bucket=*/writer=s/batch=1")
    assert ids(spark, store) == [0, 1, 2]
    assert io.append_once(rows(spark, range(3, 8), day=2), store, "s", 1)
    assert ids(spark, store) == list(range(8))


def test_killed_stream_is_replayed(spark, store, monkeypatch):
    root = store.rsplit("/", 1)[0]
    add = lambda lo, hi: rows(spark, range(lo, hi)).coalesce(1).write.mode("append").parquet(f"{root}/in")
    schema = rows(spark, []).schema
    run = lambda: SJ.score_into_history(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{root}/in"), lambda d: d, store)
    add(0, 20)
    run()
    add(20, 30)
    add(30, 45)
    real, calls = files.commit_text, []

    def dies(spark_, path, text):
        calls.append(path)
        if "_commits" in path and len(calls) == 2:
            raise OSError("killed")
        real(spark_, path, text)

    with monkeypatch.context() as m:
        m.setattr(files, "commit_text", dies)
        with pytest.raises(Exception, match="killed"):
            run()
    assert ids(spark, store) == list(range(30))
    run()
    assert ids(spark, store) == list(range(45))
    assert io.committed(spark, store) == {"score": 2}


OLD = T.StructType([T.StructField("id", T.LongType()), T.StructField("timestamp", T.TimestampType()), T.StructField("batch_id", T.StringType()),
                    T.StructField("prediction", T.IntegerType())])
NEW = T.StructType([*io.HISTORY_SCHEMA.fields, T.StructField("note", T.StringType())])
WIDE = T.StructType([T.StructField("prediction", T.LongType()) if f.name == "prediction" else f for f in NEW.fields])


def test_schema_of_a_populated_store_changes(spark, store):
    io.append_history(rows(spark, range(4)).withColumn("prediction", F.lit(7)), store)
    assert io.migrate_schema(spark, store) == []
    assert io.migrate_schema(spark, store, NEW) == ["note"]
    assert io.migrate_schema(spark, store, WIDE) == ["prediction: int to bigint"]
    assert io.migrate_schema(spark, store, WIDE) == [] and io.migrate_schema(spark, store) == []
    io.append_history(rows(spark, [10, 11]).withColumns({"prediction": F.lit(2 ** 40), "note": F.lit("n")}), store)
    new = {r.id: (r.prediction, r.note, r.amount) for r in io.read_history(spark, store, WIDE).collect()}
    assert new == {**{i: (7, None, float(i)) for i in range(4)}, **{i: (2 ** 40, "n", float(i)) for i in (10, 11)}}
    old = {r.id: r.prediction for r in io.read_history(spark, store, OLD).collect()}
    assert old == {**{i: 7 for i in range(4)}, 10: None, 11: None}
    with pytest.raises(ValueError, match="amount"):
        io.migrate_schema(spark, store, T.StructType([T.StructField("amount", T.StringType())]))


def test_deletes_keep_added_columns_and_other_writers(spark, store):
    io.migrate_schema(spark, store, WIDE)
    io.append_history(rows(spark, range(6)).withColumn("note", F.lit("kept")), store)
    io.append_once(rows(spark, range(6, 12)).withColumn("note", F.lit("kept")), store, "s", 0)
    assert io.delete_batch(spark, store, "b1") == 4
    assert io.delete_by_id(spark, store, 6) == 1 and io.delete_by_id(spark, store, 6) == 0
    left = io.read_history(spark, store, WIDE).collect()
    assert sorted(r.id for r in left) == [0, 2, 3, 5, 8, 9, 11] and {r.note for r in left} == {"kept"}


def test_folders_do_not_grow_with_days(spark, store):
    """Two rows a day over 1,500 days, some without a timestamp, lie in a bounded number of folders."""
    many = spark.range(3000).select("id", F.when(F.col("id") % 100 != 7, F.timestamp_seconds(F.col("id") * 43_200)).alias("timestamp"),
                                    F.concat(F.lit("b"), F.col("id")).alias("batch_id"), F.lit(1.0).alias("amount"))
    io.append_history(many, store)
    folders = files.matching(spark, f"{store}/day=*/bucket=*")
    assert 0 < len(folders) <= (io.HISTORY_SLOTS + 1) * io.HISTORY_BUCKETS
    assert len(files.matching(spark, f"{store}/day=none")) == 1
    assert ids(spark, store) == list(range(3000))
    assert io.delete_batch(spark, store, "b1207") == 1 and io.delete_by_id(spark, store, 20) == 1
    assert ids(spark, store) == [i for i in range(3000) if i not in (20, 1207)]
