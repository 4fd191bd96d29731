"""Buckets by range shuffle, and running sums over them."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from ledgerlens.functions.dist import quantile_bucket, running_sums


@pytest.mark.parametrize("descending", [False, True])
def test_buckets_follow_the_order(spark, descending):
    rng = random.Random(3)
    vals = [rng.choice([0.0, 1.5, rng.random()]) for _ in range(3000)] + [None] * 40 + [float("nan")] * 5
    rng.shuffle(vals)
    df = spark.createDataFrame(list(enumerate(vals)), "id long, x double").repartition(5)
    b = quantile_bucket(df, "x", 16, descending=descending)
    order = F.col("x").desc() if descending else F.col("x").asc()
    seen = [r._b for r in b.orderBy(order).select("_b").collect()]
    assert seen == sorted(seen) and len(seen) == len(vals) and len(set(seen)) > 4
    at = {}
    for r in b.collect():
        at.setdefault(repr(r.x), set()).add(r._b)
    assert all(len(s) == 1 for s in at.values())            # equal values share a bucket


def test_running_sums_equal_a_plain_loop(spark):
    rng = random.Random(4)
    rows = [(i, rng.choice("ab"), rng.choice([None, 7.0, rng.random()]), rng.randrange(100)) for i in range(2000)]
    df = spark.createDataFrame(rows, "id long, g string, x double, n long").repartition(7)
    got = running_sums(quantile_bucket(df, "x", 9), [F.col("x"), F.col("id")], {"s": F.col("n")}, partition_by=["g"])
    want = {}
    for g in "ab":
        mine = sorted((r for r in rows if r[1] == g), key=lambda r: (r[2] is not None, r[2] or 0.0, r[0]))
        want |= dict(zip([r[0] for r in mine], itertools.accumulate(r[3] for r in mine)))
    assert {r.id: r.s for r in got.collect()} == want


def test_buckets_of_nothing(spark):
    df = spark.createDataFrame([], "id long, x double")
    assert quantile_bucket(df, "x").columns == ["id", "x", "_b"] and quantile_bucket(df, "x").count() == 0
    one = spark.createDataFrame([(1, None), (2, None)], "id long, x double")
    assert {r._b for r in quantile_bucket(one, "x").collect()} != set() and quantile_bucket(one, "x").count() == 2
