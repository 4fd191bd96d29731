"""Scores put in order by ranges, and row numbers by ranges."""

import math
import random

import pytest
from pyspark.sql import functions as F

from ledgerlens.functions.dist import range_numbers
from ledgerlens.operators import metrics as M

KEYS = ["model", "sampling"]


def scored(spark, scores):
    rng = random.Random(5)
    rows = [(rng.choice("ab"), rng.choice(["x", "y"]), rng.choice(scores), rng.choice([0, 1, 1, None])) for _ in range(4000)]
    return rows, spark.createDataFrame(rows, "model string, sampling string, p double, Class int").repartition(6)


def above(p):
    """Descending order of scores: NaN, numbers, null."""
    return (2, 0.0) if p is None else (0, 0.0) if math.isnan(p) else (1, -p)


@pytest.mark.parametrize("kind", ["repeated", "distinct"])
@pytest.mark.parametrize("by", [[], KEYS])
def test_score_groups_equal_a_plain_loop(spark, kind, by):
    rng = random.Random(6)
    odd = [None, math.nan, -0.0, 0.0, 1.0, -2.5, math.inf]
    rows, df = scored(spark, odd if kind == "repeated" else odd + [rng.uniform(-1, 1) for _ in range(9000)])
    want = {}
    for run in sorted({r[:2] if by else () for r in rows}):
        counts = {}
        for r in rows:
            if not by or r[:2] == run:
                pos, neg = counts.get(above(r[2]), (0, 0))
                counts[above(r[2])] = (pos + (r[3] == 1), neg + (r[3] == 0))
        tp = fp = 0
        for k in sorted(counts):
            pos, neg = counts[k]
            want[(*run, k)] = (pos, neg, tp + pos, fp + neg, tp, fp)
            tp, fp = tp + pos, fp + neg
    got = M.score_groups(df, by=by, n_buckets=7)
    assert got.columns == [*by, "p", "pos", "neg", "tp_cum", "fp_cum", "tp_above", "fp_above"]
    told = [((*(r[b] for b in by), above(r.p)), (r.pos, r.neg, r.tp_cum, r.fp_cum, r.tp_above, r.fp_above)) for r in got.collect()]
    assert len(told) == len(want) and dict(told) == want


def test_scores_are_not_shuffled_after_they_are_written(spark):
    _, df = scored(spark, [0.1, 0.2, 0.7])
    plan = M.score_groups(df, by=KEYS)._jdf.queryExecution().sparkPlan().toString()
    assert "Sort [p" not in plan and "order by" not in plan.lower()
    assert not [x for x in plan.split("\n") if "Window" in x and "p#" in x.split("Window", 1)[1]]


def test_score_groups_of_nothing(spark):
    df = spark.createDataFrame([], "model string, sampling string, p double, Class int")
    assert M.score_groups(df, by=KEYS).count() == 0 and M.score_groups(df).count() == 0


def test_row_numbers_by_ranges(spark):
    rng = random.Random(8)
    rows = [(rng.choice([None, 5, rng.randrange(10 ** 12)]), i) for i in range(3000)]
    df = spark.createDataFrame(rows, "x long, i int").repartition(5)
    told = range_numbers(df, "x", "n", n_buckets=9)
    got = sorted(told.collect(), key=lambda r: r.n)
    assert told.columns == ["x", "i", "n"] and [r.n for r in got] == list(range(1, 3001)) and {(r.x, r.i) for r in got} == set(rows)
    order = [(r.x is not None, r.x or 0) for r in got]
    assert order == sorted(order)
    plan = told._jdf.queryExecution().sparkPlan().toString()
    assert not [x for x in plan.split("\n") if "Window" in x and "i#" in x]          # no rows are sorted again
    assert range_numbers(df.limit(0), "x", "n").count() == 0
