"""Exact top-k search against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerlens.llm import queries, topk

from .conftest import SF


def slow_top(rows, is_query, k):
    ok = []
    for i, v in {(i, None if v is None else tuple(v)) for i, v in rows}:
        q = topk.quantised(list(v) if v is not None else None)
        if i is not None and q is not None:
            ok.append((i, [int(x) for x in q]))
    out = set()
    for i, q in ok:
        if is_query(i):
            all_ = sorted({(-sum(a * b for a, b in zip(q, d)), j) for j, d in ok if j != i})
            out |= {(i, s, j) for s, j in all_}
    best = []
    for i in {i for i, _, _ in out}:
        best += [(i, r + 1, j, -s) for r, (s, j) in enumerate(sorted((s, j) for q, s, j in out if q == i)[:k])]
    return sorted(best)


def test_query(spark, embeddings):
    got = queries.op9_top_k_search(spark, SF).collect()
    assert sorted(map(tuple, got)) == slow_top([(r.vec_id, r.embedding) for r in embeddings.collect()], lambda i: i % 50 == 0, 5)


@pytest.mark.parametrize("d,block", [(2, 40), (9, 25), (30, 10 ** 6)])
def test_crowds_ties_and_edges(spark, monkeypatch, d, block):
    monkeypatch.setattr(topk, "BLOCK", block)
    monkeypatch.setattr(topk, "LEAF", 16)
    rng = np.random.default_rng(d)
    rows = [(i, (rng.standard_normal(d) * (1 + i % 4)).round(2).tolist()) for i in range(260)]
    rows += [(260 + i, rows[3][1]) for i in range(60)] + [(10, rows[10][1])]
    rows += [(400, None), (401, [1.0, None]), (402, [float("nan")] * d), (403, [float("-inf")] * d), (None, [1.0] * d), (404, []), (405, [0.0] * d), (406, [1.5])]
    df = spark.createDataFrame([(i, v, 1, 2) for i, v in rows], "vec_id long, embedding array<double>, score int, RANK int")
    got = topk.top_k(df, F.expr("vec_id % 10 = 0"), k=4).collect()
    assert sorted(map(tuple, got)) == slow_top(rows, lambda i: i % 10 == 0, 4)
    assert topk.top_k(df.limit(0), F.expr("vec_id % 10 = 0")).count() == 0


def test_queries_of_a_node_in_many_parts(spark, monkeypatch):
    """Every row asks, in one crowded node whose bound lets nothing be left out."""
    monkeypatch.setattr(topk, "BLOCK", 30)
    monkeypatch.setattr(topk, "PIVOTS", 2)
    rng = np.random.default_rng(4)
    rows = [(i, (rng.standard_normal(8)).tolist()) for i in range(150)] + [(7, [9.0] * 8)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert sorted(map(tuple, topk.top_k(df, F.lit(True), k=3).where("query_id <> 7").collect())) == [r for r in slow_top(rows, lambda i: True, 3) if r[0] != 7]


def test_few_rows_and_large_numbers(spark):
    rows = [(0, [1e7, 3.0]), (1, [1e7, 3.5]), (2, [-1e7, 2.25])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert sorted(map(tuple, topk.top_k(df, F.lit(True)).collect())) == slow_top(rows, lambda i: True, 5)
    huge = spark.createDataFrame([(0, [1e300]), (1, [1e300]), (2, [1e308])], "vec_id long, embedding array<double>")
    assert sorted(map(tuple, topk.top_k(huge, F.lit(True)).collect())) == [(0, 1, 1, 2 ** 63 - 1), (1, 1, 0, 2 ** 63 - 1)]


def test_tree_covers_its_rows():
    x = np.random.default_rng(1).standard_normal((500, 6))
    def walk(node):
        assert (topk.distances(x[node.rows], node.centre[None]) <= node.radius).all()
        if node.children:
            assert sorted(np.concatenate([c.rows for c in node.children])) == sorted(node.rows)
        for c in node.children:
            walk(c)
    walk(topk.cover_tree(x, np.arange(500), 20))
