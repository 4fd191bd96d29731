"""Near-duplicate and line deduplication against brute force."""

import hashlib
import zlib
from collections import defaultdict

import numpy as np
import pytest
import xxhash
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ledgerlens.llm import line_dedup, neardup_vec, queries, simhash
from ledgerlens.llm.common import components

from .conftest import EDGE, SF

BLANK = " \t\n\x0b\x0c\r"


def union_find(nodes, links):
    up = {n: n for n in nodes}

    def root(n):
        while up[n] != n:
            n = up[n]
        return n
    for a, b in links:
        x, y = root(a), root(b)
        up[max(x, y)] = min(x, y)
    return {n: root(n) for n in nodes}


def slow_fingerprint(text):
    w = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for b in BLANK:
        w = w.replace(b, " ")
    w = [x for x in w.split(" ") if x]
    if not w:
        return 0
    h = [xxhash.xxh64(" ".join(w[i:i + 3]).encode(), seed=42).intdigest() for i in range(max(1, len(w) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def slow_groups(rows):
    prints = {i: slow_fingerprint(t) for i, t in rows}
    ids = sorted(prints)
    links = [(a, b) for a in ids for b in ids if a < b and (prints[a] ^ prints[b]).bit_count() <= 2]
    return prints, union_find(ids, links)


def test_simhash_query(spark, documents):
    prints, root = slow_groups([(r.doc_id, r.text) for r in documents.collect()])
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in queries.op1_simhash_near_dedup(spark, SF).collect()}
    assert got == {i: (f"{prints[i]:016x}", root[i]) for i in prints}


def test_simhash_edges(edge, empty):
    prints, root = slow_groups([(r[0], r[1]) for r in EDGE if r[0] is not None])
    got = simhash.simhash_groups(edge).collect()
    assert len(got) == len(EDGE)
    assert {r.doc_id: (r.fp % 2 ** 64, r.component_id) for r in got if r.doc_id is not None} == {i: (prints[i], root[i]) for i in prints}
    assert simhash.simhash_groups(empty).count() == 0


@pytest.mark.parametrize("max_bits,segments", [(0, 2), (1, 2), (2, 2), (3, 2), (3, 4), (5, 4)])
def test_close_pairs_are_whole(spark, max_bits, segments):
    rng = np.random.default_rng(max_bits)
    base = rng.integers(0, 2 ** 64, 15, dtype=np.uint64)
    prints = {int(x) for x in base} | {0, 2 ** 64 - 1}
    for x in base:
        for _ in range(12):
            prints.add(int(x) ^ sum(1 << int(b) for b in rng.integers(0, 64, rng.integers(1, 7))))
    prints = sorted(prints)
    df = spark.createDataFrame([(x if x < 2 ** 63 else x - 2 ** 64, i) for i, x in enumerate(prints)], "fp long, node long")
    got = {(min(r), max(r)) for r in simhash.close_pairs(df, max_bits, segments).collect()}
    assert got == {(i, j) for j in range(len(prints)) for i in range(j) if (prints[i] ^ prints[j]).bit_count() <= max_bits}


def test_components(spark):
    rng = np.random.default_rng(3)
    links = [(int(a), int(b)) for a, b in rng.integers(0, 300, (220, 2))] + [(i, i + 1) for i in range(400, 460)] + [(999, k) for k in range(500, 600)] + [(7, 7)]
    want = union_find({n for l in links for n in l}, links)
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {n: c for n, c in want.items() if any(n in l and l[0] != l[1] for l in links)}


def slow_lines(rows):
    def key(line):
        return "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(BLANK))
    holders = defaultdict(set)
    for i, t in rows:
        for line in (t or "").split("\n"):
            if i is not None and len(key(line)) >= 10:
                holders[key(line)].add(i)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if i is None or len(key(x)) < 10 or i == min(holders[key(x)])]
        out.append((i, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=repr)


def test_line_query(spark, documents):
    got = queries.op5_line_dedup(spark, SF).collect()
    assert sorted(map(tuple, got), key=repr) == slow_lines([(r.doc_id, r.text) for r in documents.collect()])


def test_line_edges(spark, edge, empty):
    rows = [(r[0], r[1]) for r in EDGE]
    maps = line_dedup.keep_bitmaps(edge)
    got = (spark.createDataFrame(rows, "doc_id long, text string").withColumn("row_key", F.xxhash64("text"))
           .join(maps, ["doc_id", "row_key"], "left").select("doc_id", "n_lines", "n_dropped", line_dedup.kept_text("text", "keep").alias("t")).collect())
    want = slow_lines(rows)
    told = sorted(((r.doc_id, r.n_lines, r.n_dropped, hashlib.sha256(r.t.encode()).hexdigest()) for r in got if r.doc_id is not None), key=repr)
    assert told == [r for r in want if r[0] is not None]
    assert [r.t for r in got if r.doc_id is None] == ["The same shared line here\nwithout an id"]
    assert line_dedup.keep_bitmaps(empty).count() == 0


def test_common_line_spans_ranges(spark):
    n = 3000
    rows = [(i, f"the very common line\nown line of document {i}") for i in range(n)]
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    try:
        maps = line_dedup.keep_bitmaps(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert sum(r.n_dropped for r in maps) == n - 1
    first = next(r for r in maps if r.doc_id == 0)
    assert first.n_dropped == 0 and zlib.decompress(first.keep) == np.packbits([1, 1]).tobytes()


def slow_vectors(rows, threshold):
    ok = [(i, np.array(v, float)) for i, v in rows if neardup_vec.usable(v)]
    n, links = defaultdict(int), []
    for x in range(len(ok)):
        for y in range(x):
            a, b = ok[x][1], ok[y][1]
            if len(a) == len(b) and a @ b / np.sqrt((a @ a) * (b @ b)) >= threshold:
                links.append((ok[x][0], ok[y][0]))
                n[x] += 1
                n[y] += 1
    root = union_find([i for i, _ in rows], links)
    links_of = defaultdict(list)
    for x, (i, _) in enumerate(ok):
        links_of[i].append(n[x])
    return sorted((i, links_of[i].pop() if links_of[i] else 0, root[i]) for i, _ in rows)


def test_embedding_query(spark, embeddings):
    want = slow_vectors([(r.vec_id, r.embedding) for r in embeddings.collect()], 0.9)
    got = queries.op3_embedding_near_dedup(spark, SF).collect()
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in got) == want
    assert all(r.kept == (r.vec_id == r.component_id) for r in got)


@pytest.mark.parametrize("d", [3, 8, 20])
def test_embedding_crowd_and_edges(spark, monkeypatch, d):
    monkeypatch.setattr(neardup_vec, "TILE", 40)
    rng = np.random.default_rng(d)
    centres = rng.standard_normal((6, d))
    rows = [(i, (centres[i % 6] * (1 + i % 3) + 0.16 * rng.standard_normal(d)).tolist()) for i in range(240)]
    rows += [(240 + i, rows[5][1]) for i in range(50)] + [(300, None), (301, []), (302, [0.0] * d), (303, [1.0, None] + [0.0] * (d - 2)),
             (304, [float("nan")] * d), (305, [float("inf")] * d), (306, [1e200] * d), (307, [1e-200] * d), (308, [1.0]), (309, [2.0])]
    df = spark.createDataFrame([(i, v, "x", 0) for i, v in rows], "vec_id long, embedding array<double>, VEC_ID string, n long")
    got = sorted(tuple(r) for r in neardup_vec.near_duplicates(df).collect())
    big = {306, 307}        # their squares don't fit a double; equal directions link
    assert [r for r in got if r[0] not in big] == [r for r in slow_vectors([x for x in rows if x[0] not in big], 0.9)]
    assert [r for r in got if r[0] in big] == [(306, 1, 306), (307, 1, 306)]
    assert neardup_vec.near_duplicates(df.limit(0)).count() == 0


@given(st.integers(2, 40), st.data())
def test_local_groups(n, data):
    links = data.draw(st.lists(st.tuples(st.integers(0, n - 1), st.integers(0, n - 1)), max_size=40))
    want = union_find(range(n), links)
    got = neardup_vec.local_groups(np.array(links, np.int64).reshape(-1, 2), n)
    assert got.tolist() == [want[i] for i in range(n)]


def test_line_query_keeps_rows_without_an_id(spark, tmp_path):
    rows = [(1, "a line that both of them have\nown"), (None, "a line that both of them have\nother"), (None, None)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {(r.doc_id, r.n_lines, r.n_dropped, r.kept_sha256) for r in queries.op5_line_dedup(spark, str(tmp_path)).collect()}
    assert got == {(i, len((t or "").split("\n")), 0, hashlib.sha256((t or "").encode()).hexdigest()) for i, t in rows}
