"""Exact top-k inner products by dual-tree search.

Queries and data share one index.  Pivots chosen farthest-first from a bounded
sample cover all vectors; each vector goes to its nearest pivot, and a crowded
pivot's vectors are dealt to several blocks.  A first pass searches every
query's own block and so gives each query group a worst kth score.  A block is
then sent those query groups only whose bound, from the two covering radii,
reaches that score.  Inside a task both sides are cover trees of farthest-first
children, and node pairs are pruned in the same way down to the leaves.

Vectors take part as floor(256 * x), x in double precision; scores are integer
inner products, exact also where doubles are not (then Python integers are
used; scores outside 64 bits are clipped to them).

Defined cases: vectors that are null or hold null or non-finite components
take no part, nor do rows with a null id.  A shorter vector is padded with
zeros.  A query's own id is no candidate, so rows that repeat it aren't either;
other repeated rows are one candidate.  Ties go to the smaller id.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage
from .common import take

PIVOTS = 32             # groups of the index
SAMPLE = 2000           # vectors from which pivots are chosen
BLOCK = 16384           # vectors in a block at most, about
LEAF, FANOUT = 256, 8   # of the trees inside a task
EXACT = float(2 ** 53)
FOUND = "query_id long, vec_id long, score long"


def quantised(v) -> np.ndarray | None:
    """floor(256 * x) as doubles, or None if the vector takes no part."""
    if v is None or any(x is None for x in v):
        return None
    x = np.array(v, np.float64)
    with np.errstate(over="ignore"):
        q = np.floor(256.0 * x)
    return q if np.isfinite(x).all() and np.isfinite(q).all() else None


def stack(blobs) -> np.ndarray:
    """Rows of doubles, padded with zeros to the longest."""
    rows = [np.frombuffer(b, np.float64) for b in blobs]
    out = np.zeros((len(rows), max(map(len, rows), default=0)))
    for i, r in enumerate(rows):
        out[i, :len(r)] = r
    return out


def distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Euclidean distances, not below the true ones by more than rounding."""
    with np.errstate(over="ignore", invalid="ignore"):
        d2 = (x * x).sum(1)[:, None] + (c * c).sum(1) - 2 * (x @ c.T)
    return np.sqrt(np.maximum(np.nan_to_num(d2, nan=np.inf, posinf=np.inf), 0))


def farthest_first(x: np.ndarray, k: int) -> np.ndarray:
    """Indices of up to k points, each the farthest from those before it."""
    chosen, near = [0], distances(x, x[:1])[:, 0]
    while len(chosen) < min(k, len(x)):
        i = int(near.argmax())
        if not near[i] > 0:
            break
        chosen.append(i)
        near = np.minimum(near, distances(x, x[i:i + 1])[:, 0])
    return np.array(chosen)


@dataclass
class Node:
    centre: np.ndarray
    radius: float
    rows: np.ndarray
    children: list


def cover_tree(x: np.ndarray, rows: np.ndarray, leaf: int) -> Node:
    """Nodes hold their rows within a covering radius of their centre; the
    children are farthest-first centres with the rows nearest to them."""
    centre = x[rows[0]] if len(rows) else np.zeros(x.shape[1])
    to = distances(x[rows], centre[None])[:, 0] if len(rows) else np.zeros(0)
    node = Node(centre, float(to.max(initial=0.0)) * (1 + 1e-9) + 1e-6, rows, [])
    if len(rows) > leaf and to.max() > 0:
        c = farthest_first(x[rows], FANOUT)
        near = distances(x[rows], x[rows[c]]).argmin(1)
        node.children = [cover_tree(x, np.concatenate(([rows[c[j]]], rows[(near == j) & (np.arange(len(rows)) != c[j])])), leaf)
                         for j in range(len(c))] if len(c) > 1 else []
    return node


def bound(a_centre, a_radius, b_centre, b_radius) -> float:
    """No inner product between the two balls is greater."""
    with np.errstate(over="ignore", invalid="ignore"):
        v = float(a_centre @ b_centre + a_radius * np.linalg.norm(b_centre) + b_radius * np.linalg.norm(a_centre) + a_radius * b_radius)
        return (v + abs(v) * 1e-9 + 1.0) if np.isfinite(v) else np.inf


def search(q_ids, q, floor, d_ids, d, k: int):
    """(query index, id, score) of each query's best k among the data, none
    below its ``floor``; floor: scores that the kth result must reach."""
    width = max(q.shape[1], d.shape[1])
    q, d = (np.pad(m, ((0, 0), (0, width - m.shape[1]))) for m in (q, d))
    order = np.argsort(d_ids, kind="stable")
    d_ids, d = d_ids[order], d[order]
    exact = width * np.abs(q).max(initial=0) * np.abs(d).max(initial=0) < EXACT
    best = [[] for _ in q_ids]                  # heaps of (score, -id)
    worst = np.array(floor, dtype=float)

    def leaf(a: Node, b: Node):
        cols = np.sort(b.rows)
        if exact:
            s = q[a.rows] @ d[cols].T
        else:
            s = np.array([[int(x) for x in r] for r in q[a.rows]], object) @ np.array([[int(x) for x in r] for r in d[cols]], object).T
        for i, r in enumerate(a.rows):
            hit = np.flatnonzero(s[i] >= worst[r])
            if len(hit) > 4 * k:                # the best by score; ties by the smaller id, as columns are in order of id
                hit = hit[np.argsort(-s[i][hit], kind="stable")[:k + 1]]
            heap = best[r]
            for j in hit:
                if d_ids[cols[j]] != q_ids[r]:
                    item = (int(s[i][j]), -int(d_ids[cols[j]]))
                    if len(heap) < k:
                        heapq.heappush(heap, item)
                    elif item > heap[0]:
                        heapq.heapreplace(heap, item)
            if len(heap) == k:
                worst[r] = max(worst[r], heap[0][0])

    root = (cover_tree(q, np.arange(len(q)), 64), cover_tree(d, np.arange(len(d)), LEAF))
    heap, n = [(-np.inf, 0, *root)], 0
    while heap and len(q) and len(d):
        up, _, a, b = heapq.heappop(heap)
        if -up < worst[a.rows].min():
            continue
        if not a.children and not b.children:
            leaf(a, b)
            continue
        split_a = a.children and (not b.children or a.radius >= b.radius)
        for c in (a.children if split_a else b.children):
            x, y = (c, b) if split_a else (a, c)
            top = bound(x.centre, x.radius, y.centre, y.radius)
            if top >= worst[x.rows].min():
                n += 1
                heapq.heappush(heap, (-top, n, x, y))
    return [(r, -i, s) for r, h in enumerate(best) for s, i in h]


def place(vectors: DataFrame, id_col: str, vec_col: str) -> tuple[DataFrame, np.ndarray]:
    """(vec_id, v, node, far) of every vector that takes part, and the pivots;
    far is the distance from the pivot of its node.  Repeated rows are one."""
    @F.arrow_udf("binary")
    def quantise(vs: pa.Array) -> pa.Array:
        q = [quantised(v.as_py()) for v in vs]
        return pa.array([None if x is None else x.tobytes() for x in q], pa.binary())

    rows = (take(vectors, id_col, vec_col).where(F.col(id_col).isNotNull())
            .select(F.col(id_col).cast("long").alias("vec_id"), quantise(F.col(vec_col)).alias("v")).where("v is not null")
            .distinct())
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id", "v").limit(SAMPLE).collect()      # a bounded sample
    points = stack([bytes(r.v) for r in sample])
    pivots = points[farthest_first(points, PIVOTS)] if len(points) else np.zeros((1, 0))

    @F.arrow_udf("struct<node:int,far:double>")
    def assign(vs: pa.Array) -> pa.Array:
        x = stack([b.as_py() for b in vs])
        width = max(x.shape[1], pivots.shape[1])
        x, p = (np.pad(m, ((0, 0), (0, width - m.shape[1]))) for m in (x, pivots))
        d = distances(x, p)
        node = d.argmin(1).astype(np.int32)
        return pa.StructArray.from_arrays([pa.array(node), pa.array(d[np.arange(len(x)), node])], ["node", "far"])

    placed = rows.withColumn("p", assign("v")).select("vec_id", "v", "p.node", "p.far")
    return cut_lineage(placed, "placed-vectors"), pivots


def top_k(vectors: DataFrame, is_query, k: int = 5, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k best of every row for which the
    condition ``is_query`` over vec_id holds, among all other rows."""
    placed, pivots = place(vectors, id_col, vec_col)
    # one row per pivot: at most PIVOTS
    nodes = {r.node: r for r in placed.groupBy("node").agg(F.count("*").alias("n"), F.max("far").alias("far")).collect()}
    blocks = F.element_at(F.create_map(*[F.lit(x) for i, r in nodes.items() for x in (i, -(-r.n // BLOCK))]), F.col("node")) if nodes else F.lit(1)
    dealt = placed.withColumn("block", F.pmod(F.xxhash64("vec_id"), blocks).cast("int"))
    data = dealt.select("node", "block", "vec_id", "v")
    queries = dealt.where(is_query).select("node", "block", F.col("vec_id").alias("query_id"), "v", "far")

    def task(key, left, right):
        q, d = stack(left["v"].to_pylist()), stack(right["v"].to_pylist())
        ids = left["query_id"].to_numpy()
        found = search(ids, q, left["least"].to_numpy(), right["vec_id"].to_numpy(), d, k) if len(q) and len(d) else []
        clip = lambda s: max(min(s, 2 ** 63 - 1), -2 ** 63)
        return pa.table({"query_id": pa.array([int(ids[r]) for r, _, _ in found], pa.int64()), "vec_id": pa.array([i for _, i, _ in found], pa.int64()),
                         "score": pa.array([clip(s) for _, _, s in found], pa.int64())})

    own = cut_lineage(queries.withColumn("least", F.lit(float("-inf"))).groupBy("node", "block")
                      .cogroup(data.groupBy("node", "block")).applyInArrow(task, FOUND), "own-block")
    kth = own.groupBy("query_id").agg(F.when(F.count("*") >= k, F.min("score")).alias("kth"))
    known = cut_lineage(queries.join(kth, "query_id", "left")
                        .withColumn("least", F.coalesce(F.col("kth").cast("double"), F.lit(float("-inf")))).drop("kth"), "known-worst")
    groups = {r.node: r for r in known.groupBy("node").agg(F.min("least").alias("worst"), F.max("far").alias("far"), F.count("*").alias("n")).collect()}
    send = [(i, b, g) for i, r in nodes.items() for g, w in groups.items() for b in [-(-r.n // BLOCK)]
            if bound(pivots[g], w.far * (1 + 1e-9) + 1e-6, pivots[i], r.far * (1 + 1e-9) + 1e-6) >= w.worst]
    # a node's queries are dealt to parts of bounded size, and each of its blocks meets every part
    parts = {i: -(-sum(groups[g].n for j, _, g in send if j == i) // BLOCK) for i in nodes}
    # at most PIVOTS * PIVOTS rows, and PIVOTS
    pairs = known.sparkSession.createDataFrame([(i, b, parts[i], g) for i, b, g in send], "to_node int, blocks int, parts int, node int")
    many = known.sparkSession.createDataFrame([(i, p) for i, p in parts.items() if p], "node int, parts int")
    sent = (known.withColumnRenamed("block", "own").join(F.broadcast(pairs), "node")
            .withColumn("part", F.pmod(F.xxhash64("v", "query_id"), F.col("parts")).cast("int"))
            .withColumn("to_block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
            .where("not (to_node = node and to_block = own)")
            .select(F.col("to_node").alias("node"), F.col("to_block").alias("block"), "part", "query_id", "v", "least"))
    met = data.join(F.broadcast(many), "node").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
    key = ("node", "block", "part")
    rest = sent.groupBy(*key).cogroup(met.groupBy(*key)).applyInArrow(task, FOUND)
    place_of = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (own.unionByName(rest).distinct().withColumn("rank", F.row_number().over(place_of)).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))
