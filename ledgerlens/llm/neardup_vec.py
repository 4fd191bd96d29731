"""Embedding near-duplicates by a subspace pigeonhole join.

For unit vectors cosine >= t means squared distance <= 2 - 2t.  A fixed
rotation spreads every difference over all coordinates; the rotated vectors
are cut into low-dimensional blocks, and a pair within the whole budget is
within its proportional share on one block at least.  So each block is
range-joined alone: vectors are filed under a grid over the block's first
coordinates with cells as wide as the block's radius, and sent to half of the
neighbouring cells.  Inside a cell the block distances pick the candidates,
and the exact cosine of the whole vectors decides.  A pair that several blocks
find counts for the first of them.

Crowded cells are dealt into tiles: every two parts of a cell meet in one
task.  Tasks return, for each vector, how many links they saw and one member
of its linked group, never the pairs.

Defined cases: vectors that are null, empty, zero or hold null or non-finite
components link with nothing.  Vectors of different lengths never link.  Equal
vectors are compared once, with their number.  Repeated rows are vectors of
their own; rows with a null id take no part and get no links.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .common import components, take

BLOCK_DIMS = 16     # coordinates of a block
GRID_DIMS = 2       # of them in the grid
TILE = 16384        # vectors of a cell's part, about
SLICE = 256         # rows of a distance matrix at a time
SEEN = "a long, b long, n long"


def rotation(d: int) -> np.ndarray:
    """A fixed random rotation."""
    q, r = np.linalg.qr(np.random.default_rng(d).standard_normal((d, d)))
    return q * np.sign(np.diag(r))


def block_starts(d: int) -> list[int]:
    return list(range(0, d, BLOCK_DIMS))


def unit(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length one; scaled by their largest component first, so
    that squares don't overflow or vanish."""
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def budget(threshold: float, d: int) -> float:
    """A block's share of the squared distance, with room for rounding."""
    return (2 - 2 * threshold) / len(block_starts(d)) + 1e-9


def neighbours() -> list[tuple[int, ...]]:
    """Half of the steps to the neighbouring cells: of two cells next to each
    other, one sends to the other."""
    steps = np.stack(np.meshgrid(*[[-1, 0, 1]] * GRID_DIMS, indexing="ij"), -1).reshape(-1, GRID_DIMS)
    return [tuple(s) for s in steps.tolist() if tuple(s) > (0,) * GRID_DIMS]


def local_groups(links: np.ndarray, n: int) -> np.ndarray:
    """Smallest index reachable from each of n points over links (i, j)."""
    label = np.arange(n)
    while len(links):
        low = np.minimum(label[links[:, 0]], label[links[:, 1]])
        new = label.copy()
        np.minimum.at(new, links[:, 0], low)
        np.minimum.at(new, links[:, 1], low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    return label


def tile_links(x: np.ndarray, guest: np.ndarray, part: np.ndarray, same: bool, block: int, threshold: float):
    """Index pairs (i, j) of one tile that are linked and first found in this block.

    ``guest``: the vector came from a neighbouring cell; two guests don't meet
    here.  ``part``: which of the tile's two parts it is of; with ``same`` the
    tile is one part and all meet, else only vectors of different parts do.
    """
    d = x.shape[1]
    starts, room = block_starts(d), budget(threshold, d)
    u = unit(x)
    r = u @ rotation(d)
    s = r[:, starts[block]:starts[block] + BLOCK_DIMS].astype(np.float32)
    # |s - t|^2 <= room as one product: s.t - |s|^2 / 2 - |t|^2 / 2 >= -room / 2, with room for single precision
    half, one = -(s * s).sum(1, keepdims=True) / 2, np.ones((len(s), 1), np.float32)
    a_side, b_side, least = np.hstack([s, half, one]), np.hstack([s, one, half]), np.float32(-room / 2 - 1e-5)
    index = np.arange(len(x))
    if same:
        hosts = index[~guest]
        meetings = [(hosts, np.concatenate([hosts, index[guest]]), True)]
    else:
        first, other = part == 0, part == 1
        meetings = [(index[first & ~guest], index[other], False), (index[first & guest], index[other & ~guest], False)]
    out = []
    for left, right, triangle in meetings:
        for at in range(0, len(left), SLICE):
            rows, columns = left[at:at + SLICE], right[at if triangle else 0:]
            i, j = np.nonzero(a_side[rows] @ b_side[columns].T >= least)
            if triangle:
                i, j = i[j > i], j[j > i]
            i, j = rows[i], columns[j]
            for lo in range(0, len(i), 200_000):
                a, b = i[lo:lo + 200_000], j[lo:lo + 200_000]
                linked = np.einsum("ij,ij->i", u[a], u[b]) >= threshold
                a, b = a[linked], b[linked]
                here = np.ones(len(a), bool)
                for e in starts[:block + 1]:
                    inside = ((r[a, e:e + BLOCK_DIMS] - r[b, e:e + BLOCK_DIMS]) ** 2).sum(1) <= room
                    here &= inside if e == starts[block] else ~inside
                if here.any():
                    out.append(np.column_stack([a[here], b[here]]))
    return np.concatenate(out) if out else np.zeros((0, 2), np.int64)


def tally(links: np.ndarray, ids: np.ndarray, copies: np.ndarray) -> pa.Table:
    """(a, b, n): vector, a member of its linked group, links seen."""
    group = local_groups(links, len(ids))
    n = np.zeros(len(ids), np.int64)
    np.add.at(n, links[:, 0], copies[links[:, 1]])
    np.add.at(n, links[:, 1], copies[links[:, 0]])
    has = np.flatnonzero(n)
    return pa.table({"a": ids[has], "b": ids[group[has]], "n": n[has]})


def usable(v) -> bool:
    if not v or any(x is None for x in v):
        return False
    x = np.array(v, np.float64)
    return bool(np.isfinite(x).all() and np.abs(x).max() > 0)


def near_duplicates(vectors: DataFrame, threshold: float = 0.9, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(vec_id, n_links, component_id) of every row."""
    single = take(vectors, vec_col).schema[0].dataType.elementType.typeName() == "float"
    kind = np.dtype("<f4" if single else "<f8")         # the column's own precision; all sums are in doubles

    @F.arrow_udf("binary")
    def payload(vs: pa.Array) -> pa.Array:
        return pa.array([(np.array(v, kind) + kind.type(0)).tobytes() if usable(v) else None for v in vs.to_pylist()], pa.binary())

    rows = cut_lineage(take(vectors, id_col, vec_col)
                       .select(F.col(id_col).cast("long").alias("vec_id"), payload(vec_col).alias("v"))
                       .select("vec_id", F.when(F.col("vec_id").isNotNull(), F.col("v")).alias("v"))
                       .withColumns({"h1": F.xxhash64("v"), "h2": F.hash("v")}), "vectors")
    reps = cut_lineage(rows.where("v is not null").groupBy("h1", "h2", "v")
                       .agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies")), "distinct-vectors")

    @F.arrow_udf("array<struct<cell:string,guest:boolean>>")
    def cells(vs: pa.Array) -> pa.Array:
        steps, out = neighbours(), []
        for v in vs:
            x = np.frombuffer(v.as_py(), kind).astype(np.float64)
            d = len(x)
            r, width = (unit(x[None]) @ rotation_of(d))[0], np.sqrt(budget(threshold, d))
            mine = []
            for b, at in enumerate(block_starts(d)):
                home = tuple(np.floor(r[at:at + min(GRID_DIMS, d - at)] / width).astype(int).tolist())
                mine.append({"cell": f"{d}:{b}:{home}", "guest": False})
                mine += [{"cell": f"{d}:{b}:{tuple(h + s for h, s in zip(home, step))}", "guest": True}
                         for step in {s[:len(home)] for s in steps if any(s[:len(home)])}]
            out.append(mine)
        return pa.array(out, pa.list_(pa.struct([("cell", pa.string()), ("guest", pa.bool_())])))

    known: dict[int, np.ndarray] = {}

    def rotation_of(d: int) -> np.ndarray:
        if d not in known:
            known[d] = rotation(d)
        return known[d]

    filed = (reps.select("rep", "copies", "v", F.explode(cells("v")).alias("c"))
             .select("rep", "copies", "v", "c.cell", "c.guest"))
    crowded = (filed.groupBy("cell").agg(F.count("*").alias("n")).where(F.col("n") > TILE)
               .select("cell", F.ceil(F.col("n") / TILE).cast("int").alias("parts")))
    crowded = cut_lineage(crowded, "crowded-cells")
    dealt = (filed.join(crowded, "cell", "left")
             .withColumn("parts", F.coalesce("parts", F.lit(1)))
             .withColumn("part", F.pmod(F.xxhash64("rep"), F.col("parts")).cast("int"))
             .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
             .select("cell", F.least("part", "other").alias("low"), F.greatest("part", "other").alias("high"),
                     "rep", "copies", "v", "guest", (F.col("part") > F.col("other")).cast("int").alias("side")))

    def task(key, t):
        ids = t["rep"].to_numpy()
        if len(ids) < 2 or all(t["guest"].to_pylist()):
            return pa.table({n: pa.array([], pa.int64()) for n in ("a", "b", "n")})
        x = np.stack([np.frombuffer(v, kind) for v in t["v"].to_pylist()]).astype(np.float64)
        block = int(key[0].as_py().split(":")[1])
        links = tile_links(x, np.array(t["guest"].to_pylist()), t["side"].to_numpy(), key[1] == key[2], block, threshold)
        return tally(links, ids, t["copies"].to_numpy())

    seen = cut_lineage(dealt.groupBy("cell", "low", "high").applyInArrow(task, SEEN), "links-seen")
    links = seen.groupBy("a").agg(F.sum("n").alias("n"))
    groups = components(seen.select("a", "b"))
    told = (reps.join(links, F.col("rep") == F.col("a"), "left").join(groups, F.col("rep") == F.col("node"), "left")
            .select("h1", "h2", "v", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
                    F.coalesce("component", "rep").alias("component_id")))
    linked = (rows.where("v is not null").join(told, ["h1", "h2", "v"])
              .select("vec_id", "n_links", "component_id"))
    return linked.unionByName(rows.where("v is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id")))
