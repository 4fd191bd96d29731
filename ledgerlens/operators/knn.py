"""k-nearest-neighbour join (C7), SMOTE (C6) and the kNN classifier.

The join is exact without meeting every pair:

1. Centres drawn from a bounded sample of the base rows cut the space into
   cells; every row belongs to its nearest centre, and a crowded cell's base
   rows are dealt to several blocks of bounded size.
2. Pilot: each query meets one block of its own cell and keeps its k closest;
   the k-th distance ``d_k`` bounds the true k-th neighbour distance.
3. By the triangle inequality a cell can hold a nearer row only if the query's
   distance from its centre, less the cell's radius, is at most ``d_k``: the
   query is sent to the blocks of those cells only.

A block's pairs are sifted by a matrix product in Arrow batches, the distances of
those that may count are computed feature by feature, and only
the k best of each query leave the task, so what is shuffled is query rows and
k candidates for each block they meet, never pairs.  ``approx=True`` sends each
query to the blocks of its ``probes`` nearest cells instead of step 3.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import config as C
from ..functions.dist import uniform_rank
from ..functions.rand import md5_uniform
from ..session import reliable, spread

MAX_CELLS = 256            # centres, and rows of the cell table on the driver, or the root of the base rows if that is more
CELL_ROWS = 512            # base rows for each centre, until there are MAX_CELLS
BLOCK_ROWS = 4096          # target base rows of a block
TILE_PAIRS = 65_536        # entries of a distance matrix, which should fit a core's cache
PAIRS = "q_id long, b_id long, dist double"
PAIRS_SCHEMA = pa.schema([("q_id", pa.int64()), ("b_id", pa.int64()), ("dist", pa.float64())])


def distances(q: np.ndarray, b: np.ndarray, metric: str) -> np.ndarray:
    """Distance matrix, summed feature by feature as SQL would."""
    out = np.zeros((len(q), len(b)))
    for i in range(q.shape[1]):
        d = q[:, i:i + 1] - b[:, i]
        out += np.abs(d) if metric == "manhattan" else d * d
    return out if metric == "manhattan" else np.sqrt(out)


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    flat = column.combine_chunks()
    return flat.values.to_numpy(zero_copy_only=False).reshape(len(flat), -1) if len(flat) else np.zeros((0, 0))


def _paired(q: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray, metric: str) -> np.ndarray:
    """Entries (i, j) of :func:`distances`, to the last bit."""
    out = np.zeros(np.broadcast(i, j).shape)
    for f in range(q.shape[1]):
        d = q[i, f] - b[j, f]
        out += np.abs(d) if metric == "manhattan" else d * d
    return out if metric == "manhattan" else np.sqrt(out)


def _squares(q: np.ndarray, b: np.ndarray):
    """Squared euclidean distances by a matrix product, and by how much they may be off; both
    sides finite.  They are never above squared manhattan distances."""
    centre = b.mean(0)
    qc, bc = q - centre, b - centre
    q2, b2 = (qc * qc).sum(1), (bc * bc).sum(1)
    return q2[:, None] + b2 - 2.0 * (qc @ bc.T), 1e-12 * (q2 + b2.max()) + 1e-300


def _own_centres(q: np.ndarray, centres: np.ndarray, metric: str) -> tuple[np.ndarray, np.ndarray]:
    """A centre close to each row, and the row's distance from it.  Any choice of a centre keeps the
    join exact, so the euclidean distances of a matrix product choose for both metrics."""
    if not (np.isfinite(q).all() and np.isfinite(centres).all()):
        d = distances(q, centres, metric)
        return d.argmin(1), d.min(1)
    cell = _squares(q, centres)[0].argmin(1)
    return cell, _paired(q, centres, np.arange(len(q)), cell, metric)


def _within_reach(q: np.ndarray, centres: np.ndarray, radius: np.ndarray, reach: np.ndarray, metric: str) -> np.ndarray:
    """Which cells (rows x cells) may hold a row within ``reach`` of a row of ``q``: the distance from the
    centre less the radius is at most that.  A matrix product sifts them, the distances of the rest are exact."""
    if np.isfinite(q).all() and np.isfinite(centres).all():
        near, slack = _squares(q, centres)
        with np.errstate(invalid="ignore"):
            most = reach[:, None] + radius                  # below 0 or NaN (an empty cell): no row there
            some = (most >= 0) & (near <= most * most * (1 + 1e-9) + slack[:, None])
        if metric == "euclidean":
            return some
        i, j = np.nonzero(some)
        if 8 * len(i) < some.size:
            some[i, j] = _paired(q, centres, i, j, metric) - radius[j] <= reach[i]
            return some
    return distances(q, centres, metric) - radius <= reach[:, None]


def _nearest(q_id, q, limit, b_id, b, k: int, metric: str, exclude_self: bool) -> pa.Table:
    """The k nearest base rows of each query row, none beyond its limit; ties
    go to the smaller base id."""
    order = np.argsort(b_id, kind="stable")
    b_id, b = b_id[order], b[order]
    qs, bs, ds = [], [], []
    # a matrix product tells which pairs may count: it comes within ``slack`` of the squared
    # euclidean distance, which is never above the squared manhattan distance
    if not len(q) or not len(b):                        # an empty side has no columns either
        return PAIRS_SCHEMA.empty_table()
    finite = np.isfinite(q).all() and np.isfinite(b).all()
    tile = max(1, TILE_PAIRS // len(b))
    if finite:
        centre = b.mean(0)
        qc, bc = q - centre, b - centre
        q2, b2 = (qc * qc).sum(1), (bc * bc).sum(1)
    for at in range(0, len(q), tile):
        part, m = q[at:at + tile], min(k, len(b))
        own = q_id[at:at + tile][:, None] == b_id if exclude_self else None
        if finite:
            near = q2[at:at + tile, None] + b2 - 2.0 * (qc[at:at + tile] @ bc.T)
            slack = 1e-12 * (q2[at:at + tile] + b2.max()) + 1e-300
            if exclude_self:
                near[own] = np.inf
            few = np.argpartition(near, m - 1, axis=1)[:, :m]
            rows = np.arange(len(part))[:, None]
            kth = np.where(np.isinf(near[rows, few]), np.inf, _paired(part, b, rows, few, metric)).max(1)
            kth = np.minimum(kth, limit[at:at + tile])
            i, j = np.nonzero((near <= (kth * kth * (1 + 1e-9) + slack)[:, None]) & (near < np.inf))
            d = _paired(part, b, i, j, metric)
        else:
            full = distances(part, b, metric)
            if exclude_self:
                full[own] = np.inf
            kth = np.minimum(np.partition(full, m - 1, axis=1)[:, m - 1], limit[at:at + tile])
            i, j = np.nonzero(full < np.inf)
            d = full[i, j]
        some = d <= kth[i]
        i, j, d = i[some], j[some], d[some]
        best = np.lexsort((j, d, i))                    # columns are in order of base id
        i, j, d = i[best], j[best], d[best]
        first = np.searchsorted(i, i)
        keep = np.arange(len(i)) - first < k
        i, j, d = i[keep], j[keep], d[keep]
        qs.append(q_id[at + i])
        bs.append(b_id[j])
        ds.append(d)
    return pa.table({"q_id": np.concatenate(qs), "b_id": np.concatenate(bs), "dist": np.concatenate(ds)})


def knn_join(query: DataFrame, base: DataFrame, k: int, cols=None, metric: str = "euclidean",
             q_id: str = "id", b_id: str = "id", exclude_self: bool = False, seed: int = C.SEED,
             approx: bool = False, probes: int = 8, block_rows: int = BLOCK_ROWS, cell_rows: int = CELL_ROWS) -> DataFrame:
    """(q_id, b_id, dist, rank) for the k nearest base rows of every query row.

    Ties in distance are broken by the base id.  ``exclude_self`` drops pairs
    with equal ids (self-kNN).
    """
    cols = list(cols or C.FEATURES)
    metric = "euclidean" if metric in ("minkowski", "euclidean") else metric
    if metric not in ("euclidean", "manhattan"):
        raise ValueError(f"unsupported metric {metric!r}")
    vec = F.array(*[F.col(c).cast("double") for c in cols])
    b = spread(base.select(F.col(b_id).cast("long").alias("b_id"), vec.alias("bv")))
    n_base = b.count()
    if n_base == 0:
        return b.sparkSession.createDataFrame([], PAIRS + ", rank int")
    n_cells = int(max(1, min(max(MAX_CELLS, math.isqrt(n_base)), n_base // cell_rows)))
    sample = b.orderBy(F.xxhash64("b_id", F.lit(seed)), "b_id").limit(n_cells).collect()      # one row for each cell
    centres = np.array([r["bv"] for r in sample], dtype=float).reshape(len(sample), len(cols))

    @F.arrow_udf("struct<cell:int,far:double>")
    def place(v: pa.Array) -> pa.Array:
        x, tile = _matrix(pa.chunked_array([v])), max(1, TILE_PAIRS // len(centres))
        near = [_own_centres(x[at:at + tile], centres, metric) for at in range(0, len(x), tile)]
        cell, far = (np.concatenate(x) for x in zip(*near)) if near else (np.zeros(0), np.zeros(0))
        return pa.StructArray.from_arrays([pa.array(cell.astype(np.int32)), pa.array(far)], ["cell", "far"])

    b = reliable(b.withColumn("p", place("bv")).select("b_id", "bv", "p.cell", "p.far"))
    q = reliable(spread(query.select(F.col(q_id).cast("long").alias("q_id"), vec.alias("qv"))).withColumn("p", place("qv"))
                 .select("q_id", "qv", "p.cell"))
    cells = {r["cell"]: r for r in b.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("far").alias("radius")).collect()}
    n_blocks = np.array([-(-cells[c]["n"] // block_rows) if c in cells else 0 for c in range(n_cells)])
    radius = np.array([cells[c]["radius"] * (1 + 1e-9) + 1e-9 if c in cells else -np.inf for c in range(n_cells)])
    blocks_of = F.array(*[F.lit(int(n)) for n in n_blocks])
    b = b.withColumn("block", F.pmod(F.xxhash64("b_id"), F.greatest(F.lit(1), F.get(blocks_of, F.col("cell")))).cast("int"))

    def task(key, left, right):
        return _nearest(left["q_id"].to_numpy(), _matrix(left["qv"]), left["d_k"].to_numpy(), right["b_id"].to_numpy(), _matrix(right["bv"]),
                        k, metric, exclude_self)

    # distances cost far more than the bytes they come from tell, so the number of tasks is not left to those
    spark = b.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(int(n_blocks.sum()), 16 * spark.sparkContext.defaultParallelism))
    by_block = b.select("cell", "block", "b_id", "bv").repartition(tasks, "cell", "block")

    def meet(sent: DataFrame) -> DataFrame:
        return (sent.repartition(tasks, "cell", "block").groupBy("cell", "block")
                .cogroup(by_block.groupBy("cell", "block")).applyInArrow(task, PAIRS))

    infinite = F.lit(float("inf"))
    if not approx:
        own = q.withColumn("block", F.pmod(F.xxhash64("q_id"), F.greatest(F.lit(1), F.get(blocks_of, F.col("cell")))).cast("int"))
        pilot = reliable(meet(own.withColumn("d_k", infinite)))
        limit = pilot.groupBy("q_id").agg(F.max("dist").alias("d_k"), F.count(F.lit(1)).alias("_n"))
        # fewer than k pilot candidates: no finite bound, every cell is searched
        q = (own.withColumnsRenamed({"cell": "own_cell", "block": "own_block"}).join(limit, "q_id", "left")
             .withColumn("d_k", F.when(F.col("_n") >= k, F.col("d_k")).otherwise(infinite)).drop("_n"))
    else:
        q = q.withColumnRenamed("cell", "own_cell").withColumn("own_block", F.lit(-1)).withColumn("d_k", infinite)

    @F.arrow_udf("array<struct<cell:int,block:int>>")
    def send(v: pa.Array, limit: pa.Array) -> pa.Array:
        reach = limit.to_numpy(zero_copy_only=False) * (1 + 1e-9) + 1e-9
        sizes, cells_met = [], []
        x, tile = _matrix(pa.chunked_array([v])), max(1, TILE_PAIRS // len(centres))
        for at in range(0, len(x), tile):
            part = x[at:at + tile]
            if approx:
                d = distances(part, centres, metric)
                d[:, n_blocks == 0] = np.inf
                near = np.argsort(d, axis=1, kind="stable")[:, :probes]
                some = np.zeros(d.shape, bool)
                np.put_along_axis(some, near, True, axis=1)
            else:
                some = _within_reach(part, centres, radius, reach[at:at + tile], metric)
            sizes.append((some * n_blocks).sum(1))
            cells_met.append(np.nonzero(some)[1])
        cat = lambda x: np.concatenate(x) if x else np.zeros(0, int)
        met, ends = cat(cells_met), np.concatenate([[0], np.cumsum(cat(sizes))])
        times = n_blocks[met]
        block = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
        to = pa.StructArray.from_arrays([pa.array(np.repeat(met, times).astype(np.int32)), pa.array(block.astype(np.int32))], ["cell", "block"])
        return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), to)

    sent = (q.withColumn("to", F.explode(send("qv", "d_k"))).where("not (to.cell = own_cell and to.block = own_block)")
            .select("q_id", "qv", "d_k", "to.cell", "to.block"))
    found = meet(sent) if approx else pilot.unionByName(meet(sent))
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("q_id").orderBy("dist", "b_id")))
    return ranked.where(F.col("rank") <= k).select("q_id", "b_id", "dist", "rank")


# ---- C6 SMOTE ---------------------------------------------------------------

def smote(df: DataFrame, k: int = 5, seed: int = C.SEED, id_col: str = "id", by: str = C.TARGET,
          cols=None, minority: int = 1, synthetic_only: bool = False) -> DataFrame:
    """Add n_majority - n_minority synthetic minority rows.

    Synthetic row i: base = minority row of rank floor(u_b * n_min) + 1 in
    (md5, id) order; neighbour = its floor(u_n * k)-th nearest minority row
    (self excluded); k or fewer minority rows raise an error; x = base + u_g * (nn - base) on
    every feature.  Synthetic ids are negative (-1 - i) so they never collide.
    Originals are kept unless ``synthetic_only``.
    """
    cols = list(cols or C.FEATURES)
    counts = {r[0]: r[1] for r in df.groupBy(by).count().collect()}  # one row per class
    n_min = counts.get(minority, 0)
    n_maj = max([v for key, v in counts.items() if key != minority] or [0])
    n_new = max(n_maj - n_min, 0)
    spark = df.sparkSession
    keep = [id_col, *cols, by]
    if n_new == 0:
        return df.select(*keep).limit(0) if synthetic_only else df.select(*keep)
    if n_min <= k:
        raise ValueError(f"SMOTE with k={k} needs more than {k} rows of class {minority}, found {n_min}")
    kk = k
    mino = df.where(F.col(by) == minority).select(id_col, *cols)
    ranked = uniform_rank(mino.withColumn("_u", md5_uniform(seed, F.col(id_col))), [], "_u", id_col, "_rk") \
        .select(F.col("_rk").alias("base_rank"), F.col(id_col).alias("base_id"))
    nn = knn_join(mino, mino, kk, cols, "euclidean", id_col, id_col, exclude_self=True, seed=seed) \
        .select(F.col("q_id").alias("base_id"), F.col("rank").alias("nn_rank"), F.col("b_id").alias("nn_id"))
    draws = spark.range(n_new).select(
        F.col("id").alias("i"),
        (F.floor(md5_uniform(seed, "base", F.col("id")) * n_min) + 1).cast("long").alias("base_rank"),
        (F.floor(md5_uniform(seed, "nn", F.col("id")) * kk) + 1).cast("int").alias("nn_rank"),
        md5_uniform(seed, "gap", F.col("id")).alias("gap"))
    feats_b = mino.select(F.col(id_col).alias("base_id"), *[F.col(c).alias(f"x_{c}") for c in cols])
    feats_n = mino.select(F.col(id_col).alias("nn_id"), *[F.col(c).alias(f"n_{c}") for c in cols])
    # n_min-row tables joined to the n_new draws; Spark broadcasts them when small
    syn = (draws.join(ranked, "base_rank").join(nn, ["base_id", "nn_rank"])
                .join(feats_b, "base_id").join(feats_n, "nn_id"))
    out = syn.select((F.lit(-1) - F.col("i")).cast(df.schema[id_col].dataType).alias(id_col),
                     *[(F.col(f"x_{c}") + F.col("gap") * (F.col(f"n_{c}") - F.col(f"x_{c}"))).alias(c) for c in cols],
                     F.lit(minority).cast(df.schema[by].dataType).alias(by))
    if synthetic_only:
        return out
    return df.select(*keep).unionByName(out)


# ---- D4 kNN classifier ------------------------------------------------------

class KNNModel:
    """Stores the training rows; ``transform`` runs the exact kNN join and votes."""

    def __init__(self, train: DataFrame, k: int, weights: str, metric: str, cols, label: str, id_col: str):
        self.train, self.k, self.weights, self.metric = train, k, weights, metric
        self.cols, self.label, self.id_col = list(cols), label, id_col

    def transform(self, df: DataFrame, label_col: str = "prediction", p_col: str = "p") -> DataFrame:
        pairs = knn_join(df, self.train, self.k, self.cols, self.metric, self.id_col, self.id_col)
        lab = self.train.select(F.col(self.id_col).alias("b_id"), F.col(self.label).alias("_y"))
        v = pairs.join(lab, "b_id")
        if self.weights == "distance":
            # an exact match takes the whole vote
            zero = F.max((F.col("dist") == 0).cast("int")).over(Window.partitionBy("q_id"))
            w = F.when(zero == 1, (F.col("dist") == 0).cast("double")).otherwise(F.lit(1.0) / F.col("dist"))
        else:
            w = F.lit(1.0)
        v = v.withColumn("_w", w)
        votes = v.groupBy("q_id").agg((F.sum(F.col("_w") * (F.col("_y") == 1).cast("double"))
                                       / F.sum("_w")).alias(p_col))
        out = df.join(votes.withColumnRenamed("q_id", self.id_col), self.id_col, "left")
        return out.withColumn(label_col, (F.col(p_col) > 0.5).cast("int"))

    def save(self, path: str) -> None:
        self.train.write.mode("overwrite").parquet(f"{path}/train")
        meta = self.train.sparkSession.createDataFrame(
            [(self.k, self.weights, self.metric, ",".join(self.cols), self.label, self.id_col)],
            "k int, weights string, metric string, cols string, label string, id_col string")
        meta.write.mode("overwrite").json(f"{path}/meta")

    @classmethod
    def load(cls, path: str) -> "KNNModel":
        from pyspark.sql import SparkSession
        spark = SparkSession.getActiveSession()
        m = spark.read.json(f"{path}/meta").first()
        return cls(spark.read.parquet(f"{path}/train"), m["k"], m["weights"], m["metric"],
                   m["cols"].split(","), m["label"], m["id_col"])


class KNNClassifier:
    """K, uniform or 1/d votes, euclidean or manhattan."""

    def __init__(self, k: int = 5, weights: str = "uniform", metric: str = "euclidean",
                 feature_cols=None, label: str = C.TARGET, id_col: str = "id"):
        self.k, self.weights, self.metric = k, weights, metric
        self.cols, self.label, self.id_col = list(feature_cols or C.FEATURES), label, id_col

    def fit(self, train: DataFrame) -> KNNModel:
        rows = reliable(train.select(self.id_col, *self.cols, self.label))
        return KNNModel(rows, self.k, self.weights, self.metric, self.cols, self.label, self.id_col)
