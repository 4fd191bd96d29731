"""Whitening of embeddings with Spark MLlib's BlockMatrix.

Vectors are turned into whole numbers x = floor(256 * c).  The fit list holds
each distinct x vector once, so copies, however many, weigh as one.  Its rows,
centred at S/n, are indexed and cut into distributed blocks A; the scatter is
A' * A.  Only that matrix, dimension x dimension, comes to the driver, where
``eigh`` gives the components.  All rows, centred alike, are then multiplied by
the matrix of the leading components over the roots of their eigenvalues.

MLlib puts all products of one result block into one task unless the middle
dimension is split; the scatter is a few blocks of very many middle blocks, so
it is always split (``MIDDLE`` row blocks for each part), and the parts are
summed.  The driver holds the places of the row blocks (rows / ``ROWS``), S and
the scatter.  Rows stay in the JVM from the table to the result.

Defined cases: rows whose vector is null, or holds null or non-finite entries,
are left out, and so are vectors with an entry of 2^53/256 or more, whose x is
no exact number.  The dimension is the most common length of the others (the
greater of equals); vectors of another length, or none, are left out.  Repeated rows are told as
often as they stand, also those with a null id.  A component along which the
fit list does not spread (eigenvalue zero to double precision) has ``whitened``
null and ``explained`` 0; if no component spreads ``identity_error`` is null
and ``explained`` too.  ``deviation`` is null where the exact value, which
``deviation_exact`` holds, exceeds a long; that is null beyond 38 digits.  An
empty table gives an empty result.
"""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.mllib.common import callMLlibFunc
from pyspark.mllib.linalg import DenseMatrix
from pyspark.mllib.linalg.distributed import BlockMatrix, IndexedRowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut_lineage
from .common import take

SCALE = 256
ROWS = 4096                     # rows of a block
MIDDLE = 16                     # row blocks that one task of the scatter sums
COMPONENTS = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double, deviation_exact decimal(38,0)"


def quantised(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(vec_id, x) of the usable rows; x: array<long>."""
    rows = take(vectors, id_col, vec_col).toDF("vec_id", "e").withColumn("e", F.col("e").cast("array<double>"))
    usable = F.col("e").isNotNull() & (F.size("e") > 0) & F.forall("e", lambda c: F.coalesce(F.abs(c) < 2.0 ** 53 / SCALE, F.lit(False)) & ~F.isnan(c))
    return rows.where(usable).select(F.col("vec_id").cast("long").alias("vec_id"), F.transform("e", lambda c: F.floor(c * SCALE).cast("long")).alias("x"))


def numbered(rows: DataFrame, name: str) -> DataFrame:
    """``rows``, written, with ``index`` 0, 1, ...: place in the partition behind the rows of the partitions before.

    The table of partitions, a row for each task, is broadcast."""
    written = cut_lineage(rows.withColumn("_m", F.monotonically_increasing_id()), name)
    part = F.shiftright("_m", 33)
    counts = sorted((r["p"], r["count"]) for r in written.groupBy(part.alias("p")).count().collect())
    starts = np.concatenate(([0], np.cumsum([c for _, c in counts])))[:-1] if counts else []
    offsets = rows.sparkSession.createDataFrame([(int(p), int(s)) for (p, _), s in zip(counts, starts)], "p long, first long")
    place = F.col("_m") - F.shiftleft(part, 33)
    return written.join(F.broadcast(offsets), part == F.col("p")).withColumn("index", F.col("first") + place).drop("_m", "p", "first")


def block_matrix(rows: DataFrame, sums: list[int], n: int, n_rows: int) -> BlockMatrix:
    """Rows (index, x), centred at sums / n, as blocks."""
    means = F.array(*[F.lit(s / n) for s in sums])
    centred = rows.select("index", array_to_vector(F.zip_with("x", means, lambda x, m: x.cast("double") - m)).alias("vector"))
    return IndexedRowMatrix(MLUtils.convertVectorColumnsFromML(centred, "vector"), n_rows, len(sums)).toBlockMatrix(ROWS, 1024)


def scatter(a: BlockMatrix) -> np.ndarray:
    """A' * A as a local matrix, symmetric to the last bit."""
    parts = max(1, -(-a.numRowBlocks // MIDDLE))
    product = a.transpose()._java_matrix_wrapper.call("multiply", a._java_matrix_wrapper._java_model, parts)
    local = BlockMatrix(product, a.colsPerBlock, a.colsPerBlock).toLocalMatrix().toArray()
    return (local + local.T) / 2


def rows_of(m: BlockMatrix) -> DataFrame:
    """(index, z array<double>) of the rows of a matrix."""
    indexed = m.toIndexedRowMatrix()
    rows = callMLlibFunc("getIndexedRows", indexed._java_matrix_wrapper._java_model).toDF("index", "z")
    return MLUtils.convertVectorColumnsToML(rows, "z").withColumn("z", vector_to_array("z"))


def projected(a: BlockMatrix, spark: SparkSession, w: np.ndarray) -> DataFrame:
    """(index, z) with z = row * w."""
    blocks = [((i // 1024, 0), DenseMatrix(len(w[i:i + 1024]), w.shape[1], w[i:i + 1024].flatten(order="F").tolist())) for i in range(0, len(w), 1024)]
    right = BlockMatrix(spark.sparkContext.parallelize(blocks, 1), 1024, w.shape[1], len(w), w.shape[1])
    return rows_of(a.multiply(right))


def identity_error(z: DataFrame, k: int, n: int) -> float:
    """Largest absolute entry of the covariance of the whitened fit list minus the identity."""
    col = lambda i: F.element_at("z", i + 1)
    mean = z.agg(*[F.avg(col(i)) for i in range(k)]).first()
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    cov = z.agg(*[F.sum((col(i) - mean[i]) * (col(j) - mean[j])) / n for i, j in pairs]).first()
    return max(abs(c - (i == j)) for (i, j), c in zip(pairs, cov))


def whiten(vectors: DataFrame, components: int = 4, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error,
    deviation_exact) of every usable row and each of the leading components."""
    spark = vectors.sparkSession
    x = cut_lineage(quantised(vectors, id_col, vec_col), f"whiten-x-{uuid.uuid4().hex[:6]}")
    lengths = x.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    if lengths is None:
        return spark.createDataFrame([], COMPONENTS)
    d = lengths["d"]
    rows = numbered(x.where(F.size("x") == d), "whiten-rows")
    fit = numbered(rows.select("x").distinct(), "whiten-fit")
    totals = fit.agg(F.count("*"), *[F.sum(F.col("x")[i].cast("decimal(38,0)")) for i in range(d)]).first()
    n, sums = int(totals[0]), [int(s) for s in totals[1:]]
    a = block_matrix(fit, sums, n, n)
    values, vectors_ = np.linalg.eigh(scatter(a) / n)
    values, vectors_ = np.maximum(values[::-1], 0.0), vectors_[:, ::-1]
    trace = float(values.sum())
    k = min(components, d)
    spread = int((values[:k] > values[0] * d * np.finfo(float).eps).sum()) if trace > 0 else 0

    far = "aggregate(zip_with(x, sums, (a, b) -> {n} * cast(a as decimal(19,0)) - b), {zero}, (t, v) -> cast(try_add(t, cast(try_multiply(v, v) as decimal(38,0))) as decimal(38,0)))"
    exact = rows.withColumn("sums", F.array(*[F.lit(str(s)).cast("decimal(38,0)") for s in sums])).withColumn(
        "deviation_exact", F.expr(far.format(n=f"cast({n} as decimal(19,0))", zero="cast(0 as decimal(38,0))"))).select("index", "vec_id", "deviation_exact")
    if spread:
        w = vectors_[:, :spread] / np.sqrt(values[:spread])
        error = identity_error(projected(a, spark, w), spread, n)
        total = rows.count()
        exact = exact.join(projected(block_matrix(rows, sums, n, total), spark, w), "index")
    else:
        error, exact = None, exact.withColumn("z", F.lit(None).cast("array<double>"))
    share = [F.struct(F.lit(i + 1).alias("component"), (F.get("z", F.lit(i)) if i < spread else F.lit(None).cast("double")).alias("whitened"),
                      F.lit((float(values[i]) if i < spread else 0.0) / trace if trace else None).cast("double").alias("explained")) for i in range(k)]
    return (exact.withColumn("c", F.explode(F.array(*share)))
            .select("vec_id", "c.component", F.lit(n).cast("long").alias("n"), F.col("deviation_exact").try_cast("long").alias("deviation"),
                    "c.whitened", "c.explained", F.lit(error).cast("double").alias("identity_error"), "deviation_exact"))
