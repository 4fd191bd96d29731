"""Toxicity severity by cumulative-link ordinal regression on sparse features.

Grades 0 (clean) to 3 are ordered.  One weight vector w over words serves all
thresholds: P(grade >= k) = sigmoid(w.x - theta_k) with theta_1 <= theta_2 <=
theta_3.  The output is each P(grade >= k) and the expected severity, their
sum.

Labels say only toxic or not, so the grade of a toxic training text comes from
how many of the selected words it holds: thirds of the toxic sample, by count.
Grade 1 is what the labels tell; grades 2 and 3 only say how strongly a text is toxic by these words.

The model is fitted on a bounded sample of labelled rows: at most
``max_per_class`` of each class, those with the smallest hash of the id; copies
among them, and near copies by their words (``mark``), are taken once.  All texts are scored whole.

Defined cases: null and empty texts, and all texts if no toxic or no clean
label matches a text, are grade 0 with severity 0.  Labels that are null or
disagree on an id count by their maximum.  Words that were not selected weigh
nothing.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce
from zlib import crc32

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .common import aside, take, words

GRADES = 3
EDGE = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"    # ASCII punctuation around a word


def word_set(text: str | None) -> set[bytes]:
    """Distinct lower-cased words without ASCII punctuation at their ends."""
    out = {w.strip(EDGE) for w in set(words(text))}
    out.discard(b"")
    return out


@dataclass
class SeverityModel:
    """Word weights and thresholds; without words all texts are clean."""

    weights: dict[bytes, float] = field(default_factory=dict)
    thresholds: tuple[float, ...] = (np.inf,) * GRADES

    def at_least(self, text: str | None) -> list[float]:
        """P(grade >= k) for k = 1..3."""
        found = self.weights.keys() & word_set(text) if text else ()
        z = sum(sorted(self.weights[w] for w in found))
        return [float(1 / (1 + np.exp(min(t - z, 700.0)))) if np.isfinite(t) else 0.0 for t in self.thresholds]


#: Multipliers and shifts of the minimum hashes of a text's words.
MIXERS = (np.random.default_rng(2).integers(1 << 20, 1 << 31, (2, 4), dtype=np.uint64) << np.uint64(1)) | np.uint64(1)


def mark(ws: set[bytes]) -> int:
    """Equal for copies and mostly for near copies, so that a group of them counts
    as one text in training: four minimum hashes of the words, which all agree
    with the fourth power of the word sets' similarity (0.81 at 0.95, 0.06 at 0.5)."""
    if not ws:
        return 0
    hashes = np.fromiter(map(crc32, ws), np.uint64, len(ws))[:, None] * MIXERS[0] + MIXERS[1]
    least = ((hashes ^ (hashes >> np.uint64(33))) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(32)).min(0)
    return xxhash.xxh64_intdigest(least.tobytes()) >> 1


def select_words(texts: DataFrame, n1: int, n0: int, min_docs: int, min_g: float, min_lift: float) -> list[bytes]:
    """Words whose presence tells the n1 toxic from the n0 clean texts: found in
    at least ``min_docs`` toxic ones, ``min_lift`` times as often as in clean
    ones (so longer toxic texts alone select nothing), G-test at least ``min_g``."""
    counts = (texts.select("toxic", F.explode("words").alias("word")).groupBy("word")
              .agg(F.count_if(F.col("toxic")).alias("c1"), F.count_if(~F.col("toxic")).alias("c0"))
              .where((F.col("c1") >= min_docs) & (F.col("c1") * n0 >= min_lift * (F.col("c0") + 0.5) * n1)))
    out = []
    for r in counts.collect():          # few of the words of a bounded sample
        seen = np.array([[r.c1, n1 - r.c1], [r.c0, n0 - r.c0]], float)
        mean = seen.sum(1, keepdims=True) * seen.sum(0, keepdims=True) / seen.sum()
        if 2 * np.sum(np.where(seen > 0, seen * np.log(np.maximum(seen, 1e-300) / mean), 0.0)) >= min_g:
            out.append(bytes(r.word))
    return sorted(out)


def fit_cumulative_link(x: np.ndarray, grade: np.ndarray, l2: float = 1e-4, steps: int = 1500) -> tuple[np.ndarray, np.ndarray]:
    """(w, theta) by gradient descent with momentum on the sum of the logistic
    losses of all thresholds, clean and toxic texts weighing the same in all;
    thresholds stay in order as sums of positive steps."""
    d = x.shape[1]
    w, base, gaps = np.zeros(d), 0.0, np.zeros(GRADES - 1)
    params = np.concatenate((w, [base], gaps))
    v = np.zeros_like(params)
    above = grade[:, None] >= np.arange(1, GRADES + 1)
    toxic = grade > 0
    weight = np.where(toxic, 0.5 / max(toxic.sum(), 1), 0.5 / max((~toxic).sum(), 1))[:, None]
    for _ in range(steps):
        look = params + 0.9 * v
        w, base, gaps = look[:d], look[d], look[d + 1:]
        theta = base + np.concatenate(([0.0], np.cumsum(np.logaddexp(0, gaps))))
        p = 1 / (1 + np.exp(-np.clip((x @ w)[:, None] - theta, -60, 60)))
        r = (p - above) * weight
        g_theta = -r.sum(0)
        tail = np.cumsum(g_theta[::-1])[::-1]
        grad = np.concatenate((x.T @ r.sum(1) + l2 * w, [g_theta.sum()], tail[1:] / (1 + np.exp(-gaps))))
        v = 0.9 * v - 0.5 * grad
        params = params + v
    w, base, gaps = params[:d], params[d], params[d + 1:]
    return w, base + np.concatenate(([0.0], np.cumsum(np.logaddexp(0, gaps))))


def train(docs: DataFrame, labels: DataFrame, max_per_class: int = 3000, min_docs: int = 4,
          min_g: float = 20.0, min_lift: float = 8.0) -> SeverityModel:
    """Fit on at most ``max_per_class`` toxic and as many clean labelled texts."""
    graded = (take(labels, "doc_id", "toxic").where("doc_id is not null and toxic is not null")
              .groupBy("doc_id").agg((F.max("toxic") > 0).alias("toxic")))
    sample = reduce(DataFrame.unionByName, [
        graded.where(F.col("toxic") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_per_class) for y in (True, False)])

    @F.arrow_udf("struct<words:array<binary>,mark:long>")
    def features(texts: pa.Array) -> pa.Array:
        sets = [word_set(t.as_py()) for t in texts]
        return pa.StructArray.from_arrays([pa.array([sorted(s) for s in sets], pa.list_(pa.binary())), pa.array(map(mark, sets), pa.int64())], ["words", "mark"])

    # the sample has at most 2 * max_per_class rows, so it may be broadcast
    texts = cut_lineage(take(docs, "doc_id", "text").where("text is not null").join(F.broadcast(sample), "doc_id")
                        .select("doc_id", "toxic", features("text").alias("f")).groupBy("f.mark", "toxic")
                        .agg(F.min_by("f.words", F.struct("doc_id", "f.words")).alias("words")), "toxicity-sample")
    sizes = texts.agg(F.count_if(F.col("toxic")).alias("n1"), F.count_if(~F.col("toxic")).alias("n0")).first()
    if not sizes["n1"] or not sizes["n0"]:
        return SeverityModel()
    chosen = select_words(texts, sizes["n1"], sizes["n0"], min_docs, min_g, min_lift)
    if not chosen:
        return SeverityModel()
    held = F.array_intersect("words", F.array(*[F.lit(bytearray(w)) for w in chosen]))
    rows = texts.select("mark", "toxic", held.alias("held")).orderBy("mark", "toxic").collect()
    return fit([frozenset(map(bytes, r.held)) for r in rows], np.array([r.toxic for r in rows], bool), chosen)


def fit(texts: list[frozenset[bytes]], toxic: np.ndarray, chosen: list[bytes], min_weight: float = 0.3, rounds: int = 3) -> SeverityModel:
    """Fit, drop words that turn out to weigh little, and fit again."""
    for _ in range(rounds):
        column = {w: i for i, w in enumerate(chosen)}
        x = np.zeros((len(texts), len(chosen)))
        for i, ws in enumerate(texts):
            x[i, [column[w] for w in ws if w in column]] = 1.0
        hits = x.sum(1)
        some = hits[toxic & (hits > 0)]
        if not len(some):
            return SeverityModel()
        low, high = np.quantile(some, [1 / 3, 2 / 3])
        w, theta = fit_cumulative_link(x, np.where(toxic, 1 + (hits > low) + (hits > high), 0))
        if (w >= min_weight).all():
            break
        chosen = [c for c, v in zip(chosen, w) if v >= min_weight]
    return SeverityModel(dict(zip(column, map(float, w))), tuple(map(float, theta)))


def with_severity(docs: DataFrame, model: SeverityModel, text_col: str = "text") -> DataFrame:
    """``docs`` with the column severity: struct(p_grade_1, p_grade_2,
    p_grade_3, expected_severity, grade); grade is the highest k with
    P(grade >= k) >= 0.5."""
    shared = docs.sparkSession.sparkContext.broadcast(model)    # at most the words selected from the bounded sample
    names = [f"p_grade_{k}" for k in range(1, GRADES + 1)] + ["expected_severity"]

    @F.arrow_udf(f"struct<{','.join(n + ':double' for n in names)},grade:int>")
    def score(texts: pa.Array) -> pa.Array:
        p = np.array([shared.value.at_least(t.as_py()) for t in texts]).reshape(-1, GRADES)
        columns = [*p.T, p.sum(1)]
        return pa.StructArray.from_arrays([*map(pa.array, map(np.ascontiguousarray, columns)), pa.array((p >= 0.5).sum(1).astype(np.int32))], [*names, "grade"])

    safe, (text,) = aside(docs, text_col)
    return safe.withColumn("_severity", score(F.col(text))).toDF(*docs.columns, "severity")
