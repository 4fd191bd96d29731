"""Language identification with error-correcting output codes.

Each language gets a codeword of bits.  One binary classifier per bit, linear
in the square roots of byte n-gram shares, says which side a text is on; the
codeword with the least weighted loss is the prediction.  A text whose two
nearest codewords are nearly as far is flagged ambiguous.

The classifiers are fitted on a bounded sample: ``per_lang`` texts of every
language, those with the smallest hash of the id, of at most ``max_langs``
languages (more raise an error).  All texts are predicted whole, from their
text alone.

Defined cases: a null text and one without a letter give ``und`` with score
0, not ambiguous.  So do all texts if there is nothing to learn from.  With
one language only, it is predicted with score 1.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import product

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import aside, take

BUCKETS = 4096
LETTER = regex.compile(r"\p{L}")
SLICE = 1 << 20     # bytes hashed at a time


def ngram_shares(text: str) -> np.ndarray:
    """Square roots of the shares of hashed 1-, 2- and 3-byte grams, lower-cased."""
    raw = np.frombuffer(b" " + text.lower().encode() + b" ", np.uint8)
    counts = np.zeros(BUCKETS)
    for i in range(0, max(len(raw) - 2, 1), SLICE):
        b = raw[i:i + SLICE + 2].astype(np.uint32)
        pair = b[:-1] * np.uint32(40503) + b[1:] * np.uint32(2654435)
        tri = pair[:-1] * np.uint32(31) + b[2:] * np.uint32(97531)
        for h in (b[:-2] * np.uint32(2654435761), pair[:len(b) - 2] * np.uint32(2654435761), tri * np.uint32(2654435761)):
            counts += np.bincount(h >> np.uint32(20), minlength=BUCKETS)
    return np.sqrt(counts / max(counts.sum(), 1.0)).astype(np.float32)


def codewords(k: int) -> np.ndarray:
    """k distinct rows of +-1: all splits in two if k <= 5, else random splits
    with far-apart rows (fixed seed)."""
    if k <= 5:
        columns = [c for c in product((1, -1), repeat=k - 1) if -1 in c]
        return np.array([[1, *c] for c in columns], np.float32).T.reshape(k, -1)
    rng, bits = np.random.default_rng(7), 8 + 4 * int(np.ceil(np.log2(k)))
    best, far = None, -1
    for _ in range(200):
        m = rng.choice([-1.0, 1.0], (k, bits)).astype(np.float32)
        d = ((m @ m.T - bits) / -2 + np.eye(k) * bits).min()
        if d > far and (np.abs(m.sum(0)) < k).all():
            best, far = m, d
    return best


@dataclass
class CodeModel:
    langs: list[str]
    code: np.ndarray        # (languages, bits)
    weights: np.ndarray     # (BUCKETS + 1, bits)
    trust: np.ndarray       # weight of each bit's loss, sums to one

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        if text is None or not self.langs or not LETTER.search(text):
            return "und", 0.0, False
        if len(self.langs) == 1:
            return self.langs[0], 1.0, False
        f = ngram_shares(text) @ self.weights[:-1] + self.weights[-1]
        loss = (np.logaddexp(0, -self.code * f) * self.trust).sum(1)
        p = np.exp(-(loss - loss.min()) * self.code.shape[1])
        p /= p.sum()
        order = np.argsort(-p, kind="stable")
        return self.langs[order[0]], float(p[order[0]]), bool(p[order[0]] - p[order[1]] < 0.2)


def fit(x: np.ndarray, y: np.ndarray, langs: list[str], steps: int = 300, l2: float = 1e-5) -> CodeModel:
    """All bits' logistic regressions at once, by gradient descent with momentum."""
    if len(langs) < 2:
        return CodeModel(langs, np.ones((len(langs), 0), np.float32), np.zeros((BUCKETS + 1, 0), np.float32), np.zeros(0))
    code = codewords(len(langs))
    target = code[y]
    x1 = np.hstack([x, np.ones((len(x), 1), np.float32)])
    share = 1.0 / np.bincount(y, minlength=len(langs))[y][:, None].astype(np.float32) / len(langs)
    w = np.zeros((x1.shape[1], code.shape[1]), np.float32)
    v = np.zeros_like(w)
    for _ in range(steps):
        m = target * (x1 @ w)
        v = 0.9 * v - 8.0 * (x1.T @ (-target * share / (1 + np.exp(np.clip(m, -60, 60)))) + l2 * w)
        w += v
    right = ((target * (x1 @ w)) > 0).mean(0)
    trust = np.maximum(right - 0.5, 1e-3)
    return CodeModel(langs, code, w, trust / trust.sum())


def train(docs: DataFrame, per_lang: int = 400, max_rows: int = 8000, max_langs: int = 256) -> CodeModel:
    """Fit on rows (doc_id, text, lang) with a non-null text and lang: ``per_lang``
    of each language, fewer if that would make more than ``max_rows`` in all.
    They are those of the smallest hash of id and text; repeated rows are one.

    The number of a language's rows, told to some hundredths by a sketch, sets a
    hash below which about twice as many lie as are wanted; only these are ranked,
    so a language that most rows have sends no more than another to one task."""
    rows = take(docs, "doc_id", "text", "lang").where("text is not null and lang is not null").withColumn("key", F.xxhash64("doc_id", "text"))
    found = rows.groupBy("lang").agg(F.approx_count_distinct("key").alias("n")).orderBy("lang").limit(max_langs + 1).collect()
    if len(found) > max_langs:
        raise ValueError(f"more than {max_langs} languages to learn")
    per_lang = min(per_lang, max_rows // max(len(found), 1))
    below = [(r.lang, min(2 ** 63 - 1, int((2 * per_lang + 64) / max(r.n, 1) * 2.0 ** 64) - 2 ** 63)) for r in found]
    cuts = docs.sparkSession.createDataFrame(below, "lang string, below long")      # at most max_langs rows
    place = Window.partitionBy("lang").orderBy("key")

    @F.arrow_udf("binary")
    def shares(texts: pa.Array) -> pa.Array:
        return pa.array([ngram_shares(t.as_py()).tobytes() if LETTER.search(t.as_py()) else None for t in texts], pa.binary())

    keys = (rows.select("lang", "key").join(F.broadcast(cuts), "lang").where("key <= below").select("lang", "key").distinct()
            .withColumn("n", F.row_number().over(place)).where(F.col("n") <= per_lang).drop("n"))
    # at most max_rows rows
    sample = (rows.join(F.broadcast(keys), ["lang", "key"]).groupBy("lang", "key").agg(F.min("doc_id").alias("doc_id"), F.min("text").alias("text"))
              .select("lang", "doc_id", "key", shares("text").alias("f")).where("f is not null").collect())
    every = sorted((r.lang, str(r.doc_id), r.key, bytes(r.f)) for r in sample)
    langs = sorted({r[0] for r in every})
    if not every:
        return CodeModel([], np.ones((0, 0)), np.zeros((BUCKETS + 1, 0)), np.zeros(0))
    x = np.stack([np.frombuffer(r[3], np.float32) for r in every])
    return fit(x, np.array([langs.index(r[0]) for r in every]), langs)


def with_language(docs: DataFrame, model: CodeModel, text_col: str = "text") -> DataFrame:
    """``docs`` with the column predicted: struct(lang_pred, score, ambiguous)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)    # BUCKETS x bits numbers

    @F.arrow_udf("struct<lang_pred:string,score:double,ambiguous:boolean>")
    def predict(texts: pa.Array) -> pa.Array:
        rows = [shared.value.predict(t.as_py()) for t in texts]
        return pa.StructArray.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.float64()),
                                           pa.array([r[2] for r in rows], pa.bool_())], ["lang_pred", "score", "ambiguous"])

    safe, (text,) = aside(docs, text_col)
    return safe.withColumn("_predicted", predict(F.col(text))).toDF(*docs.columns, "predicted")
