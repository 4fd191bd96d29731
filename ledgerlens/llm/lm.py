"""Language-model scoring with a probabilistic suffix tree over words.

States are contexts of up to ``depth`` preceding words.  A context is a candidate
if it comes before ``min_count`` training tokens or more; both are the same at
every size, so the tree grows with the corpus.  A divergence test keeps a
candidate if its own next-word distribution, each occurrence left out in turn,
predicts the training text better than its suffix does by at least ``min_gain``
nats per occurrence; suffixes of kept contexts are kept.  Next-word counts are
smoothed with the suffix's distribution, with the weight of ``prior``
occurrences; the root is the additively smoothed word distribution.  A token is
scored in the longest kept suffix of its past.  Words and contexts are known by
64-bit hashes; at 10^12 distinct grams some thousands of them would be taken for
another, each of which changes the scores of its own occurrences only.

How it runs.  Each task packs its documents into chunks: word ids, numbered by
word hash, and the hashes.  Chunks are written once, in buckets of their number,
and never shuffled: each later step reads them where their answers are dealt to.
Chunks ask for the training counts of their
distinct grams (words, pairs, then longer ones), in rows dealt by gram hash;
the counts of a gram meet in one place, are summed there and answered to each
chunk that asked.  A longer gram is asked for only if the pairs of its context
are frequent enough, and not if one of its pairs is in this chunk alone.  From
the counts each chunk sums its part of the gain of its contexts; these sums and
the kept contexts are dealt by hash as well.  So what moves is distinct grams
of a chunk, not tokens; no gram, however frequent, gives one task more than a
row for each chunk; and no table of contexts is collected or broadcast.

Defined cases: a null text is the empty text, whose only token is its end.
Rows with a null id are in fold 0.  Repeated rows count and are scored as often
as they stand.  With no training text all scores are 0.
"""

from __future__ import annotations

from collections import defaultdict
from dataclasses import dataclass
from itertools import count

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bucketed, take, words, written

END = b""                       # no word is empty
CODEC = pa.Codec("zstd", compression_level=1)
BUCKET_TOKENS = 1 << 20         # tokens for each range of hashes; most have a pair of their own to be counted
TASKS = 4                       # tasks of a shuffle for each core
WORD, PAIR, LONGER, KEPT = range(4)
PACKED = ("chunk long, doc_id array<long>, train array<boolean>, n_tokens array<int>, train_tokens long, "
          "tokens binary, vocabulary binary")


def pack(a: np.ndarray) -> bytes:
    """An integer array by byte planes, compressed."""
    planes = np.ascontiguousarray(a.view(np.uint8).reshape(len(a), -1).T) if len(a) else np.zeros(0, np.uint8)
    return len(a).to_bytes(8, "little") + CODEC.compress(planes.tobytes(), asbytes=True)


def unpack(b: bytes, dtype) -> np.ndarray:
    n, width = int.from_bytes(b[:8], "little"), np.dtype(dtype).itemsize
    if not n:
        return np.zeros(0, dtype)
    planes = np.frombuffer(CODEC.decompress(b[8:], decompressed_size=n * width, asbytes=True), np.uint8)
    return np.ascontiguousarray(planes.reshape(width, n).T).view(dtype).reshape(n)


def pair_hash(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """64-bit hash of a context of two words from their hashes."""
    with np.errstate(over="ignore"):
        x = a * np.uint64(0x9E3779B97F4A7C15) + ((b << np.uint64(31)) | (b >> np.uint64(33))) * np.uint64(0xC2B2AE3D27D4EB4F)
        x ^= x >> np.uint64(29)
        return x * np.uint64(0xBF58476D1CE4E5B9)


def word_hash(w: bytes) -> int:
    return xxhash.xxh64_intdigest(w)


@dataclass
class Chunk:
    """Tokens of some documents: ids in order of word hash."""

    tokens: np.ndarray          # uint32
    vocabulary: np.ndarray      # uint64, sorted
    n_tokens: np.ndarray        # of each document, its end included
    train: np.ndarray           # of each document

    def __post_init__(self):
        self.first = np.cumsum(self.n_tokens) - self.n_tokens
        self.at = np.arange(len(self.tokens)) - np.repeat(self.first, self.n_tokens)
        self.learn = np.repeat(self.train, self.n_tokens)


@dataclass
class Grams:
    """Distinct grams of one length in a chunk; ``at``: number of the gram that
    ends at each position, or -1.  ``prefix`` and ``suffix``: numbers of the
    grams one word shorter.  ``n``: training occurrences in the whole corpus,
    ``here``: the gram is known to be in this chunk alone."""

    at: np.ndarray
    hash: np.ndarray
    own: np.ndarray             # training occurrences in the chunk
    prefix: np.ndarray
    word: np.ndarray
    suffix: np.ndarray
    n: np.ndarray | None = None
    here: np.ndarray | None = None


def single(c: Chunk) -> Grams:
    v = np.arange(len(c.vocabulary))
    return Grams(c.tokens.astype(np.int32), c.vocabulary, np.bincount(c.tokens[c.learn], minlength=len(v)), v, v, v)


def longer(c: Chunk, low: Grams, size: int, often: np.ndarray | None = None) -> Grams:
    """Grams of size + 1 words from those of ``size``; ``often``: positions at
    which a context may end."""
    before = np.concatenate((np.full(1, -1, np.int32), low.at[:-1]))
    ok = (c.at >= size) & (before >= 0)
    if often is not None:
        ok[1:] &= often[:-1]
    ok = np.flatnonzero(ok)
    v = len(c.vocabulary)
    keys, back = np.unique(before[ok].astype(np.int64) * v + c.tokens[ok], return_inverse=True)
    at, suffix = np.full(len(c.tokens), -1, np.int32), np.zeros(len(keys), np.int64)
    at[ok] = back
    suffix[back] = low.at[ok]
    prefix, word = keys // v, keys % v
    return Grams(at, pair_hash(low.hash[prefix], c.vocabulary[word]), np.bincount(back[c.learn[ok]], minlength=len(keys)), prefix, word, suffix)


def make_chunk(texts, train) -> Chunk:
    ids: dict[bytes, int] = defaultdict()
    ids.default_factory = ids.__len__
    parts, n = [], []
    for t in texts:
        w = words(t)
        w.append(END)
        parts.append(np.fromiter(map(ids.__getitem__, w), np.uint32, len(w)))
        n.append(len(w))
    hashes = np.fromiter(map(word_hash, ids), np.uint64, len(ids))
    order = np.argsort(hashes)
    place = np.empty(len(ids), np.uint32)
    place[order] = np.arange(len(ids), dtype=np.uint32)
    return Chunk(place[np.concatenate(parts)], hashes[order], np.array(n, np.int64), np.array(train, bool))


def packed_chunks(docs: DataFrame, chunk_chars: int, n_tasks: int) -> DataFrame:
    """Documents (doc_id, text, train) packed into chunks of about chunk_chars."""
    def run(batches):
        ids, texts, train, size = [], [], [], 0
        names = count(TaskContext.get().partitionId() << 33)        # no two chunks of the written table share one

        def flush():
            c = make_chunk(texts, train)
            name = next(names)
            return pa.RecordBatch.from_pylist([{
                "chunk": name, "doc_id": ids, "train": train, "n_tokens": c.n_tokens.tolist(), "train_tokens": int(c.learn.sum()),
                "tokens": pack(c.tokens), "vocabulary": pack(c.vocabulary)}],
                schema=pa.schema([("chunk", pa.int64()), ("doc_id", pa.list_(pa.int64())), ("train", pa.list_(pa.bool_())),
                                  ("n_tokens", pa.list_(pa.int32())), ("train_tokens", pa.int64()), ("tokens", pa.binary()),
                                  ("vocabulary", pa.binary())]))

        for b in batches:
            for i, t, y in zip(b.column(0), b.column(1), b.column(2)):
                text = t.as_py() or ""
                ids.append(i.as_py())
                texts.append(text)
                train.append(y.as_py())
                size += len(text) + 1
                if size >= chunk_chars:
                    yield flush()
                    ids, texts, train, size = [], [], [], 0
        if ids:
            yield flush()

    return bucketed(docs.mapInArrow(run, PACKED), "chunk", n_tasks, "lm_chunks")


def load(row) -> Chunk:
    """Chunk of a packed row of Arrow scalars."""
    return Chunk(unpack(row["tokens"].as_py(), np.uint32), unpack(row["vocabulary"].as_py(), np.uint64),
                 row["n_tokens"].values.to_numpy().astype(np.int64), np.array(row["train"].as_py(), bool))


def rows_of(batch):
    for i in range(batch.num_rows):
        yield {n: batch.column(n)[i] for n in batch.schema.names}


def buckets(h: np.ndarray, n_buckets: int):
    """(bucket, its places in h in order of hash) of the buckets, ranges of hashes, that are not empty."""
    order = np.argsort(h)
    step = (1 << 64) // n_buckets
    cut = [*np.searchsorted(h[order], np.array([i * step for i in range(n_buckets)], np.uint64)).tolist(), len(h)]
    for i in range(n_buckets):
        if cut[i] < cut[i + 1]:
            yield i, order[cut[i]:cut[i + 1]]


REQUEST = "bucket int, chunk long, kind int, gram binary, n binary"
REPLY = "bucket int, chunk long, kind int, n binary, distinct long"
CONTEXT = "bucket int, chunk long, gram binary, gain binary, ahead binary, level binary, suffix binary"
REQUEST_ARROW = pa.schema([("bucket", pa.int32()), ("chunk", pa.int64()), ("kind", pa.int32()), ("gram", pa.binary()), ("n", pa.binary())])
CONTEXT_ARROW = pa.schema([("bucket", pa.int32()), ("chunk", pa.int64()), *[(k, pa.binary()) for k in ("gram", "gain", "ahead", "level", "suffix")]])


def requests(chunk: int, kind: int, h: np.ndarray, own: np.ndarray, n_buckets: int) -> list[dict]:
    return [{"bucket": i, "chunk": chunk, "kind": kind, "gram": pack(h[at]), "n": pack(own[at].astype(np.uint32))} for i, at in buckets(h, n_buckets)]


def answers(told: pa.Table, kind: int, h: np.ndarray) -> np.ndarray:
    """What was answered about each of the hashes asked for."""
    rows = {b: x for b, k, x in zip(told["bucket"].to_pylist(), told["kind"].to_pylist(), told["n"]) if k == kind}
    out = np.zeros(len(h), np.uint64)
    if rows:
        out[np.argsort(h)] = np.concatenate([unpack(rows[b].as_py(), np.uint64) for b in sorted(rows)])
    return out.astype(np.int64)


def summed(key, t):
    """Answers to the requests of one bucket: twice the count of each gram, and
    one more if only one chunk asked for it; and the bucket's distinct training words."""
    asked = [unpack(x.as_py(), np.uint64) for x in t["gram"]]
    grams, back = np.unique(np.concatenate(asked), return_inverse=True)
    n = np.bincount(back, np.concatenate([unpack(x.as_py(), np.uint32) for x in t["n"]]), minlength=len(grams)).astype(np.uint64)
    alone = np.bincount(back, minlength=len(grams)) == 1
    each = np.split(back, np.cumsum([len(x) for x in asked])[:-1])
    is_word = np.zeros(len(grams), bool)
    for at, k in zip(each, t["kind"].to_pylist()):
        if k == WORD:
            is_word[at] = True
    value = n * np.uint64(2) + alone
    return pa.table({"bucket": t["bucket"], "chunk": t["chunk"], "kind": t["kind"], "n": pa.array([pack(value[at]) for at in each], pa.binary()),
                     "distinct": pa.array([int((is_word & (n > 0)).sum())] + [0] * (len(each) - 1), pa.int64())})


def short_grams(c: Chunk, told: pa.Table | None = None) -> list[Grams]:
    out = [single(c)]
    out.append(longer(c, out[0], 1))
    for kind, g in zip((WORD, PAIR), out if told is not None else ()):
        value = answers(told, kind, g.hash)
        g.n, g.here = value >> 1, value % 2 == 1
    return out


def long_grams(c: Chunk, short: list[Grams], depth: int, least: int, told: pa.Table | None = None) -> list[Grams]:
    """Grams of 1 to depth + 1 words.  Those of three and more whose contexts
    have frequent pairs only are candidates or not by their counts."""
    out, pairs = list(short), short[1]
    often = (pairs.at >= 0) & (pairs.n >= least)[pairs.at] if len(pairs.n) else np.zeros(len(c.tokens), bool)
    for size in range(2, depth + 1):
        g = longer(c, out[-1], size, often)
        g.here = out[-1].here[g.prefix] | out[-1].here[g.suffix]
        out.append(g)
    if told is not None:
        n = answers(told, LONGER, unsure(out))
        for g in out[2:]:
            g.n, take = g.own.copy(), int((~g.here).sum())
            g.n[~g.here], n = n[:take] >> 1, n[take:]
    return out


def unsure(grams: list[Grams]) -> np.ndarray:
    return np.concatenate([np.zeros(0, np.uint64), *[g.hash[~g.here] for g in grams[2:]]])


def contexts(grams: list[Grams], least: int) -> list[np.ndarray]:
    """Numbers of the candidates of each length."""
    return [np.flatnonzero((g.n >= least) & (g.n > 0)) for g in grams[:-1]]


def gains(grams: list[Grams], size: int, total: int, prior: float) -> np.ndarray:
    """The chunk's part of the gain in nats of each context of ``size`` words over
    its suffix: leave-one-out log-likelihood of its occurrences minus that of the
    suffix's distribution."""
    low, g = grams[size - 1], grams[size]
    use = np.flatnonzero((g.own > 0) & (low.n[g.prefix] > 0))
    n, c = g.n[use].astype(float), low.n[g.prefix[use]].astype(float)
    q = grams[0].n[g.word[use]] / max(total, 1)
    parent = q
    if size > 1:
        above = g.suffix[use]
        parent = (low.n[above] + prior * q) / (grams[size - 2].n[low.prefix[above]] + prior)
    own = g.own[use] * np.log((n - 1 + prior * parent) / (c - 1 + prior) / parent)
    return np.bincount(g.prefix[use], own, minlength=len(low.hash))


def kept_contexts(parts: DataFrame, n_buckets: int, n_tasks: int) -> DataFrame:
    """(bucket, h) of the candidates that pass the divergence test, and of all
    suffixes of those.

    A part is a chunk's gain less what its occurrences must gain, told in single
    precision.  A context passes if its parts add up to more than zero; then one of them is above zero,
    and only chunks with such a part (``ahead``) tell the context's suffixes."""
    def test(key, t):
        each = lambda name, dtype: [unpack(x.as_py(), dtype) for x in t[name]]
        grams, ahead = each("gram", np.uint64), each("ahead", np.uint32)
        h, back = np.unique(np.concatenate(grams), return_inverse=True)
        passed = np.bincount(back, np.concatenate(each("gain", np.float32)).astype(np.float64), minlength=len(h)) > 0
        told, level = np.concatenate([g[a] for g, a in zip(grams, ahead)]), np.concatenate(each("level", np.uint8)).astype(np.int64)
        owner = np.repeat(told, level - 1)                      # a context of k words has k - 1 suffixes
        suffixes = np.concatenate(each("suffix", np.uint64))[passed[np.searchsorted(h, owner)]]
        return pa.table({"h": np.unique(np.concatenate([h[passed], suffixes])).view(np.int64)})

    found = parts.repartition(n_tasks, "bucket").groupBy("bucket").applyInArrow(test, "h long").distinct()
    return written(found.select(F.shiftrightunsigned("h", 65 - n_buckets.bit_length()).cast("int").alias("bucket"), "h"), "lm-kept")


def token_scores(c: Chunk, grams: list[Grams], kept: list[np.ndarray], total: int, distinct: int, prior: float):
    """(known, log10 root probability, log10 model probability) of each token;
    kept: of each length, whether each gram is a kept context."""
    root_n = grams[0].n[c.tokens].astype(float)
    root = (root_n + 0.5) / (total + 0.5 * (distinct + 1))
    p = root.copy()
    for size, keep in enumerate(kept, 1):
        at = np.flatnonzero((c.at >= size) & np.concatenate((np.zeros(1, bool), (grams[size - 1].at >= 0)[:-1])))
        context = grams[size - 1].at[at - 1]
        at, context = at[keep[context]], context[keep[context]]
        p[at] = (grams[size].n[grams[size].at[at]] + prior * p[at]) / (grams[size - 1].n[context] + prior)
    return root_n > 0, np.log10(root), np.log10(p)


SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"


def score(docs: DataFrame, train, min_gain: float = 0.02, prior: float = 100.0, chunk_chars: int = 5_000_000,
          id_col: str = "doc_id", text_col: str = "text", min_count: int = 20, depth: int = 3) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of
    every row; ``train``: condition over doc_id that picks the training rows."""
    rows = take(docs, id_col, text_col).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    n_tasks = TASKS * docs.sparkSession.sparkContext.defaultParallelism
    chunks = packed_chunks(rows.select("doc_id", "text", F.coalesce(train, F.lit(True)).alias("train")), chunk_chars, n_tasks)
    total, tokens = chunks.agg(F.coalesce(F.sum("train_tokens"), F.lit(0)), F.coalesce(F.sum(F.aggregate("n_tokens", F.lit(0).cast("long"), lambda a, n: a + n)), F.lit(0))).first()
    n_buckets = max(8, 1 << int(tokens // BUCKET_TOKENS).bit_length())
    least = min_count
    slim = chunks.select("chunk", "doc_id", "train", "n_tokens", "tokens", "vocabulary")

    def ask_short(batches):
        for b in batches:
            for row in rows_of(b):
                for kind, g in zip((WORD, PAIR), short_grams(load(row))):
                    yield pa.RecordBatch.from_pylist(requests(row["chunk"].as_py(), kind, g.hash, g.own, n_buckets), schema=REQUEST_ARROW)

    def each(f, empty):
        """``f`` for a chunk, with what was answered to it."""
        def run(key, left, right):
            if not left.num_rows:
                return empty
            row = next(rows_of(left.combine_chunks().to_batches()[0]))
            return f(row, load(row), right)
        return run

    def with_answers(told):
        return slim.groupBy("chunk").cogroup(told.repartition(n_tasks, "chunk").groupBy("chunk"))

    def ask_long(row, c, told):
        grams = long_grams(c, short_grams(c, told), depth, least)
        own = np.concatenate([np.zeros(0, np.int64), *[g.own[~g.here] for g in grams[2:]]])
        return pa.Table.from_pylist(requests(row["chunk"].as_py(), LONGER, unsure(grams), own, n_buckets), schema=REQUEST_ARROW)

    def parts(row, c, told):
        grams = long_grams(c, short_grams(c, told), depth, least, told)
        cands = contexts(grams, least)
        join = lambda f, dtype: np.concatenate([np.asarray(f(k, at), dtype) for k, at in enumerate(cands)])
        h, level = join(lambda k, at: grams[k].hash[at], np.uint64), join(lambda k, at: np.full(len(at), k + 1), np.uint8)
        gain = join(lambda k, at: gains(grams, k + 1, total, prior)[at] - min_gain * grams[k].own[at], np.float64)
        below = [np.zeros((len(grams[0].hash), 0), np.uint64)]            # hashes of the suffixes of each gram, the longest first
        for low, g in zip(grams, grams[1:-1]):
            below.append(np.hstack([low.hash[g.suffix][:, None], below[-1][g.suffix]]))
        chain = [x[at] for x, at in zip(below, cands)]
        start = np.cumsum([0, *map(len, chain)])
        out = []
        for i, at in buckets(h, n_buckets):
            ahead = np.flatnonzero(gain[at] > 0)
            suffix = [chain[level[j] - 1][j - start[level[j] - 1]] for j in at[ahead]]
            out.append({"bucket": i, "chunk": row["chunk"].as_py(), "gram": pack(h[at]), "gain": pack(gain[at].astype(np.float32)), "ahead": pack(ahead.astype(np.uint32)),
                        "level": pack(level[at][ahead]), "suffix": pack(np.concatenate([np.zeros(0, np.uint64), *suffix]))})
        return pa.Table.from_pylist(out, schema=CONTEXT_ARROW)

    def tell_kept(key, left, right):
        kept = np.sort(right["h"].to_numpy().view(np.uint64))
        told = [pack(np.isin(unpack(x.as_py(), np.uint64), kept).astype(np.uint64)) for x in left["gram"]]
        return pa.table({"bucket": left["bucket"], "chunk": left["chunk"], "kind": pa.array([KEPT] * len(told), pa.int32()), "n": pa.array(told, pa.binary()),
                         "distinct": pa.array([0] * len(told), pa.int64())})

    def run(row, c, told):
        grams = long_grams(c, short_grams(c, told), depth, least, told)
        cands = contexts(grams, least)
        flags = answers(told, KEPT, np.concatenate([grams[k].hash[at] for k, at in enumerate(cands)])) == 1
        kept = []
        for g, at in zip(grams, cands):
            mine = np.zeros(len(g.hash), bool)
            mine[at], flags = flags[:len(at)], flags[len(at):]
            kept.append(mine)
        known, base, own = token_scores(c, grams, kept, total, distinct, prior)
        add = lambda v: np.add.reduceat(v, c.first)
        return pa.table({"doc_id": row["doc_id"].values, "held_out": pa.array(~c.train), "n_tokens": pa.array(c.n_tokens),
                         "n_known": pa.array(add(known.astype(np.int64))), "base_score": pa.array(add(base)), "score": pa.array(add(own))})

    def summed_up(asked, name):
        return written(asked.repartition(n_tasks, "bucket").groupBy("bucket").applyInArrow(summed, REPLY), name)

    told = summed_up(slim.mapInArrow(ask_short, REQUEST), "lm-short")
    distinct = told.agg(F.sum("distinct")).first()[0] or 0
    if depth > 1:
        told = told.unionByName(summed_up(with_answers(told).applyInArrow(each(ask_long, REQUEST_ARROW.empty_table()), REQUEST), "lm-longer"))
    found = written(with_answers(told).applyInArrow(each(parts, CONTEXT_ARROW.empty_table()), CONTEXT), "lm-gains")
    kept = kept_contexts(found, n_buckets, n_tasks)
    told = told.unionByName(found.select("bucket", "chunk", "gram").repartition(n_tasks, "bucket").groupBy("bucket").cogroup(kept.repartition(n_tasks, "bucket").groupBy("bucket")).applyInArrow(tell_kept, REPLY))
    none = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()),
                      ("base_score", pa.float64()), ("score", pa.float64())]).empty_table()
    scored = with_answers(told).applyInArrow(each(run, none), SCORES)
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), "base_score", "score")
