"""Registered queries of this subpackage: each applies one operator with
production parameters to its whole table."""

from __future__ import annotations

import hashlib
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import shared_dir
from . import bpe, langid, line_dedup, lm, mixing, neardup_vec, prefix_trie, secrets, simhash, topk, toxicity, warc, whitening
from .common import fold
from .oracle import SQL  # noqa: F401  (registered with the queries)

QUERIES = {}


def registered(fn):
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@F.arrow_udf(T.StringType())
def sha256_text(values: pa.Array) -> pa.Array:
    return pa.array([hashlib.sha256((v.as_py() or "").encode()).hexdigest() for v in values], pa.string())


@registered
def op1_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = simhash.simhash_groups(table(spark, sf_dir, "documents"), shingle=3, max_bits=2)
    return groups.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@registered
def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    scored = toxicity.with_severity(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", "severity.*").withColumn("toxic", F.col("grade") >= 1)


@registered
def op3_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (neardup_vec.near_duplicates(table(spark, sf_dir, "embeddings"), threshold=0.9)
            .withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False))))


@registered
def op4_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(table(spark, sf_dir, "documents"), train=fold("doc_id") != 1)


@registered
def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    bitmaps = line_dedup.keep_bitmaps(docs, min_chars=10)
    own_lines = F.size(F.split(F.coalesce("text", F.lit("")), "\n", -1)).cast("long")     # of rows without an id, which keep all
    return (docs.withColumn("row_key", F.xxhash64("text")).join(bitmaps, ["doc_id", "row_key"], "left")
            .select("doc_id", F.coalesce("n_lines", own_lines).alias("n_lines"), F.coalesce("n_dropped", F.lit(0).cast("long")).alias("n_dropped"), sha256_text(line_dedup.kept_text("text", "keep")).alias("kept_sha256")))


@registered
def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(table(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("base", lambda p: p["kind"] == kind)).cast("long")
    return found.select("doc_id", *[count(i).alias(f"n_{name}") for i, name in enumerate(secrets.BASE)],
                        F.sha2(secrets.as_text("base"), 256).alias("base_sha256"), secrets.as_text("spans").alias("spans"))


@registered
def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.train(docs.where(fold("doc_id") != 0))
    return (langid.with_language(docs.select("doc_id", "text"), model)
            .select("doc_id", (fold("doc_id") == 0).alias("held_out"), "predicted.*"))


@registered
def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    rows, (doc_id, _, lang, source) = mixing.calibrated(docs)
    return rows.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), F.col(lang).alias("lang"),
                       F.col("_topic").alias("topic"), F.col("_n_words").alias("n_words"), F.col("_prob").alias("probability"),
                       (mixing.draw(F.col(doc_id)) < F.col("_prob")).alias("sampled"))


@registered
def op9_top_k_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.expr("vec_id % 50 = 0"), k=5)


@registered
def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    @F.arrow_udf("struct<n_tokens:long,sha:string>")
    def digest(ids: pa.Array) -> pa.Array:
        raw = [v.as_py() for v in ids]
        return pa.StructArray.from_arrays([pa.array([len(b) // 4 for b in raw], pa.int64()),
                                           pa.array([hashlib.sha256(b).hexdigest() for b in raw], pa.string())], ["n_tokens", "sha"])

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    coded = bpe.decode(bpe.encode(docs).select("doc_id", "token_ids"))
    return (coded.select("doc_id", digest("token_ids").alias("d"), sha256_text("decoded").alias("decoded_sha256"))
            .select("doc_id", "d.n_tokens", F.col("d.sha").alias("ids_sha256"), "decoded_sha256"))


@registered
def op11_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    archives = shared_dir(spark, f"warc/{uuid.uuid4().hex}")
    warc.write_archives(table(spark, sf_dir, "pages"), archives, min_bytes=100)
    records = warc.read_archives(spark, archives)
    return records.select(warc.page_of("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type",
                          warc.page_of("refers_to").alias("refers_to"))


@registered
def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"), components=4)


@registered
def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.prefix_trie(table(spark, sf_dir, "conversations"), group=20, most=4)
