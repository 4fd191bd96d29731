"""Corpus pipeline: each stage reads what the stage before it kept and decides
on all of it; all but the last return the columns of ``documents``.

toxicity        rejects documents graded 1 or more
line_dedup      drops lines that a smaller document holds
simhash         keeps the smallest document of each near-duplicate group
mixing          samples documents towards target weights
bpe             adds the token ids and their count

An empty table passes through all stages as an empty table; other columns of
any name come out as they went in.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.llm import bpe, line_dedup, mixing, simhash, toxicity
from ledgerlens.llm.common import aside
from ledgerlens.session import cut_lineage


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose probability of grade 1 or more is below one half; each row
    is graded by its own text, and a null text is the empty one."""
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = toxicity.with_severity(docs, model)
    n = len(docs.columns)
    safe = scored.toDF(*[f"c{i}" for i in range(n)], "severity").where("severity.grade = 0")
    return safe.drop("severity").toDF(*docs.columns)


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that a smaller document holds; n_chars
    follows the new text.  Null texts stay null."""
    bitmaps = line_dedup.keep_bitmaps(docs).select(F.col("doc_id").alias("_doc"), F.col("row_key").alias("_key"), "keep", "n_dropped")
    safe, (doc_id, text) = aside(docs, "doc_id", "text")
    joined = safe.join(bitmaps, (F.col(doc_id) == F.col("_doc")) & (F.xxhash64(text) == F.col("_key")), "left")
    changed = F.coalesce(F.col("n_dropped") > 0, F.lit(False))
    kept = joined.withColumn("_kept", F.when(changed, line_dedup.kept_text(F.col(text), F.col("keep"))).otherwise(F.col(text)))
    out = []
    for i, c in enumerate(docs.columns):
        name = f"_in{i}"
        if name == text:
            out.append(F.col("_kept"))
        elif c == "n_chars":
            out.append(F.when(changed, F.length("_kept").cast(docs.schema[i].dataType)).otherwise(F.col(name)))
        else:
            out.append(F.col(name))
    return kept.select(*[v.alias(f"_in{i}") for i, v in enumerate(out)]).toDF(*docs.columns)


def simhash_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: the smallest doc_id.
    Of rows that repeat that id one stays; rows without an id all stay."""
    groups = (simhash.simhash_groups(docs, shingle=3, max_bits=2)
              .where("doc_id = component_id").select(F.col("doc_id").alias("_keep")).distinct())
    safe, (doc_id,) = aside(docs, "doc_id")
    named = safe.where(F.col(doc_id).isNotNull()).join(groups, F.col(doc_id) == F.col("_keep"), "left_semi").dropDuplicates([doc_id])
    return named.unionByName(safe.where(F.col(doc_id).isNull())).toDF(*docs.columns)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample of the documents that holds half of all tokens in expectation and
    whose token shares are the targets: observed shares of each source, language
    and form to the power 0.7, or what a class can give if that is less.
    Documents without a word are all kept; a null text has none, a null source or
    language is the empty one, and repeated rows of an id stay or go together."""
    return mixing.mix(docs, alpha=0.7)


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with token_ids (little-endian unsigned 32-bit integers) and
    their count n_tokens; a null or empty text has none, and every row is encoded."""
    coded = bpe.encode(docs, out_col="token_ids", remembered=150_000)      # workers of earlier stages are still there
    n = len(docs.columns)
    safe = coded.toDF(*[f"c{i}" for i in range(n)], "ids")
    return safe.withColumn("n", F.expr("octet_length(ids) div 4")).toDF(*docs.columns, "token_ids", "n_tokens")


STAGES = [("toxicity", toxicity_stage), ("line_dedup", line_dedup_stage), ("simhash_near_dedup", simhash_stage),
          ("mixing", mixing_stage), ("bpe", bpe_stage)]

#: No stage but line deduplication can be said in SQL; tests hold the rows against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = cut_lineage(docs, f"pipeline-{name}")
    return docs
