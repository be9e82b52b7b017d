"""Training-data pipeline over ``documents``: language, toxicity, near copies, repeated passages, packing.

Every stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; between stages the rows are written as
Parquet and read again. All stages but the last return the columns of ``documents``; the last returns the packed pieces.

Defined results: an empty table passes every stage; rows with a null or letterless text leave in the first stage; extra
columns of ``documents`` are dropped; repeated rows are copies of each other, one of which stays; unlike texts under one id are
different documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from headwise.llm import adaptive_jaccard, best_fit, language_id, run_length_dedup, toxicity
from headwise.sources.staging import fresh_path

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised: letters, and a confidence above the calibrated threshold."""
    return language_id.predict(docs, language_id.fit(docs), tuple(COLUMNS)).where("accepted").select(*COLUMNS)


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below the threshold, learned from the labels of the documents at hand."""
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.score(docs, model, tuple(COLUMNS)).where(F.col("score") < toxicity.THRESHOLD).select(*COLUMNS)


def near_copy_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies (five words, similarity 0.8): one with the smallest id. Rows are told apart by id and
    text, so unlike texts under one id are different documents, and of equal rows one stays. Rows without id belong to no group
    and stay."""
    docs = docs.select(*COLUMNS)
    keyed = docs.where("doc_id is not null").withColumn("_key", F.xxhash64("doc_id", "text"))
    groups = adaptive_jaccard.near_copies(keyed.select(F.col("_key").alias("doc_id"), "text"), words=5, percent=80)
    ids = keyed.select("_key", "doc_id").distinct()
    first = groups.select(F.col("doc_id").alias("_key"), "component_id").distinct().join(ids, "_key").groupBy("component_id").agg(
        F.min(F.struct("doc_id", "_key")).alias("first")).select("first._key")
    kept = keyed.join(first.hint("merge"), "_key", "left_semi").dropDuplicates(["_key"]).drop("_key")
    return kept.unionByName(docs.where("doc_id is null"))


def repeats_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages of 200 bytes or more that occur elsewhere too; characters cut in two go with them."""
    cut = run_length_dedup.remove_repeats(docs.select(*COLUMNS), as_text=True)
    return cut.withColumn("text", F.when(F.col("text").isNotNull(), F.col("kept"))).withColumn(
        "n_chars", F.length("text").cast("long")).select(*COLUMNS)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Tokenised pieces packed into sequences of 2048 tokens."""
    pieces = best_fit.pieces(docs, public_tokenizers.path("byte_bpe_50k.json"))
    return best_fit.pack(pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32")))


STAGES = [
    ("language_id", language_stage),
    ("toxicity", toxicity_stage),
    ("near_copies", near_copy_stage),
    ("repeated_passages", repeats_stage),
    ("packing", packing_stage),
]

ORACLE_SQL = None  # learned and iterative stages; tests compare each stage with a plain version


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other over ``documents``; what the last stage returns."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        path = fresh_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
