"""Registered queries of this subpackage: name -> callable(spark, sf_dir) -> DataFrame, each over whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from headwise.llm import (
    adaptive_jaccard, best_fit, byte_bpe, collision_dedup, host_trust, impact_topk, language_id, maxent_lm, periodic_runs, quality,
    run_length_dedup, spelling_variants, toxicity,
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(function):
    QUERIES[function.__name__] = function
    return function


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op4_quality_classifier(spark, sf_dir):
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op5_toxicity(spark, sf_dir):
    return toxicity.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op10_language_id(spark, sf_dir):
    return language_id.identify(table(spark, sf_dir, "documents")).select(
        "doc_id", "held_out", "lang_pred", "score", "accepted")


@query
def op2_url_trust(spark, sf_dir):
    return host_trust.judge(table(spark, sf_dir, "pages"))


@query
def op6_byte_bpe(spark, sf_dir):
    ranks = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    coded = byte_bpe.encode(table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN)
    return byte_bpe.decode(coded, ranks).select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")).cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"))


@query
def op9_best_fit(spark, sf_dir):
    cut = best_fit.pieces(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return best_fit.pack(cut.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32")))


@query
def op1_impact_topk(spark, sf_dir):
    return impact_topk.search(table(spark, sf_dir, "embeddings"), F.col("id") % 100 == 0)


@query
def op3_collision_dedup(spark, sf_dir):
    return collision_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


@query
def op7_adaptive_jaccard(spark, sf_dir):
    return adaptive_jaccard.near_copies(table(spark, sf_dir, "documents"), words=4, percent=85)


@query
def op8_run_length_dedup(spark, sf_dir):
    cut = run_length_dedup.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return cut.select(
        "doc_id", "n_bytes", (F.col("n_bytes") - F.length("kept")).cast("long").alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


@query
def op11_periodic_runs(spark, sf_dir):
    planted = periodic_runs.with_planted_runs(table(spark, sf_dir, "documents"))
    longest = F.array_max(F.transform("runs", lambda r: F.struct(
        r.length.alias("length"), (-r.start).alias("start"), (-r.period).alias("period"))))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r.start, r.length, r.period), F.lit("\n")))
    return periodic_runs.find_runs(planted).withColumn("best", longest).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("best.start")).alias("start"),
        F.col("best.length").alias("length"), (-F.col("best.period")).alias("period"),
        F.floor(F.lit(1000) * F.col("best.length") / -F.col("best.period")).cast("long").alias("exponent_milli"),
        F.sha2(F.array_join(lines, "").cast("binary"), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))


@query
def op13_spelling_variants(spark, sf_dir):
    return spelling_variants.spelling_variants(table(spark, sf_dir, "documents"), drop_every=31)


@query
def op12_maxent_lm(spark, sf_dir):
    return maxent_lm.score_corpus(table(spark, sf_dir, "documents"))
