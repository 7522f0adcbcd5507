"""The operators over their whole tables, with SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from scoreloom.llm import langid, lines, lm, minhash, mixing, passages, pieces, pii, quality, runs, secretscan, tokalign, vectors

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def wrap(fn: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return wrap


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@query("op2_line_dedup", lines.ORACLE)
def line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.line_digest(documents(spark, sf_dir))


@query("op10_quality_rules")
def quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_rules(documents(spark, sf_dir)).drop("distance2")


@query("op7_minhash_near_dedup")
def minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(documents(spark, sf_dir), how=minhash.Near(shingle=3, per_cent=85))


@query("op8_source_mixing")
def source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sizes(documents(spark, sf_dir))


@query("op9_sentencepiece")
def sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encoding_digest(documents(spark, sf_dir))


@query("op1_language_id")
def language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.held_out_languages(documents(spark, sf_dir))


@query("op3_substring_dedup", passages.ORACLE)
def substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.passage_digest(documents(spark, sf_dir))


@query("op5_pii")
def personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_pii(documents(spark, sf_dir))


@query("op6_embedding_near_dedup")
def embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


@query("op4_lm_scoring")
def lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.cross_entropy_difference(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


@query("op13_tokenizer_alignment")
def tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokalign.alignment_digest(documents(spark, sf_dir))


@query("op11_secret_scan")
def secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secretscan.find_secrets(documents(spark, sf_dir))


@query("op12_periodic_runs")
def periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.run_digest(documents(spark, sf_dir))
