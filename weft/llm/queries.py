"""The registered queries of this subpackage: thin digests of the operators, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import licences, mixing, pieces, pii, quality, sharding, simhash, tokens, topk, toxicity
from .common import table


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_rendezvous_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign_shards(table(spark, sf_dir, "documents"), 24)


def op3_simhash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_groups(table(spark, sf_dir, "documents"), radius=2, size=3)


def op4_section_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.attribute_tokens(table(spark, sf_dir, "documents"), rule="first")


def op5_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_documents(table(spark, sf_dir, "documents"), mixing.Mix())


def op6_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pii.pseudonymise(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "text", F.size("entities").alias("n_entities"), F.array_join(F.array_sort(F.array_distinct(F.col("entities.kind"))), ",").alias("kinds"))


def op7_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.exact_topk(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, k=10)


def op8_host_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality.verdicts(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op9_piece_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode_texts(table(spark, sf_dir, "documents"))


def op10_licence_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = licences.recognise(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.array_join("sentence_ids", ",").alias("sentence_ids"), F.array_join("licences", ",").alias("licences"), F.size("licences").alias("n_licences"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (op1_toxicity, op2_rendezvous_shards, op3_simhash_groups, op4_section_tokens, op5_source_mix, op6_pii_surrogates, op7_exact_topk, op8_host_quality, op9_piece_codes, op10_licence_rules, pipeline)}
