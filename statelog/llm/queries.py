"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from statelog.llm import (
    byte_quality,
    decontaminate,
    fertility,
    hmm,
    lexical_packing,
    licences,
    merkle,
    near_dup,
    packing,
    site_templates,
    spelling,
    suffix_dedup,
    toxicity,
)
from statelog.llm.common import table


def op1_site_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return site_templates.main_texts(table(spark, sf_dir, "pages"))


def op2_word_convolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_licence_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan(table(spark, sf_dir, "documents"))


def op4_tokeniser_fertility(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fertility.quality_report(table(spark, sf_dir, "documents"))


def op5_minhash_hamming_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicate_report(table(spark, sf_dir, "documents"))


def op6_residual_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op7_byte_convolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_quality.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_minhash_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_hidden_markov_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hmm.score_texts(table(spark, sf_dir, "documents"))


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.removal_report(table(spark, sf_dir, "documents"))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return merkle.manifest(docs, merkle.without_line_ends(docs))


def op12_lexical_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_packing.pack(table(spark, sf_dir, "documents"))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_site_templates": op1_site_templates,
    "op2_word_convolution": op2_word_convolution,
    "op3_licence_classifier": op3_licence_classifier,
    "op4_tokeniser_fertility": op4_tokeniser_fertility,
    "op5_minhash_hamming_join": op5_minhash_hamming_join,
    "op6_residual_packing": op6_residual_packing,
    "op7_byte_convolution": op7_byte_convolution,
    "op8_minhash_containment": op8_minhash_containment,
    "op9_hidden_markov_model": op9_hidden_markov_model,
    "op10_suffix_dedup": op10_suffix_dedup,
    "op11_merkle_manifest": op11_merkle_manifest,
    "op12_lexical_packing": op12_lexical_packing,
    "op13_spelling_variants": op13_spelling_variants,
}

ORACLE_SQL: dict[str, str] = {
    "op5_minhash_hamming_join": near_dup.SQL,
    "op8_minhash_containment": decontaminate.SQL,
    "op10_suffix_dedup": suffix_dedup.SQL,
    "op11_merkle_manifest": merkle.SQL,
    "op13_spelling_variants": spelling.SQL,
}
