"""The registered queries of the training-data operators, with production parameters, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from corpusloom.llm import bpe, decontaminate, fingerprints, licenses, lines, neardup, quality, secrets, substrings, toxicity
from corpusloom.llm._spark import documents

RANKS = "byte_bpe_multi_50k.tiktoken"


def op1_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digests(secrets.scan(documents(spark, sf_dir)))


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(documents(spark, sf_dir), labels(spark, sf_dir))


def op2_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.dedupe(documents(spark, sf_dir)).drop("kept")


def op4_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.dedupe(documents(spark, sf_dir)).select("doc_id", "n_removed", "text")


def op5_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.dedupe(documents(spark, sf_dir))


def op6_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.compare(documents(spark, sf_dir))


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.search(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(documents(spark, sf_dir), labels(spark, sf_dir))


def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(documents(spark, sf_dir))


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe.digests(documents(spark, sf_dir), public_tokenizers.path(RANKS), public_tokenizers.PATTERN)


QUERIES = {f.__name__: f for f in (op1_secrets, op2_substrings, op3_quality, op4_lines, op5_neardup, op6_fingerprints, op7_decontaminate, op8_toxicity, op9_licenses, op10_bpe)}
ORACLE: dict[str, str] = {"op2_substrings": substrings.SQL.format(size=50), "op4_lines": lines.SQL.format(least_chars=12, least_sites=10), "op5_neardup": neardup.SQL.format(percent=80), "op9_licenses": licenses.SQL}
