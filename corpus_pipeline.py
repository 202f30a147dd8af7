"""The corpus pipeline: quality, line dedup, near-dedup, decontamination, byte-level BPE, over whole tables.

Every stage takes what its predecessor kept. The first four return the columns of documents; the last returns, for
each document that is left, doc_id, n_tokens and the digests of its ids and of the decoded bytes. Rejected documents
go in stage 1, boilerplate lines are cut from the texts in stage 2, one document of each near-duplicate group (the
one of the smallest id) stays in stage 3, documents that contain a benchmark item go in stage 4.

All columns of documents go through the first four stages as they are, but for text and n_chars, whatever their names. Rows are judged by
their own text: repeated rows and rows that share an id get each its own decision in stages 1, 2 and 4; in stage 3 all rows of an id stay or
go with the one of least set hash, and rows without an id stay. Null and empty texts are judged by the classifier like any other and, if
kept, go through with no words and no tokens. Texts of any length are whole in every stage. Empty tables give an empty table. The
stages' tables are deleted when the program ends.
"""

from __future__ import annotations

import atexit
import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from corpusloom.llm import bpe, decontaminate, lines, neardup, quality
from corpusloom.llm._spark import documents, remove, shared_dir, ship
from corpusloom.llm.queries import RANKS


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 3: the documents that the quality classifier accepts."""
    ship(spark)
    return quality.keep(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4: the documents without cross-site boilerplate lines; every document stays."""
    ship(spark)
    return lines.dedupe(docs, counted="").select(*docs.columns)


def neardup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5, five-word shingles: one document of each near-duplicate group.

    Of rows that share an id all stay or go; rows without an id stay.
    """
    ship(spark)
    gone = neardup.dedupe(docs, shingle=5, percent=80).where("NOT kept").select("doc_id")
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7: the documents that contain no benchmark item."""
    ship(spark)
    return decontaminate.drop(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10: the byte-level BPE ids of each text, and their round trip."""
    ship(spark)
    return bpe.digests(docs, public_tokenizers.path(RANKS), public_tokenizers.PATTERN)


STAGES = [
    ("quality", quality_stage),
    ("line_dedup", line_stage),
    ("near_dedup", neardup_stage),
    ("decontamination", benchmark_stage),
    ("encoding", encoding_stage),
]

#: The classifier and the candidate search are no SQL; tests/llm holds the run against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; between stages the rows are written as Parquet and read again."""
    root = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    atexit.register(remove, spark, root)
    docs = documents(spark, sf_dir)
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs.write.mode("overwrite").parquet(f"{root}/{i}-{name}")
            docs = spark.read.parquet(f"{root}/{i}-{name}")
    return docs
