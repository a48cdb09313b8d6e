"""A training corpus from ``documents``: five stages, each over all that the one
before has kept, each written as Parquet and read again by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from foliospark.llm import common
from foliospark.llm.exact_dedup import keep_one
from foliospark.llm.jaccard import keep_representatives
from foliospark.llm.language import keep_identified
from foliospark.llm.packing import pack
from foliospark.llm.pii import redact
from foliospark.llm.queries import BYTE_BPE


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of an identified language stay."""
    return keep_identified(docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the largest id stays."""
    return keep_one(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of near copies (five-word shingles, similarity 0.75) the smallest id stays."""
    return keep_representatives(docs)


def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by the name of its kind."""
    return redact(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences of at most 2048 ids."""
    return pack(docs, BYTE_BPE)


STAGES = [("language", language), ("exact_dedup", exact), ("near_dedup", near), ("pii", private), ("packing", packed)]

#: The language model is trained, so SQL cannot give the rows; tests compare the
#: pipeline with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to ``documents``."""
    ws = common.Workspace(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = ws.stage(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
