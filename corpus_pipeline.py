"""From raw documents to token ids: five stages over the ``documents`` table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from broadsheet.llm import bpe, decontaminate, near, quality, secrets
from broadsheet.llm.batches import importable, written
from broadsheet.session import configure

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def _ready(spark: SparkSession) -> None:
    importable(configure(spark))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rule and the classifier."""
    _ready(spark)
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group."""
    _ready(spark)
    return near.keep_first(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated by benchmark passages."""
    _ready(spark)
    return decontaminate.keep_clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their secrets replaced by marks."""
    _ready(spark)
    return secrets.redact(docs)


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the ids and of the decoded bytes."""
    _ready(spark)
    return bpe.digests(bpe.round_trip(docs, RANKS, public_tokenizers.PATTERN, sparing=True))


STAGES = [
    ("quality rules", quality_rules),
    ("near dedup", near_dedup),
    ("benchmark decontamination", benchmark_decontamination),
    ("secret scan", secret_scan),
    ("byte-level BPE", byte_bpe),
]

#: A learned classifier decides in the first stage, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (_, stage) in enumerate(STAGES, 1):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES):
            docs = written(docs)
    return docs
