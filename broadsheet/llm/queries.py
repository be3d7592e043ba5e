"""Queries of the numbered operators over whole tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from broadsheet.llm import alignment, bpe, decontaminate, licenses, lm, merkle, near, quality, secrets, sharding, simhash, suffixes, warc
from broadsheet.llm.batches import importable
from broadsheet.session import configure

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}
SHARDS = [f"shard-{i:02d}" for i in range(64)]
BYTE_LEVEL, PIECES = (public_tokenizers.path(name) for name in ("byte_bpe_50k.json", "piece_bpe_32k.model"))
RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def query(fn: Query) -> Query:
    @wraps(fn)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return fn(importable(configure(spark)), sf_dir)

    QUERIES[fn.__name__] = run
    return run


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op2_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.digests(warc.derivatives(warc.responses_of_pages(table(spark, sf_dir, "pages"))))


ORACLE["op2_warc_derivatives"] = warc.SQL


@query
def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"), licenses.template_table(spark, licenses.TEMPLATES | licenses.full_texts()))


ORACLE["op3_license_scan"] = licenses.SQL


@query
def op4_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(table(spark, sf_dir, "documents"))


@query
def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digests(secrets.scan(table(spark, sf_dir, "documents")))


ORACLE["op5_secret_scan"] = secrets.SQL


@query
def op6_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near.near_groups(table(spark, sf_dir, "documents"))


@query
def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


ORACLE["op7_decontamination"] = decontaminate.SQL


@query
def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.place(table(spark, sf_dir, "documents").select("doc_id"), "doc_id", SHARDS)
    return placed.select("doc_id", "slot", "shard")


@query
def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.digests(suffixes.remove_repeats(table(spark, sf_dir, "documents")))


@query
def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(bpe.round_trip(table(spark, sf_dir, "documents"), RANKS, public_tokenizers.PATTERN))


@query
def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest(table(spark, sf_dir, "documents"))


ORACLE["op11_merkle_manifest"] = merkle.SQL


@query
def op12_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_groups(table(spark, sf_dir, "documents"))


@query
def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.alignment(table(spark, sf_dir, "documents"), BYTE_LEVEL, PIECES)
