"""The registered queries of the training-data operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowcascade.llm import (
    chat,
    decontaminate,
    licenses,
    merkle,
    packing,
    quality_rules,
    secrets,
    sharding,
    simhash,
    suffix_dedup,
    token_files,
    urls,
    whitening,
)
from flowcascade.llm.common import load
from flowcascade.llm.oracle import ORACLE  # noqa: F401 - read by the entry module

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(load(spark, sf_dir, "documents"))


@query
def op2_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_leaks(load(spark, sf_dir, "documents"),
                                    load(spark, sf_dir, "benchmark"))


@query
def op3_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page takes the labels of the document with its number; toxic or poor ones block."""
    pages, labels = load(spark, sf_dir, "pages"), load(spark, sf_dir, "labels")
    block = (F.col("toxic") == 1) | (F.col("quality") == 0)
    labelled = pages.join(labels, pages["page_id"] == labels["doc_id"]).select(
        "url", block.alias("block"))
    return urls.judge_urls(pages, urls.mine_rules(labelled))


@query
def op4_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls, results = chat.calls_of(load(spark, sf_dir, "conversations"))
    return chat.link_tool_calls(calls, results, chat.SCHEMAS)


@query
def op5_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(load(spark, sf_dir, "documents"))


@query
def op6_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(load(spark, sf_dir, "documents"))


@query
def op7_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(load(spark, sf_dir, "documents"))


@query
def op8_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.find_secrets(load(spark, sf_dir, "documents"))


@query
def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_rows(load(spark, sf_dir, "documents"), 40)


@query
def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(load(spark, sf_dir, "documents"))


@query
def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten_embeddings(load(spark, sf_dir, "embeddings"))


@query
def op12_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.encode_documents(load(spark, sf_dir, "documents"))


@query
def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.audit_documents(load(spark, sf_dir, "documents"))
