"""A corpus pipeline over ``documents``: quality, near duplicates, leaks, secrets, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowcascade.llm import decontaminate, packing, quality_rules, secrets, simhash
from flowcascade.llm.common import load, named
from flowcascade.session import stage


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep; every row is judged by its own text.

    Null and empty texts go, of repeated rows all stay or go, an empty table stays empty.
    """
    return quality_rules.keep_documents(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every group of near duplicates the document with the smallest id.

    Repeated rows are one group, and so are all empty texts, null ones with them.  Null ids
    come last; of equal ids the first row stays.  An empty table stays empty.
    """
    row = "row"
    while row in docs.columns:      # a number per row, so that rows with one id or none differ
        row += "_"
    rows = stage(docs.withColumn(row, F.monotonically_increasing_id()), "simhash-rows")
    groups = simhash.near_duplicates(rows, id_col=row).select(
        F.col("doc_id").alias(row), "component_id")
    ids = rows.select(row, "doc_id")
    order = F.struct(F.col("doc_id").isNull(), "doc_id", row)
    kept = groups.join(ids, row).groupBy("component_id").agg(F.min_by(row, order).alias(row))
    return rows.join(kept.select(row), row, "left_semi").select(
        *map(named, docs.columns))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of ``benchmark``.

    Null and empty texts hold none; repeated rows are judged each; an empty table, and an
    empty benchmark, change nothing.
    """
    return decontaminate.drop_leaks(docs, load(spark, sf_dir, "benchmark"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their secrets replaced; null texts stay null, other columns as they are."""
    return secrets.redact_secrets(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in training sequences, null texts as empty ones."""
    return packing.pack_documents(docs)


STAGES = [
    ("quality rules", quality),
    ("simhash near-dedup", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("secret scans", secret_scan),
    ("packing", pack),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stage applied to ``documents``, each written before the next one reads it."""
    docs = load(spark, sf_dir, "documents")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), "pipeline-" + name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
