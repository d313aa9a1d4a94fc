"""Corpus pipeline: line rules, near-duplicates, repeated paragraphs, secrets, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sonolume.llm import packing, paragraphs, quality, secrets, simhash
from sonolume.llm.common import fresh, materialize, quoted


def _with_length(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast("long"))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass, without their failing lines. Null texts are rejected."""
    return _with_length(quality.kept_documents(docs))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group: the smallest by id (null ids last), then by the hashes of the text and of the row."""
    columns = [F.col(quoted(c)) for c in docs.columns]
    text, row, i, t, r = (fresh(docs, f"near_{c}") for c in ("text", "row", "id", "t", "r"))
    keyed = docs.withColumns({text: F.xxhash64("text"), row: F.xxhash64(*columns, *(c.isNull() for c in columns))})
    keepers = simhash.class_keepers(keyed, (text, row)).select(F.col("doc_id").alias(i), F.col(text).alias(t), F.col(row).alias(r))
    kept = keyed.join(keepers, (F.col(text) == F.col(t)) & (F.col(row) == F.col(r)) & F.col("doc_id").cast("long").eqNullSafe(F.col(i)), "left_semi")
    return kept.dropDuplicates(["doc_id", text, row]).select(*columns)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, its text without the paragraphs that an earlier document or line has."""
    return _with_length(paragraphs.remove_repeats(docs))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, its secrets replaced by a mark."""
    return _with_length(secrets.redact_secrets(docs))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece of each document: its bin, the bin's capacity and the piece's place in it."""
    return packing.pack(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("substring_dedup", substring_dedup),
    ("secret_scan", secret_scan),
    ("best_fit_packing", best_fit_packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; each stage's result is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)


#: MinHash and SimHash classes and guess costs are not SQL; tests/llm/test_pipeline.py compares with plain Python.
ORACLE_SQL = None
