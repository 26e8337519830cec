"""The corpus pipeline: its stages in order, each written as Parquet and read again as the next one's documents.

Documents that fail the quality rules go; runs of lines that occur earlier are cut out of the texts; of each group of
near copies the document with the least id stays; documents that hold a benchmark item go; what is left is packed.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from swipewatch.llm import decontaminate, lines, packing, quality, simhash, text


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.quality_filter(docs, text.table(spark, sf_dir, "labels"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    text.prepare(spark)
    return lines.line_filter(docs, min_lines=3, min_words=50)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    text.prepare(spark)
    return simhash.keep_one(docs, shingle=3, radius=3)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.without_leaks(docs, text.table(spark, sf_dir, "benchmark"))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    text.prepare(spark)
    placed = packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), 1024, end_id=2)
    return placed.select(text.shown_id(), "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("simhash_near_dedup", near_dedup),
    ("benchmark_decontamination", decontamination),
    ("best_fit_packing", best_fit_packing),
]
ORACLE_SQL = None  # the trees, fingerprints and token ids have no SQL form; tests/llm compares run() with a brute-force version


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = text.prepare(spark).read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = text.stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
