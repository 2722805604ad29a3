"""Five stages that make packed training sequences of ``documents``.

Quality rules drop documents, the n-gram join keeps one of each group of near copies, substring
dedup cuts passages that an earlier document has, decontamination drops documents that hold
benchmark passages, and packing turns the rest into sequences of 2048 tokens. Each stage's rows are
written as Parquet and read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from hornspark.llm import best_fit_packing, ngram_jaccard, quality_ledger, spaced_seeds, substring_dedup
from hornspark.llm.common import Scratch, read_table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_ledger.kept_documents(spark, docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component; rows are told apart by id and text, so an id that two texts share loses only copies."""
    return ngram_jaccard.kept_documents(spark, docs)


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return substring_dedup.remove_spans(docs, substring_dedup.substring_dedup(spark, docs)).select(docs.columns)


def benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return spaced_seeds.clean_documents(spark, docs, read_table(spark, sf_dir, "benchmark")).select(docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return best_fit_packing.pack(spark, docs)


STAGES = [
    ("quality rules", quality),
    ("n-gram Jaccard join", near_copies),
    ("substring dedup", passages),
    ("benchmark decontamination", benchmarks),
    ("best-fit packing", packing),
]

#: Tokens and compact windows are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    scratch = Scratch(spark, "pipeline")
    for _, stage in STAGES[:-1]:
        docs = scratch.keep(stage(spark, docs, sf_dir))
    return scratch.finish(STAGES[-1][1](spark, docs, sf_dir))
