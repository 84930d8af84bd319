"""The corpus pipeline: five stages, each an operator applied to all that the stage before kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from skylattice.llm import decontaminate, line_dedup, mixing, quality, similar
from skylattice.llm.common import drop_stage, stage, table


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs, table(spark, sf_dir, "labels"), threshold=0.3)


def distinct_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return line_dedup.drop_repeated_lines(docs, edits=2, shortest=20, fuzzy=20)


def distinct_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return similar.drop_near_duplicates(docs, shingle_words=5, similarity=0.8)


def clean_of_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"), rate=0.1)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    domains = mixing.quality_domains(table(spark, sf_dir, "labels"))
    return mixing.mix(docs, domains, mixing.TARGETS)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", good_documents),
    ("line_dedup", distinct_lines),
    ("simhash", distinct_documents),
    ("decontaminate", clean_of_benchmark),
    ("mixing", mixed),
]

#: The stages hold trained models and edit distances, which SQL can't express.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    *first, last = STAGES
    for name, f in first:
        made = stage(f(spark, docs, sf_dir), f"pipeline-{name}")
        drop_stage(docs)
        docs = made
    return last[1](spark, docs, sf_dir)
