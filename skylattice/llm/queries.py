"""One query for each operator of this subpackage, over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skylattice.llm import chat, decontaminate, embedding_dedup, line_dedup, mixing, pii, quality, secrets, simhash, substring_dedup
from skylattice.llm.common import table


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), rate=0.1)


def op4_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.perspectives(table(spark, sf_dir, "conversations"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"), shingle_words=3, distance=3)
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    domains = mixing.quality_domains(table(spark, sf_dir, "labels"))
    found = mixing.rates(table(spark, sf_dir, "documents"), domains, mixing.TARGETS)
    shares = [F.get("p", F.lit(i)).alias(f"p_{d}") for i, d in enumerate(sorted(mixing.TARGETS))]
    return found.select("doc_id", "n_tokens", *shares, "rate")


def op2_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring_dedup.digest(table(spark, sf_dir, "documents"), length=100)
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(table(spark, sf_dir, "documents"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup.drop_repeated_lines(table(spark, sf_dir, "documents"), edits=2, shortest=20, fuzzy=20, counts=True)
    return found.select(
        "doc_id",
        F.col("_n_lines").alias("n_lines"),
        F.col("_n_removed").alias("n_removed"),
        F.col("_n_near").alias("n_near"),
        F.sha2(F.encode(F.coalesce("text", F.lit("")), "UTF-8"), 256).alias("kept_sha256"),
    )


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "start", "end", F.sha2(F.encode("token", "UTF-8"), 256).alias("token_sha256"), "score", "secret")


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return found.select(
        "doc_id",
        F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= 0.3).cast("int").alias("predicted"),
    )


def op10_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(table(spark, sf_dir, "embeddings"), threshold=0.98)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_mixing": op1_mixing,
    "op2_suffix_array": op2_suffix_array,
    "op3_decontaminate": op3_decontaminate,
    "op4_chat": op4_chat,
    "op5_simhash": op5_simhash,
    "op6_pii": op6_pii,
    "op7_line_dedup": op7_line_dedup,
    "op8_secrets": op8_secrets,
    "op9_quality": op9_quality,
    "op10_embeddings": op10_embeddings,
}

ORACLES: dict[str, str] = {"op4_chat": chat.ORACLE, "op10_embeddings": embedding_dedup.ORACLE}
