"""What the operators share: the folder for intermediate tables, and small helpers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skylattice.staging import drop_stage, release_shuffles, stage, work_dir  # noqa: F401


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(columns: list[str], *names: str) -> list[str]:
    """A name for each of names that none of the columns has, whatever its case."""
    taken = {c.lower() for c in columns}
    out = []
    for name in names:
        while (name := f"_{name}").lower() in taken:
            pass
        out.append(name)
    return out


def text_or_empty(column: str = "text"):
    return F.coalesce(F.col(column), F.lit(""))
