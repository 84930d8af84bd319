"""Connected components over an edge table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skylattice.llm.common import drop_stage, stage


def _signature(edges: DataFrame) -> tuple:
    row = edges.agg(
        F.count("*").alias("n"),
        F.coalesce(F.expr("bit_xor(xxhash64(u, v))"), F.lit(0)).alias("x"),
    ).first()
    return row["n"], row["x"]


def _star(pairs: DataFrame) -> DataFrame:
    """pairs: directed (u, v). Link every v to the smallest of u's neighbours and u itself. The
    minimum is an aggregate with map-side combining, and joins back on a unique key, so a hub is
    never gathered in one task."""
    least = pairs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return pairs.join(least, "u")


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """edges(u long, v long), in any direction, self-loops and repeats allowed. Returns
    (node, component): every node that occurs in an edge with a different end, and the smallest node
    it reaches. Each round is written to the shared folder, which cuts the lineage. Raises
    RuntimeError if the given number of rounds doesn't suffice, rather than return part of it."""
    current = stage(
        edges.filter("u is not null and v is not null and u <> v")
        .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        .distinct(),
        "cc",
    )
    known = _signature(current)
    for _ in range(rounds):
        if known[0] == 0:
            break
        both = current.union(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _star(both).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        starred = _star(large)
        small = (
            starred.select(F.col("v").alias("u"), F.col("m").alias("v"))
            .union(starred.select("u", F.col("m").alias("v")))
            .filter("u <> v")
            .distinct()
        )
        after = stage(small, "cc")
        drop_stage(current)
        current, before = after, known
        known = _signature(current)
        if known == before:
            break
    else:
        raise RuntimeError(f"components: not stable after {rounds} rounds")
    leaders = current.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return current.select(F.col("u").alias("node"), F.col("v").alias("component")).union(leaders)
