"""SimHash near-duplicates: fingerprints of word shingles, linked by pigeonhole blocks.

64 bits are cut into six blocks. Fingerprints within three bits agree on at least three whole blocks,
so every pair within the limit meets in one of C(6, 3) = 20 tables, keyed by three blocks (some 32
bits); a Hamming test then verifies it. Copies share one fingerprint and are reduced to it first.

Cases: a null text counts as empty; a text without words has fingerprint zero and links like any
other; documents with equal fingerprints are linked; repeated doc_ids give repeated rows with the same
component; columns besides doc_id and text are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skylattice.llm.common import drop_stage, fresh, release_shuffles, stage
from skylattice.llm.graph import components

#: Bits of each block, from the lowest up.
BLOCKS = (11, 11, 11, 11, 10, 10)
#: Fingerprints of a bucket that one task compares with another part of it.
TILE = 256


def fingerprint(text: bytes, shingle_words: int, chunk: int = 1 << 14) -> int:
    """The fingerprint of one text as an unsigned number; hashes are counted in bounded chunks."""
    import xxhash

    words = text.lower().split()
    if not words:
        return 0
    if len(words) <= shingle_words:
        return xxhash.xxh64_intdigest(b" ".join(words), 42)
    joined = b" ".join(words)
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths)[: len(words) - shingle_words + 1].tolist()
    ends = ends[shingle_words - 1 :].tolist()
    digest = xxhash.xxh64_digest
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(starts), chunk):
        raw = b"".join([digest(joined[a:b], 42) for a, b in zip(starts[at : at + chunk], ends[at : at + chunk])])
        bits = np.unpackbits(np.frombuffer(raw, dtype=np.uint8).reshape(-1, 8), axis=1)
        ones += bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(starts)).tobytes(), "big")


def of_hashes(hashes: np.ndarray, chunk: int = 1 << 14) -> int:
    """The fingerprint of 64-bit hashes, as an unsigned number: zero for none."""
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), chunk):
        raw = hashes[at : at + chunk].astype(">i8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(raw, axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, shingle_words: int = 5) -> DataFrame:
    """(doc_id, fp): the fingerprint as a signed long."""

    def batches(it):
        for batch in it:
            texts = batch.column(1).cast(pa.large_binary())
            found = [fingerprint(t.as_py() or b"", shingle_words) for t in texts]
            fps = np.array(found, dtype=np.uint64).astype(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps)], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(batches, "doc_id long, fp long")


def _keys(distance: int) -> list[tuple[int, Column]]:
    starts = [sum(BLOCKS[:i]) for i in range(len(BLOCKS))]
    masks = [((1 << b) - 1) << s for b, s in zip(BLOCKS, starts)]
    signed = lambda m: m - (1 << 64) if m >= 1 << 63 else m
    return [
        (i, F.col("fp").bitwiseAND(F.lit(signed(sum(masks[b] for b in chosen))).cast("long")))
        for i, chosen in enumerate(combinations(range(len(BLOCKS)), len(BLOCKS) - distance))
    ]


def forest(fps: np.ndarray, sides: np.ndarray | None, distance: int) -> list[tuple[int, int]]:
    """Edges that join what pairs within the distance join, one fewer than members at most. sides:
    compare only members of different sides."""
    n = len(fps)
    parent = np.arange(n)

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    edges = []
    for i in range(n - 1):
        rest = np.bitwise_count(fps[i + 1 :] ^ fps[i]) <= distance
        if sides is not None:
            rest &= sides[i + 1 :] != sides[i]
        for j in np.flatnonzero(rest).tolist():
            a, b = root(i), root(i + 1 + j)
            if a != b:
                parent[b] = a
                edges.append((i, i + 1 + j))
    return edges


def fingerprint_links(distinct: DataFrame, distance: int = 3) -> DataFrame:
    """distinct(fp): edges (u, v) between fingerprints; their components are those of all pairs
    within the distance. Buckets of more than TILE members are cut into tiles, and each pair of
    tiles is a group of its own, so no group grows with a bucket and no bucket's pairs are rows."""
    if distance >= len(BLOCKS):
        raise ValueError(f"a distance below {len(BLOCKS)} is needed")
    keyed = distinct.select(
        "fp", F.explode(F.array(*(F.struct(F.lit(i).cast("byte").alias("t"), k.alias("k")) for i, k in _keys(distance)))).alias("b")
    ).select("fp", "b.t", "b.k")
    sizes = keyed.groupBy("t", "k").agg(F.count("*").alias("n")).filter("n > 1")
    shared = stage(keyed.join(sizes, ["t", "k"]), "simhash")
    small = shared.filter(F.col("n") <= TILE)
    bits = F.expr(f"bit_count(a.fp ^ b.fp) <= {int(distance)}")
    few = (
        small.filter("n <= 8").alias("a")
        .join(small.filter("n <= 8").alias("b"), F.expr("a.t = b.t and a.k = b.k and a.fp < b.fp") & bits)
        .select(F.col("a.fp").alias("u"), F.col("b.fp").alias("v"))
    )
    tiles = F.ceil(F.col("n") / TILE).cast("int")
    own = F.pmod(F.xxhash64("fp"), tiles).cast("int")
    tiled = (
        shared.filter("n > 8")
        .select("t", "k", "fp", own.alias("own"), tiles.alias("tiles"))
        .select("t", "k", "fp", "own", F.explode(F.expr("sequence(0, tiles - 1)")).alias("other"))
        .select("t", "k", "fp", "own", F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q"))
    )

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("fp")
        fps = pdf["fp"].to_numpy().astype(np.uint64)
        sides = pdf["own"].to_numpy() if pdf["p"].iat[0] != pdf["q"].iat[0] else None
        values = pdf["fp"].to_numpy()
        return pd.DataFrame([(values[i], values[j]) for i, j in forest(fps, sides, distance)], columns=["u", "v"], dtype="int64")

    many = tiled.groupBy("t", "k", "p", "q").applyInPandas(compare, "u long, v long")
    out = stage(few.union(many).distinct(), "simhash-links")
    drop_stage(shared)
    return out


def near_duplicates(docs: DataFrame, shingle_words: int = 5, distance: int = 3) -> DataFrame:
    """(doc_id, fp long, component_id): the smallest doc_id reachable over links."""
    prints = stage(fingerprints(docs, shingle_words), "simhash-fp")
    distinct = stage(prints.groupBy("fp").agg(F.min("doc_id").alias("first_doc")), "simhash-distinct")
    edges = fingerprint_links(distinct.select("fp"), distance)
    joined = components(edges).withColumnRenamed("node", "fp")
    grouped = distinct.join(joined, "fp", "left").select("fp", "first_doc", F.coalesce("component", "fp").alias("component"))
    least = grouped.groupBy("component").agg(F.min("first_doc").alias("component_id"))
    out = stage(prints.join(grouped.join(least, "component").select("fp", "component_id"), "fp").select("doc_id", "fp", "component_id"), "simhash-classes")
    for x in (prints, distinct, edges):
        drop_stage(x)
    release_shuffles(docs.sparkSession)
    return out


def drop_near_duplicates(docs: DataFrame, shingle_words: int = 5, distance: int = 3) -> DataFrame:
    """The documents without all but the first (smallest doc_id) of each group; columns stay. Of rows that repeat the
    first doc_id, all stay."""
    (name,) = fresh(docs.columns, "gone")
    found = near_duplicates(docs, shingle_words, distance)
    gone = found.filter("doc_id <> component_id").select(F.col("doc_id").alias(name)).distinct()
    return docs.join(gone, F.col("doc_id").cast("long") == F.col(name), "left_anti")
