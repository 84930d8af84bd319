"""Embedding near-duplicates: products of int8 tiles with rigorous error bounds, verified in full precision.

Each unit vector x is stored as s*q with q int8; its rounding error e has a known length. For two of
them |x.y - s_x s_y q_x.q_y| <= (1 + |e_x|) |e_y| + |e_x|, so pairs whose quantised product is further than
that above or below the threshold are settled, and only the rest are recomputed in double precision.
Equal vectors are reduced to one class first, and each class is quantised once. The classes of a label are cut
into tiles, and each pair of tiles is a group of bounded size that holds codes, a byte a component. It yields
counts and a spanning forest, never its pairs, and names the classes that have an unsettled pair; those alone
are sent there once more, in full precision.

Cases: a vector that is null, empty, all zero, or holds a null or non-finite component links with
nothing, and so does one with a null label; vectors of different lengths never link; repeated rows are
vectors of their own, and link with each other; other columns are ignored, whatever their names; an empty table
gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skylattice.llm.common import drop_stage, release_shuffles, stage
from skylattice.llm.graph import components

#: Classes of a tile. A group holds two tiles at most.
TILE = 2048


def quantise(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Unit vectors' int8 codes, their scales and the lengths of the rounding errors."""
    top = np.abs(vectors).max(axis=1)
    unit = vectors / top[:, None]
    unit /= np.sqrt((unit * unit).sum(axis=1))[:, None]
    scale = np.abs(unit).max(axis=1) / 127.0
    codes = np.rint(unit / scale[:, None]).astype(np.int8)
    error = unit - codes * scale[:, None]
    return codes, scale, np.sqrt((error * error).sum(axis=1))


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer products of int8 codes. Single precision holds the sums exactly up to 2**24."""
    kind = np.float32 if a.shape[1] * 127 * 127 < 1 << 24 else np.float64
    return a.astype(kind) @ b.astype(kind).T


def settled(codes: np.ndarray, scale: np.ndarray, error: np.ndarray, rows: np.ndarray, columns: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Which of rows x columns (indices) surely have a cosine of at least the threshold, and which may."""
    found = product(codes[rows], codes[columns]) * scale[rows][:, None] * scale[columns][None, :]
    bound = (1 + error[rows])[:, None] * error[columns][None, :] + error[rows][:, None]
    sure = found - bound >= threshold + 1e-9
    return sure, ~sure & (found + bound >= threshold - 1e-9)


def verified(vectors: np.ndarray, rows: np.ndarray, columns: np.ndarray, maybe: np.ndarray, threshold: float) -> np.ndarray:
    """Which of the pairs that may reach the threshold do, in double precision."""
    i, j = np.nonzero(maybe)
    out = np.zeros(maybe.shape, dtype=bool)
    for at in range(0, len(i), 1 << 16):
        x, y = vectors[rows[i[at : at + (1 << 16)]]], vectors[columns[j[at : at + (1 << 16)]]]
        x = x / np.abs(x).max(axis=1)[:, None]
        y = y / np.abs(y).max(axis=1)[:, None]
        norms = np.sqrt((x * x).sum(axis=1)) * np.sqrt((y * y).sum(axis=1))
        out[i[at : at + (1 << 16)], j[at : at + (1 << 16)]] = (x * y).sum(axis=1) / norms >= threshold
    return out


def linked(vectors: np.ndarray, rows: np.ndarray, columns: np.ndarray, threshold: float) -> np.ndarray:
    """Which of rows x columns (indices into vectors) have a cosine of at least the threshold."""
    sure, maybe = settled(*quantise(vectors), rows, columns, threshold)
    return sure | verified(vectors, rows, columns, maybe, threshold)


def _summed(near: np.ndarray, same: bool, rows: np.ndarray, columns: np.ndarray, ids: np.ndarray, copies: np.ndarray) -> pd.DataFrame:
    """Counts of linked vectors for each class (u, w), and edges (u, v) that join what links join."""
    every = np.arange(len(ids))
    if same:
        near = near | near.T
        np.fill_diagonal(near, False)
    weight = np.zeros(len(ids), dtype=np.int64)
    weight[rows] += near @ copies[columns]
    if not same:
        weight[columns] += near.T @ copies[rows]
    label = every.copy()
    while near.any():
        before = label.copy()
        label[rows] = np.minimum(label[rows], np.where(near, label[columns][None, :], len(ids)).min(axis=1))
        label[columns] = np.minimum(label[columns], np.where(near, label[rows][:, None], len(ids)).min(axis=0))
        if (label == before).all():
            break
    counted, joined = np.flatnonzero(weight), np.flatnonzero(label != every)
    return pd.DataFrame(
        {
            "u": np.concatenate([ids[counted], ids[joined]]),
            "v": np.concatenate([ids[counted], ids[label[joined]]]),
            "w": np.concatenate([weight[counted], np.zeros(len(joined), dtype=np.int64)]),
        }
    )


def _sides(pdf: pd.DataFrame) -> tuple[bool, np.ndarray, np.ndarray]:
    p, q, own = pdf["p"].iat[0], pdf["q"].iat[0], pdf["own"].to_numpy()
    return p == q, np.flatnonzero(own == p), np.flatnonzero(own == q)


GROUP = ["label", "dim", "p", "q"]


def compare(pdf: pd.DataFrame, threshold: float) -> pd.DataFrame:
    """A pair of tiles by codes alone: what is settled (u, v, w), and the classes u with an unsettled pair, which
    keep their group and side."""
    same, rows, columns = _sides(pdf)
    ids, copies = pdf["class_id"].to_numpy(), pdf["copies"].to_numpy()
    codes = np.frombuffer(b"".join(pdf["code"]), dtype=np.int8).reshape(len(pdf), -1)
    sure, maybe = settled(codes, pdf["scale"].to_numpy(), pdf["error"].to_numpy(), rows, columns, threshold)
    if same:
        np.fill_diagonal(maybe, False)
    out = _summed(sure, same, rows, columns, ids, copies).assign(own=-1)
    open_ones = np.union1d(rows[maybe.any(axis=1)], columns[maybe.any(axis=0)])
    more = pd.DataFrame({"u": ids[open_ones], "v": ids[open_ones], "w": 0, "own": pdf["own"].to_numpy()[open_ones]})
    out = pd.concat([out, more], ignore_index=True)
    return out.assign(**{c: [pdf[c].iat[0]] * len(out) for c in GROUP})[[*GROUP, "own", "u", "v", "w"]]


def recompute(pdf: pd.DataFrame, threshold: float) -> pd.DataFrame:
    """The unsettled pairs of a pair of tiles, in full precision."""
    same, rows, columns = _sides(pdf)
    vectors = np.array(pdf["vector"].tolist(), dtype=np.float64)
    _, maybe = settled(*quantise(vectors), rows, columns, threshold)
    near = verified(vectors, rows, columns, maybe, threshold)
    return _summed(near, same, rows, columns, pdf["class_id"].to_numpy(), pdf["copies"].to_numpy())


def _coded(classes: DataFrame) -> DataFrame:
    """classes with code, scale and error of each vector."""

    def batches(it):
        for pdf in it:
            code, scale, error = [b""] * len(pdf), np.zeros(len(pdf)), np.zeros(len(pdf))
            sizes = pdf["vector"].map(len).to_numpy()
            for size in np.unique(sizes):
                at = np.flatnonzero(sizes == size)
                codes, scale[at], error[at] = quantise(np.array(pdf["vector"].iloc[at].tolist(), dtype=np.float64))
                for i, c in zip(at, codes):
                    code[i] = c.tobytes()
            yield pdf.assign(dim=sizes.astype(np.int32), code=code, scale=scale, error=error)

    return classes.mapInPandas(batches, f"{', '.join(f'{f.name} {f.dataType.simpleString()}' for f in classes.schema.fields)}, dim int, code binary, scale double, error double")


def near_duplicates(vectors: DataFrame, threshold: float = 0.98) -> DataFrame:
    """vectors(vec_id, embedding, label): (vec_id, n_links, component_id, kept), one row per vector."""
    kind = vectors.schema["embedding"].dataType.simpleString()
    rows = vectors.select(
        F.col("vec_id").cast("long"),
        F.col("label"),
        F.expr("transform(embedding, x -> x + cast(0 as " + ("float" if kind == "array<float>" else "double") + "))").alias("vector"),
    )
    usable = F.expr(
        "label is not null and size(vector) > 0 and forall(vector, x -> x is not null and abs(x) < double('infinity'))"
        " and exists(vector, x -> x <> 0)"
    )
    rows = rows.withColumn("usable", F.coalesce(usable, F.lit(False)))
    good = rows.filter("usable").select("vec_id", "label", "vector", F.xxhash64("vector").alias("h"))
    classes = good.groupBy("label", "h", "vector").agg(F.min("vec_id").alias("class_id"), F.count("*").alias("copies"))
    classes = stage(_coded(classes), "vec-classes")
    sizes = classes.groupBy("label", "dim").agg(F.count("*").alias("n"))
    tiled = (
        classes.drop("vector", "h")
        .join(sizes, ["label", "dim"])
        .withColumn("tiles", F.ceil(F.col("n") / TILE).cast("int"))
        .withColumn("own", F.pmod(F.xxhash64("class_id"), F.col("tiles")).cast("int"))
        .withColumn("other", F.explode(F.expr("sequence(0, tiles - 1)")))
        .select("label", "dim", F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q"), "own", "class_id", "copies", "code", "scale", "error")
    )
    kinds = {f.name: f.dataType.simpleString() for f in tiled.schema.fields}
    grouped = tiled.groupBy(*GROUP).applyInPandas(
        lambda pdf: compare(pdf, threshold), ", ".join(f"{c} {kinds[c]}" for c in [*GROUP, "own"]) + ", u long, v long, w long"
    )
    first = stage(grouped, "vec-settled")
    open_ones = first.filter("own >= 0").select(*GROUP, "own", F.col("u").alias("class_id"))
    exact = open_ones.join(classes.select("class_id", "label", "dim", "copies", "vector"), ["class_id", "label", "dim"]).groupBy(*GROUP).applyInPandas(lambda pdf: recompute(pdf, threshold), "u long, v long, w long")
    found = stage(first.filter("own < 0").select("u", "v", "w").union(exact), "vec-links")
    drop_stage(first)
    release_shuffles(vectors.sparkSession)
    counts = found.groupBy(F.col("u").alias("class_id")).agg(F.sum("w").alias("others"))
    joined = components(found.filter("u <> v").select("u", "v")).withColumnRenamed("node", "class_id")
    summed = stage(
        classes.select("label", "h", "vector", "class_id", "copies")
        .join(counts, "class_id", "left")
        .join(joined, "class_id", "left")
        .select(
            "label",
            "h",
            "vector",
            (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"),
            F.coalesce("component", "class_id").alias("component_id"),
        ),
        "vec-result",
    )
    linked_rows = good.join(summed, ["label", "h", "vector"]).select("vec_id", "n_links", "component_id")
    alone = rows.filter("not usable").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked_rows.union(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


ORACLE = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE label IS NOT NULL AND len(embedding) > 0 AND list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x)))
    AND list_bool_or(list_transform(embedding, lambda x: x <> 0))
), pairs AS (
  SELECT a.vec_id AS u, b.vec_id AS w FROM v a JOIN v b ON a.label = b.label AND len(a.e) = len(b.e) AND a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.e, b.e) >= 0.98
), reach AS (SELECT vec_id AS u, vec_id AS w FROM embeddings UNION SELECT r.u, p.w FROM reach r JOIN pairs p ON r.w = p.u)
SELECT u AS vec_id, (SELECT count(*) FROM pairs WHERE pairs.u = reach.u) AS n_links, min(w) AS component_id, u = min(w) AS kept FROM reach GROUP BY u
"""
