"""Labelled synthetic tracks, and a trainable baseline for trajectory labels."""

from __future__ import annotations

import json

import numpy as np
from pyspark.errors import AnalysisException
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skylattice import consts as C

# Ranges that tracks are drawn from.
START = {"lat": (48.0, 54.0), "lon": (-2.0, 12.0), "alt": (5000.0, 12000.0)}
VELOCITY = {"lat": (0.001, 0.005), "lon": (0.002, 0.008), "alt": (-2.0, 2.0)}
NORMAL_GDOP, NORMAL_DIVERGENCE = (1.0, 5.0), (0.0, 50.0)
ODD_GDOP, ODD_DIVERGENCE = (8.0, 20.0), (500.0, 5000.0)
JUMP_DEG, JUMP_ALT, ODD_START = (0.02, 0.08), (2000.0, 5000.0), (5, 15)
STEP_S = 0.1
CLASS_WEIGHT = {0: 1.0, 1: 4.0}

KINDS = ("normal", "jump", "flip", "teleport", "frozen")


def synthetic_tracks(spark: SparkSession, n_normal: int = 800, n_odd: int = 200, seed: int = 7) -> DataFrame:
    """(key, kind, label, states of twenty arrays of eight): normal tracks, and four kinds of odd ones,
    the last kind taking the remainder. From some step on, an odd track jumps sideways, reports its ground speed
    reversed, jumps up, or stands still on the map; its dilution and divergence are odd throughout. Draws are hashes
    of (key, name, step, seed), so that they don't depend on partitions."""

    def draw(name: str, low: float, high: float, step: Column | None = None) -> Column:
        parts = ["key", F.lit(name), F.lit(seed), *([] if step is None else [step])]
        return low + F.pmod(F.xxhash64(*parts), F.lit(1 << 40)) / float(1 << 40) * (high - low)

    each = max(n_odd // 4, 1)
    kind = F.when(F.col("key") < n_normal, "normal")
    for i, k in enumerate(KINDS[1:4]):
        kind = kind.when(F.col("key") < n_normal + (i + 1) * each, k)
    rows = spark.range(n_normal + n_odd).withColumnRenamed("id", "key").withColumn("kind", kind.otherwise("frozen"))
    rows = rows.withColumn("at", F.floor(draw("at", *ODD_START)).cast("int"))
    for a in START:
        rows = rows.withColumn(f"p_{a}", draw(f"p{a}", *START[a])).withColumn(f"v_{a}", draw(f"v{a}", *VELOCITY[a]))
    rows = rows.withColumns({"jump_lat": draw("jump lat", *JUMP_DEG), "jump_lon": draw("jump lon", *JUMP_DEG), "jump_alt": draw("jump alt", *JUMP_ALT)})

    def state(i: Column) -> Column:
        odd = F.col("kind") != "normal"
        now = lambda k: (F.col("kind") == k) & (i >= F.col("at"))
        sideways = F.when(now("frozen"), F.col("at").cast("double")).otherwise(i.cast("double"))
        shift = lambda k, a: F.when(now(k), F.col(f"jump_{a}")).otherwise(0.0)
        turned = F.when(now("flip"), -1.0).otherwise(1.0)
        return F.array(
            F.col("p_lat") + F.col("v_lat") * STEP_S * sideways + shift("jump", "lat"),
            F.col("p_lon") + F.col("v_lon") * STEP_S * sideways + shift("jump", "lon"),
            F.col("p_alt") + F.col("v_alt") * STEP_S * i + shift("teleport", "alt"),
            F.col("v_lat") * turned, F.col("v_lon") * turned, F.col("v_alt"),
            F.when(odd, draw("odd gdop", *ODD_GDOP, i)).otherwise(draw("gdop", *NORMAL_GDOP, i)),
            F.when(odd, draw("odd divergence", *ODD_DIVERGENCE, i)).otherwise(draw("divergence", *NORMAL_DIVERGENCE, i)),
        )

    states = F.transform(F.sequence(F.lit(0), F.lit(C.SEQ_LEN - 1)), state)
    return rows.select("key", "kind", (F.col("kind") != "normal").cast("int").alias("label"), states.alias("states"))


def scaled(tracks: DataFrame, mean: list[float], std: list[float]) -> DataFrame:
    """Adds features: all states as one vector of z-scores."""
    z = F.transform("states", lambda s: F.transform(s, lambda v, i: (v - F.get(F.array(*map(F.lit, mean)), i)) / F.get(F.array(*map(F.lit, std)), i)))
    return tracks.withColumn("features", array_to_vector(F.flatten(z)))


def train(tracks: DataFrame, mean: list[float], std: list[float]):
    """A weighted logistic regression on the 160 numbers of a track."""
    weight = F.when(F.col("label") == 1, CLASS_WEIGHT[1]).otherwise(CLASS_WEIGHT[0])
    model = LogisticRegression(featuresCol="features", labelCol="label", weightCol="weight", regParam=0.01, maxIter=50)
    return model.fit(scaled(tracks, mean, std).withColumn("weight", weight))


def accuracy(model, tracks: DataFrame, mean: list[float], std: list[float]) -> DataFrame:
    judged = model.transform(scaled(tracks, mean, std))
    return judged.agg(F.avg((F.col("prediction") == F.col("label")).cast("double")).alias("accuracy"), F.count("*").alias("n"))


def save_model(spark: SparkSession, weights: dict, mean: list[float], std: list[float], path: str) -> None:
    """Weights of the network (as in `linear.lstm_forward`) with the scales of its features, as one JSON line that
    Spark writes, so that any store will do."""
    plain = {"layers": [{k: np.asarray(v).tolist() for k, v in layer.items()} for layer in weights["layers"]]}
    plain |= {k: np.asarray(weights[k]).tolist() for k in ("out_w", "out_b")}
    text = json.dumps({"weights": plain, "mean": list(mean), "std": list(std)})
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)


def load_model(spark: SparkSession, path: str) -> tuple[dict | None, list[float], list[float]]:
    """(weights, mean, std) of save_model(); no weights where there is nothing, so that labels are unknown."""
    try:
        text = spark.read.text(path, wholetext=True).first()
    except AnalysisException:
        text = None
    if text is None:
        return None, [0.0] * C.N_FEATURES, [1.0] * C.N_FEATURES
    found = json.loads(text[0])
    weights = {"layers": [{k: np.array(v) for k, v in layer.items()} for layer in found["weights"]["layers"]]}
    weights |= {k: np.array(found["weights"][k]) for k in ("out_w", "out_b")}
    return weights, found["mean"], found["std"]
