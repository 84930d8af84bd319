"""Multilateration inputs and track-level operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skylattice import consts as C
from skylattice.functions import geo


def feasible(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """pairs(keys, t_i, t_j, ix.., jx..): (keys, feasible): no pair's times differ more than light needs
    between them, with a margin."""
    d = geo.distance(tuple(F.col(f"i{a}") for a in "xyz"), tuple(F.col(f"j{a}") for a in "xyz"))
    ok = F.abs(F.col("t_i") - F.col("t_j")).cast("double") <= 1.05 * d / F.lit(C.C_M_PER_NS) + C.TDOA_GUARD_NS
    return pairs.groupBy(*keys).agg(F.bool_and(ok).alias("feasible"))


def tdoa(groups: DataFrame) -> DataFrame:
    """Time differences of a group's frames to its first, in metres: adds ref_sensor, sensor_id, tdoa_m."""
    rows = groups.withColumn("_r", F.col("frames")[0]).select("*", F.posexplode("frames").alias("_p", "_f")).filter("_p > 0")
    metres = (F.col("_f.t_ns") - F.col("_r.t_ns")).cast("double") * C.C_M_PER_NS
    return rows.select(*groups.columns, F.col("_r.sensor_id").alias("ref_sensor"), F.col("_f.sensor_id").alias("sensor_id"), metres.alias("tdoa_m"))


def altitude_weight(age_s: Column) -> Column:
    """Weight of an altitude so old; null when it is too old to bind."""
    error = C.ALT_ERROR_BASE_M + C.ALT_ERROR_RATE * age_s
    return F.when(error <= C.ALT_ERROR_MAX_M, 1.0 / error)


def spoof_check(track: DataFrame) -> DataFrame:
    """track(icao24, t_ns, lat, lon, alt_m, accuracy_m, claim struct(lat, lon, alt_m) or null): adds
    divergence_m and spoofed, against the last claim strictly before."""
    at = lambda p: F.struct(*(c.alias(a) for a, c in zip("xyz", geo.library_ecef(*(F.col(p + c) for c in ("lat", "lon", "alt_m"))))))
    order = Window.partitionBy("icao24").orderBy("t_ns").rowsBetween(Window.unboundedPreceding, -1)
    out = track.withColumn("_own", at("")).withColumn("_said", F.when(F.col("claim").isNotNull(), at("claim.")))
    out = out.withColumn("_c", F.last("_said", ignorenulls=True).over(order))
    vec = lambda p: tuple(F.col(f"{p}.{a}") for a in "xyz")
    out = out.withColumn("divergence_m", F.coalesce(geo.distance(vec("_own"), vec("_c")), F.lit(0.0)))
    limit = F.greatest(F.lit(C.SPOOF_M), 3.0 * F.col("accuracy_m"))
    return out.withColumn("spoofed", F.col("divergence_m") > limit).drop("_own", "_said", "_c")


def history(track: DataFrame, fields: list[str], length: int = C.HISTORY) -> DataFrame:
    """Adds states: the last so many rows of the aircraft, oldest first."""
    order = Window.partitionBy("icao24").orderBy("t_ns").rowsBetween(1 - length, 0)
    return track.withColumn("states", F.collect_list(F.struct(*fields)).over(order))


def altitude_age(track: DataFrame) -> DataFrame:
    """Adds alt_age_s: seconds since the aircraft last had an altitude, this row counting; 999 if never."""
    order = Window.partitionBy("icao24").orderBy("t_ns").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    last = F.last(F.when(F.col("alt_m").isNotNull(), F.col("t_ns")), ignorenulls=True).over(order)
    return track.withColumn("alt_age_s", F.coalesce((F.col("t_ns") - last).cast("double") / 1e9, F.lit(999.0)))


def last_valid_altitude(track: DataFrame) -> DataFrame:
    """Adds used_alt_m: the last altitude in range before the row, else its own if that is in range, else 5000 m."""
    valid = F.when(F.col("alt_m").between(C.ALT_MIN_M, C.ALT_MAX_M), F.col("alt_m"))
    order = Window.partitionBy("icao24").orderBy("t_ns").rowsBetween(Window.unboundedPreceding, -1)
    return track.withColumn("used_alt_m", F.coalesce(F.last(valid, ignorenulls=True).over(order), valid, F.lit(C.ALT_FALLBACK_M)))


def classify_due(track: DataFrame, interval_ns: int = C.CLASSIFY_INTERVAL_NS, least: int = C.CLASSIFY_STATES) -> DataFrame:
    """(icao24, t_ns): the rows of track(icao24, t_ns) at which a track is labelled: it has `least` states, and more than
    the interval has gone since the last label (the first such row always)."""
    order = Window.partitionBy("icao24").orderBy("t_ns")
    ready = track.select("icao24", "t_ns", F.row_number().over(order).alias("_n")).filter(F.col("_n") >= least)
    return rate_limited(ready, interval_ns + 1)


def rate_limited(track: DataFrame, interval_ns: int = C.SOLVE_INTERVAL_NS) -> DataFrame:
    """Rows that a greedy limit lets through: the first, then each at least the interval after the last
    one let through. Gaps of an interval always let through, so only the runs between are walked."""
    order = Window.partitionBy("icao24").orderBy("t_ns")
    gap = F.coalesce(F.col("t_ns") - F.lag("t_ns").over(order) >= interval_ns, F.lit(True))
    runs = track.select("icao24", "t_ns").distinct().withColumn("_g", gap.cast("int")).withColumn("_run", F.sum("_g").over(order))
    listed = runs.groupBy("icao24", "_run").agg(F.array_sort(F.collect_list("t_ns")).alias("ts"))
    passed = F.aggregate(
        "ts",
        F.array().cast("array<bigint>"),
        lambda acc, t: F.when((F.size(acc) == 0) | (t - F.element_at(acc, -1) >= interval_ns), F.concat(acc, F.array(t))).otherwise(acc),
    )
    return listed.select("icao24", F.explode(passed).alias("t_ns"))


def beacon_counts(groups: DataFrame) -> DataFrame:
    """Adds n_beacons: groups of the aircraft so far."""
    order = Window.partitionBy("icao24").orderBy("first_seen_ns").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return groups.withColumn("n_beacons", F.count("*").over(order))


_INFO = ("callsign", "squawk", "origin_country")


def enrich(track: DataFrame, info: DataFrame, ttl_s: int | None = None, most: int = 1_000_000) -> DataFrame:
    """Adds callsign, squawk and origin_country from info(icao24, callsign, squawk, origin_country, fetched_s), by the
    lower-case address. Without a time to live, the latest fetch of all counts, and the side is broadcast up to `most`
    rows. With one, the latest fetch at or before the row counts, if it is younger than that; a fetch that found nothing
    counts like any other, and hides what was found before."""
    named = info.select(F.lower("icao24").alias("_i"), F.col("fetched_s").alias("_at"), F.struct(*(F.nullif(F.trim(c), F.lit("")).alias(c) for c in _INFO)).alias("_info"))
    key = F.lower("icao24")
    if ttl_s is None:
        side = named.groupBy("_i").agg(F.max_by("_info", F.struct("_at", "_info")).alias("_info"))
        side = F.broadcast(side) if side.limit(most + 1).count() <= most else side
        return track.join(side, key == F.col("_i"), "left").select(*track.columns, *(F.col(f"_info.{c}").alias(c) for c in _INFO))
    # As-of join by a union and a running last value, so that neither side is multiplied.
    own = track.withColumns({"_i": key, "_t": F.col("t_ns"), "_own": F.lit(True), "_f": F.lit(None).cast("struct<at: bigint, info: struct<callsign: string, squawk: string, origin_country: string>>")})
    fetched = named.select(
        *(F.lit(None).cast(f.dataType).alias(f.name) for f in track.schema.fields),
        "_i", (F.col("_at") * 1_000_000_000).alias("_t"), F.lit(False).alias("_own"), F.struct(F.col("_at").cast("long").alias("at"), F.col("_info").alias("info")).alias("_f"),
    )
    order = Window.partitionBy("_i").orderBy("_t", "_own", "_f").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    both = own.unionByName(fetched).withColumn("_last", F.last("_f", ignorenulls=True).over(order)).filter("_own")
    young = F.col("_t") - F.col("_last.at") * 1_000_000_000 < ttl_s * 1_000_000_000
    return both.select(*track.columns, *(F.when(young, F.col(f"_last.info.{c}")).alias(c) for c in _INFO))


def padded(track: DataFrame) -> DataFrame:
    """states (arrays of eight numbers, oldest first) as exactly twenty: zeros in front, or the last twenty."""
    zeros = F.array_repeat(F.array_repeat(F.lit(0.0), C.N_FEATURES), F.greatest(F.lit(C.SEQ_LEN) - F.size("states"), F.lit(0)))
    last = F.when(F.size("states") > C.SEQ_LEN, F.slice("states", -C.SEQ_LEN, C.SEQ_LEN)).otherwise(F.col("states"))
    return track.withColumn("states", F.concat(zeros, last))


def feature_scales(track: DataFrame) -> DataFrame:
    """(feature, mean, std) over all states, population deviation with a small constant."""
    rows = track.select(F.explode("states").alias("s")).select(F.posexplode("s").alias("feature", "v"))
    return rows.groupBy("feature").agg(F.avg("v").alias("mean"), (F.stddev_pop("v") + C.STD_EPSILON).alias("std"))


def state_json(track: DataFrame) -> DataFrame:
    """(icao24, t_ns, json): the row as JSON without null fields; non-finite numbers count as null."""
    finite = [
        F.when(F.abs(F.col(f.name)) < float("inf"), F.col(f.name)).alias(f.name) if f.dataType.typeName() in ("double", "float") else F.col(f.name)
        for f in track.schema.fields
    ]
    return track.select("icao24", "t_ns", F.to_json(F.struct(*finite), {"ignoreNullFields": "true"}).alias("json"))
