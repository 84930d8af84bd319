"""From raw frames to decoded rows and correlation groups."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skylattice import consts as C
from skylattice.functions import modes


def finalize(frames: DataFrame) -> DataFrame:
    """Adds t_ns, payload (null for bad hex) and content_hash. All else stays, so a bad frame still
    registers its sensor."""
    payload = F.try_to_binary("raw_modes_hex", F.lit("hex"))
    out = frames.withColumn("t_ns", F.col("timestamp_seconds") * 1_000_000_000 + F.col("timestamp_nanoseconds")).withColumn("payload", payload)
    return out.withColumn("content_hash", F.xxhash64("payload"))


def with_keys(frames: DataFrame) -> DataFrame:
    """Adds df, crc and icao24; frames without an address have icao24 null."""
    out = frames.withColumn("df", modes.downlink_format(F.col("payload"))).withColumn("crc", modes.crc24_residual(F.col("payload")))
    return out.withColumn("icao24", modes.correlation_icao(F.col("payload"), F.col("crc")))


def positions(frames: DataFrame, semantics: str = "corrected") -> DataFrame:
    """Position messages of with_keys(): adds tc, nuc, odd, lat_cpr, lon_cpr, alt_m, altitude_source."""
    p = F.col("payload")
    odd, lat, lon = modes.cpr_fields(p)
    tc = modes.type_code(p)
    alt = modes.altitude_m(modes.altitude_raw(p), semantics)
    out = frames.filter(modes.is_position(p, F.col("crc"))).withColumns({"tc": tc, "nuc": modes.nuc(tc), "odd": odd, "lat_cpr": lat, "lon_cpr": lon, "alt_m": alt})
    out = out.withColumn("altitude_source", F.when(F.col("tc").between(20, 22), "gnss").otherwise("barometric"))
    return out.filter(~((F.col("altitude_source") == "gnss") & F.coalesce(F.col("alt_m") < C.ALT_MIN_M, F.lit(False))))


def cpr_positions(messages: DataFrame, semantics: str = "corrected") -> DataFrame:
    """messages(icao24, t_ns, odd, lat_cpr, lon_cpr): decodes each with the latest of the other parity,
    at most ten seconds older, of the same aircraft. Adds lat and lon (null without a pair)."""
    order = Window.partitionBy("icao24").orderBy("t_ns", "odd").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    last = lambda parity: F.last(F.when(F.col("odd") == parity, F.struct("t_ns", "lat_cpr", "lon_cpr")), ignorenulls=True).over(order)
    paired = messages.withColumn("_even", last(0)).withColumn("_odd", last(1))
    near = F.abs(F.col("_even.t_ns") - F.col("_odd.t_ns")) <= C.CPR_PAIR_AGE_NS
    field = lambda p, f: F.col(f"{p}.{f}").cast("double")
    lat, lon = modes.cpr_decode(field("_even", "lat_cpr"), field("_even", "lon_cpr"), field("_odd", "lat_cpr"), field("_odd", "lon_cpr"), F.col("odd"), semantics)
    return paired.withColumn("lat", F.when(near, lat)).withColumn("lon", F.when(near, lon)).drop("_even", "_odd")


def registry(frames: DataFrame) -> DataFrame:
    """Sensors as first seen: (sensor_id, lat, lon, alt)."""
    seen = frames.groupBy("sensor_id").agg(F.min_by(F.struct("sensor_lat", "sensor_lon", "sensor_alt"), "t_ns").alias("s"))
    return seen.select("sensor_id", *(F.col(f"s.sensor_{a}").alias(a) for a in ("lat", "lon", "alt")))


def override_locations(frames: DataFrame, overrides: DataFrame, most: int = 100_000) -> DataFrame:
    """Positions of sensors by public_key, where an override is known; of several for one key the greatest counts.
    Overrides are broadcast up to `most` rows."""
    named = overrides.groupBy("public_key").agg(F.max(F.struct("lat", "lon", "alt")).alias("_o"))
    named = named.select("public_key", *(F.col(f"_o.{a}").alias(f"_{a}") for a in ("lat", "lon", "alt")))
    side = F.broadcast(named) if named.limit(most + 1).count() <= most else named
    joined = frames.join(side, "public_key", "left")
    return joined.withColumns({f"sensor_{a}": F.coalesce(f"_{a}", f"sensor_{a}") for a in ("lat", "lon", "alt")}).drop("_lat", "_lon", "_alt")


#: Frames of an island that are followed at once.
CHUNK = 128


def correlate(frames: DataFrame, window_ns: int = C.CORRELATION_WINDOW_NS, least: int = 2) -> DataFrame:
    """Copies of one transmission: (icao24, payload, first_seen_ns, frames array of (sensor_id, t_ns)).

    Groups are anchored: a frame more than the window after the first of its group begins a new one. One
    frame of a sensor counts, the first. A gap above the window always begins a group, so islands
    between such gaps (few rows each) are cut first, and only inside one the anchors are followed."""
    order = Window.partitionBy("icao24", "payload").orderBy("t_ns", "sensor_id")
    kept = frames.filter("icao24 is not null and payload is not null").select("icao24", "payload", "t_ns", "sensor_id")
    gaps = kept.withColumn("new", (F.col("t_ns") - F.lag("t_ns").over(order) > window_ns).cast("int"))
    islands = gaps.withColumn("island", F.sum(F.coalesce("new", F.lit(0))).over(order))
    listed = islands.groupBy("icao24", "payload", "island").agg(F.array_sort(F.collect_list(F.struct("t_ns", "sensor_id"))).alias("rows"))
    none = F.array().cast("array<struct<anchor: bigint, t_ns: bigint, sensor_id: bigint>>")

    def follow(acc, r):
        anchor = F.when(acc["anchor"].isNull() | (r["t_ns"] - acc["anchor"] > window_ns), r["t_ns"]).otherwise(acc["anchor"])
        row = F.struct(anchor.alias("anchor"), r["t_ns"].alias("t_ns"), r["sensor_id"].cast("bigint").alias("sensor_id"))
        return F.struct(anchor.alias("anchor"), F.concat(acc["all"], F.array(row)).alias("all"))

    def chunk(acc, k):
        begin = F.struct(acc["anchor"].alias("anchor"), none.alias("all"))
        some = F.slice("rows", k * CHUNK + 1, F.lit(CHUNK))
        return F.aggregate(some, begin, follow, lambda x: F.struct(x["anchor"].alias("anchor"), F.concat(acc["parts"], F.array(x["all"])).alias("parts")))

    # An appended array is copied, so a long island is followed in chunks, whose results alone are put together.
    chunks = F.sequence(F.lit(0), F.floor((F.size("rows") - 1) / CHUNK).cast("int"))
    start = F.struct(F.lit(None).cast("bigint").alias("anchor"), F.array().cast("array<array<struct<anchor: bigint, t_ns: bigint, sensor_id: bigint>>>").alias("parts"))
    anchored = F.aggregate(chunks, start, chunk, lambda x: F.flatten(x["parts"]))
    rows = listed.select("icao24", "payload", F.explode(anchored).alias("r")).select("icao24", "payload", "r.*")
    first = rows.groupBy("icao24", "payload", "anchor", "sensor_id").agg(F.min("t_ns").alias("t_ns"))
    groups = first.groupBy("icao24", "payload", F.col("anchor").alias("first_seen_ns")).agg(F.array_sort(F.collect_list(F.struct("t_ns", "sensor_id"))).alias("frames"))
    return groups.filter(F.size("frames") >= least)


def sensor_pairs(groups: DataFrame) -> DataFrame:
    """All pairs of frames of a group, in arrival order: adds sensor_i, t_i, sensor_j, t_j. A group has a
    frame of each sensor at most."""
    left = groups.select("*", F.posexplode("frames").alias("_p", "_a"))
    pairs = left.select("*", F.explode(F.slice("frames", F.col("_p") + 2, F.size("frames"))).alias("_b"))
    return pairs.select(
        *groups.columns, F.col("_a.sensor_id").alias("sensor_i"), F.col("_a.t_ns").alias("t_i"), F.col("_b.sensor_id").alias("sensor_j"), F.col("_b.t_ns").alias("t_j")
    )
