"""Receiver networks and traffic derived from the star schema, alike in Spark and in DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skylattice.consts import C_M_PER_NS
from skylattice.functions import geo, modes

#: Sensors of a region; a transmission is heard in its own region only.
PER_REGION = 8


#: Where a region lies, in SQL of either engine.
_NORTH = "cast(region % 10 as double) * cast(0.3 as double)"
_EAST = "cast(floor(region / cast(10 as double)) as bigint) % 20 * cast(0.5 as double)"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sensors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every supplier is a sensor. Regions of a few sensors each lie side by side, so that receptions grow with the
    transmissions and not with the network."""
    s = table(spark, sf_dir, "supplier").selectExpr("s_suppkey", f"s_suppkey div {PER_REGION} as region")
    return s.selectExpr(
        "s_suppkey as sensor_id",
        f"cast(49.9 as double) + cast(s_suppkey * 37 % 100 as double) / cast(100 as double) + {_NORTH} as lat",
        f"cast(-6.4 as double) + cast(s_suppkey * 61 % 220 as double) / cast(100 as double) + {_EAST} as lon",
        "cast(50 + s_suppkey * 13 % 150 as double) as alt",
        "region",
    )


def transmissions(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    regions = table(spark, sf_dir, "supplier").agg(F.greatest(F.lit(1), F.ceil(F.count("*") / PER_REGION)).cast("long").alias("regions"))
    e = e.crossJoin(F.broadcast(regions)).withColumn("region", F.col("user_id") % F.col("regions"))  # one row
    return e.selectExpr(
        "event_id",
        "timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', ts) * 1000 as t_ns",
        "lpad(hex(4194304 + user_id), 6, '0') as icao24",
        f"cast(50.1 as double) + cast(event_id * 7 % 1000 as double) / cast(2000 as double) + {_NORTH} as lat",
        f"cast(-5.3 as double) + cast(event_id * 13 % 1000 as double) / cast(500 as double) + {_EAST} as lon",
        "cast(9000 + event_id * 17 % 3000 as double) as alt_m",
        "value",
        "lower(lpad(hex(4194304 + user_id), 6, '0')) as hex6",  # a payload has room for 24 bits, as icao24 has
        "region",
    )


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw frames: each transmission received by two thirds of its region's sensors."""
    tx = transmissions(spark, sf_dir)
    body = F.concat(F.lit("8d"), F.col("hex6"), F.substring(F.md5(F.col("event_id").cast("string")), 1, 14))
    bare = F.unhex(F.concat(body, F.lit("000000")))
    tx = tx.withColumn("body", body).withColumn("crc", F.lpad(F.lower(F.hex(modes.crc24_residual(bare))), 6, "0"))
    x, y, z = geo.wgs84_to_ecef(F.col("lat"), F.col("lon"), F.col("alt_m"))
    tx = tx.withColumns({"bx": x, "by": y, "bz": z})
    s = sensors(spark, sf_dir).withColumnsRenamed({"lat": "sensor_lat", "lon": "sensor_lon", "alt": "sensor_alt"})
    sx, sy, sz = geo.wgs84_to_ecef(F.col("sensor_lat"), F.col("sensor_lon"), F.col("sensor_alt"))
    s = s.withColumns({"sx": sx, "sy": sy, "sz": sz})
    both = tx.join(s, "region").filter("(event_id + sensor_id) % 3 <> 0")
    d = geo.distance((F.col("bx"), F.col("by"), F.col("bz")), (F.col("sx"), F.col("sy"), F.col("sz")))
    t = F.col("t_ns") + F.round(d / C_M_PER_NS).cast("long") + (F.col("sensor_id") * 37 % 11 - 5) * 20
    both = both.withColumn("t_ns", t).withColumn("timestamp_nanoseconds", F.pmod("t_ns", F.lit(1_000_000_000)).cast("long"))
    payload = F.concat("body", F.when(F.col("event_id") % 10 == 0, F.lit("abcdef")).otherwise(F.col("crc")))
    # Whole seconds by integers: a double's last place is over a hundred nanoseconds there.
    return both.select(
        "event_id", "sensor_id", "sensor_lat", "sensor_lon", "sensor_alt", F.expr("(t_ns - timestamp_nanoseconds) div 1000000000").alias("timestamp_seconds"),
        "timestamp_nanoseconds", payload.alias("raw_modes_hex"), "lat", "lon", "alt_m", "bx", "by", "bz", "sx", "sy", "sz",
    )


def ecef_sql(lat: str, lon: str, alt: str) -> tuple[str, str, str]:
    n = f"(cast(6378137 as double) / sqrt(cast(1 as double) - cast(6.69437999014e-3 as double) * sin(radians({lat})) * sin(radians({lat}))))"
    return (
        f"(({n} + {alt}) * cos(radians({lat})) * cos(radians({lon})))",
        f"(({n} + {alt}) * cos(radians({lat})) * sin(radians({lon})))",
        f"(({n} * cast({1 - 6.69437999014e-3!r} as double) + {alt}) * sin(radians({lat})))",
    )


def distance_sql(a: str, b: str) -> str:
    return "sqrt(" + " + ".join(f"({a}{k} - {b}{k}) * ({a}{k} - {b}{k})" for k in "xyz") + ")"


def syndromes(bits: int = 88) -> list[int]:
    """The remainder of a frame whose only set bit is the first, second, and so on."""
    out = []
    for position in range(bits):
        r = 1 << (bits - 1 - position + 24)
        for i in range(bits - 1, -1, -1):
            if r >> (i + 24) & 1:
                r ^= 0x1FFF409 << i
        out.append(r)
    return out


def nibble_sql(h: str, i: str) -> str:
    return f"(strpos('0123456789abcdef', substr({h}, cast({i} as integer), 1)) - 1)"


def byte_sql(h: str, i: int) -> str:
    return f"({nibble_sql(h, str(2 * i + 1))} * 16 + {nibble_sql(h, str(2 * i + 2))})"


def residual_sql(h: str) -> str:
    """The checksum of 14 bytes in lower-case hex: remainders of the set bits, xored with the last 24 bits."""
    tail = " + ".join(f"{byte_sql(h, 11 + k)} * {1 << (8 * (2 - k))}" for k in range(3))
    bit = f"CASE WHEN ({nibble_sql(h, '(i // 4) + 1')} >> cast(3 - i % 4 as integer)) & 1 = 1 THEN {syndromes()}[cast(i as integer) + 1] ELSE 0 END"
    return f"xor(cast(list_reduce(list_transform(range(88), lambda i: {bit}), lambda a, b: xor(a, b)) as bigint), cast({tail} as bigint))"


_SX, _SY, _SZ = ecef_sql("lat", "lon", "alt")
_BX, _BY, _BZ = ecef_sql("lat", "lon", "alt_m")

SENSORS_SQL = f"""
sensors AS (SELECT *, {_SX} AS sx, {_SY} AS sy, {_SZ} AS sz FROM (SELECT s_suppkey AS sensor_id,
  cast(49.9 as double) + cast(s_suppkey * 37 % 100 as double) / cast(100 as double) + {_NORTH} AS lat,
  cast(-6.4 as double) + cast(s_suppkey * 61 % 220 as double) / cast(100 as double) + {_EAST} AS lon,
  cast(50 + s_suppkey * 13 % 150 as double) AS alt, region FROM (SELECT s_suppkey, s_suppkey // {PER_REGION} AS region FROM supplier)))"""

TX_SQL = f"""
tx AS (SELECT *, {_BX} AS bx, {_BY} AS by_, {_BZ} AS bz FROM (SELECT event_id, epoch_us(ts) * 1000 AS t_ns,
  lpad(to_hex(4194304 + user_id), 6, '0') AS icao24,
  cast(50.1 as double) + cast(event_id * 7 % 1000 as double) / cast(2000 as double) + {_NORTH} AS lat,
  cast(-5.3 as double) + cast(event_id * 13 % 1000 as double) / cast(500 as double) + {_EAST} AS lon,
  cast(9000 + event_id * 17 % 3000 as double) AS alt_m, value, region
  FROM (SELECT *, user_id % (SELECT greatest(1, (count(*) + {PER_REGION - 1}) // {PER_REGION}) FROM supplier) AS region FROM events)))"""

#: Receptions: what a sensor hears of a transmission, with its time in nanoseconds.
RX_SQL = f"""
rx AS (SELECT event_id, sensor_id, icao24, tx.t_ns + cast(round(sqrt((bx - sx) * (bx - sx) + (by_ - sy) * (by_ - sy) + (bz - sz) * (bz - sz))
    / cast({C_M_PER_NS} as double)) as bigint) + (sensor_id * 37 % 11 - 5) * 20 AS t_ns,
  sx, sy, sz, bx, by_, bz, tx.lat, tx.lon, alt_m FROM tx JOIN sensors USING (region) WHERE (event_id + sensor_id) % 3 <> 0)"""
