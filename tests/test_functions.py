import math

import pytest
from pyspark.sql import functions as F

from skylattice.functions import geo, modes
from skylattice.operators import clock, frames, gdop
from skylattice.sources import frames as sources


def one(spark, **columns):
    return spark.range(1).select(*(c.alias(k) for k, c in columns.items())).first().asDict()


@pytest.mark.parametrize("message", ["8D40621D58C382D690C8AC2863A7", "8D40621D58C386435CC412692AD6", "8D4840D6202CC371C32CE0576098"])
def test_published_messages_have_no_residual(spark, message):
    p = F.unhex(F.lit(message))
    found = one(spark, crc=modes.crc24_residual(p), df=modes.downlink_format(p), icao=modes.correlation_icao(p, F.lit(0)))
    assert found == {"crc": 0, "df": 17, "icao": message[2:8]}


def test_published_altitude_and_position(spark):
    even, odd = (F.unhex(F.lit(m)) for m in ("8D40621D58C382D690C8AC2863A7", "8D40621D58C386435CC412692AD6"))
    e, o = modes.cpr_fields(even), modes.cpr_fields(odd)
    cast = lambda c: c.cast("double")
    lat, lon = modes.cpr_decode(cast(e[1]), cast(e[2]), cast(o[1]), cast(o[2]), F.lit(0))
    found = one(spark, lat=lat, lon=lon, alt=modes.altitude_m(modes.altitude_raw(even)), odd=o[0])
    assert found["lat"] == pytest.approx(52.2572021484375) and found["lon"] == pytest.approx(3.91937255859375)
    assert found["alt"] == pytest.approx(38000 * 0.3048) and found["odd"] == 1
    old = one(spark, alt=modes.altitude_25ft(modes.altitude_raw(even), "reference"))
    assert old["alt"] is None or old["alt"] > 60000


def encode(lat, lon, odd):
    size, zones = 131072, lambda a: max(1, math.floor(2 * math.pi / math.acos(1 - (1 - math.cos(math.pi / 30)) / math.cos(math.radians(abs(a))) ** 2))) if abs(a) < 87 else 1
    dlat = 360 / (59 if odd else 60)
    y = math.floor(size * ((lat % dlat) / dlat) + 0.5)
    r = dlat * (y / size + math.floor(lat / dlat))
    dlon = 360 / max(1, zones(r) - odd)
    return y % size, math.floor(size * ((lon % dlon) / dlon) + 0.5) % size


def test_cpr_round_trip_over_the_globe(spark):
    rows = [(la + 0.123, lo + 0.456, *map(float, (*encode(la + 0.123, lo + 0.456, 0), *encode(la + 0.123, lo + 0.456, 1)))) for la in range(-80, 81, 16) for lo in range(-175, 176, 35)]
    df = spark.createDataFrame(rows, "lat double, lon double, ye double, xe double, yo double, xo double")
    lat, lon = modes.cpr_decode(*(F.col(c) for c in ("ye", "xe", "yo", "xo")), F.lit(1))
    found = df.select("lat", "lon", lat.alias("la"), lon.alias("lo")).collect()
    good = [x for x in found if x["la"] is not None]
    assert len(good) >= 0.9 * len(found)  # a zone's edge between the frames gives none
    assert all(abs(x["la"] - x["lat"]) < 1e-3 and abs(x["lo"] - x["lon"]) < 1e-2 for x in good)


def test_geodesy(spark):
    x, y, z = geo.wgs84_to_ecef(F.lit(51.5074), F.lit(-0.1278), F.lit(15.0))
    found = one(spark, x=x, y=y, z=z)
    assert (found["x"], found["y"], found["z"]) == pytest.approx((3978003.60999509, -8873.07422646, 4968886.67759528), abs=1e-5)


def square(spark):
    rows = [(i, la, lo, 100.0) for i, (la, lo) in enumerate(((51.5, -1.0), (50.5, -1.0), (51.0, -0.5), (51.0, -1.5)))]
    return spark.createDataFrame(rows, "sensor_id long, lat double, lon double, alt double")


def test_gdop_square_and_degenerate(spark):
    box = spark.createDataFrame([(51.0, 51.0, -1.0, -1.0)], "south double, north double, west double, east double")
    found = gdop.coverage(square(spark), 0.1, 10000.0, box).first()
    assert found["gdop"] == pytest.approx(9.195164334, abs=1e-5) and found["condition_number"] == pytest.approx(486.26618, abs=1e-2)
    few = gdop.coverage(square(spark).limit(2), 0.1, 10000.0, box).first()
    assert few["quality"] == "degenerate" and few["gdop"] is None


def test_grid_of_nine_and_default_box(spark):
    box = spark.createDataFrame([(50.0, 51.0, 0.0, 1.0)], "south double, north double, west double, east double")
    cells = [(r["lat"], r["lon"]) for r in gdop.grid(box, 0.5).orderBy("i", "j").collect()]
    assert len(cells) == 9 and cells[0] == (50.0, 0.0) and cells[-1] == (51.0, 1.0)
    assert tuple(gdop.bounds(square(spark).limit(0)).first()) == (45.0, 55.0, -5.0, 5.0)


def test_stats_of_three(spark):
    df = spark.createDataFrame([(1.5,), (3.0,), (None,)], "gdop double").withColumn("quality", gdop.quality(F.col("gdop")))
    s = gdop.coverage_stats(df).first()
    assert (s["excellent"], s["good"], s["degenerate"], s["mean_gdop"], s["median_gdop"]) == (1, 1, 1, 2.25, 3.0)


def test_correlation_of_four(spark):
    base = 1_700_000_000_000_000_000
    rows = [("4840D6", bytes.fromhex("8d4840d6"), base + k * 1_000_000, k) for k in (1, 2, 3, 4)] + [("AAAAAA", b"x", base, 1)]
    got = frames.correlate(spark.createDataFrame(rows, "icao24 string, payload binary, t_ns long, sensor_id long")).collect()
    assert len(got) == 1 and [f["sensor_id"] for f in got[0]["frames"]] == [1, 2, 3, 4]


def test_allan_fixtures(spark):
    rows = [(1, t * 10**9, float((17 * t + 3) % 100 - 50)) for t in range(120)] + [(2, t * 10**9, 0.5 * 5 * t * t) for t in range(120)]
    dev = clock.allan_deviation(spark.createDataFrame(rows, "sensor_id long, timestamp_ns long, offset_ns double"))
    got = {(r["sensor_id"], r["tau_s"]): r["adev"] for r in dev.collect()}
    assert [got[1, t] for t in (1, 5, 10, 30, 60)] == pytest.approx([26.4409, 5.8514, 6.3960, 4.0825, 1.1785], abs=1e-3)
    assert [got[2, t] for t in (1, 5, 10, 30, 60)] == pytest.approx([242.9056, 1204.1919, 2382.2914, 6824.7940, 12621.8560], abs=1e-2)
    kinds = {r["sensor_id"]: r["oscillator_class"] for r in clock.oscillator_class(dev).collect()}
    assert kinds == {1: "gps_locked", 2: "degraded"}


def test_packets_and_lines(spark):
    import struct

    body = struct.pack(">qdddQQ", 7, 50.0, 1.5, 90.0, 86390, 5) + b"\x8d\x01"
    assert sources.split_packets(b"\x00" + bytes([len(body)]) + body + b"\x05ab") == [body]
    df = spark.createDataFrame([("k", body), ("k", b"short")], "public_key string, packet binary").withColumn("ingest_ts", F.timestamp_seconds(F.lit(1_700_006_410)))
    r = sources.decode_packets(df).collect()
    assert len(r) == 1 and (r[0]["sensor_id"], r[0]["raw_modes_hex"]) == (7, "8d01")
    assert abs(r[0]["timestamp_seconds"] - 1_700_006_410) <= 43200 and r[0]["timestamp_seconds"] % 86400 == 86390
    lines = spark.createDataFrame([('{"sensor_id":1,"sensor_lat":1.0,"sensor_lon":2.0,"sensor_alt":3.0,"timestamp_seconds":4,"timestamp_nanoseconds":5,"raw_modes_hex":"8d"}',), ("bad",), ('{"sensor_id":1}',)], "value string")
    assert sources.parse_lines(lines).count() == 1
