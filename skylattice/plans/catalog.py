"""All queries of the engine by name, each with the DuckDB SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skylattice import consts as C
from skylattice.functions import geo, modes
from skylattice import planning
from skylattice.operators import clock, frames, gdop, network, solve, tracks, training
from skylattice.sources import frames as sources
from skylattice.plans import fixtures as X

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def r(c: Column | str, n: int) -> Column:
    """Rounded, without a negative zero."""
    return F.round(F.col(c) if isinstance(c, str) else c, n) + F.lit(0.0)


def _with(*parts: str) -> str:
    return "WITH " + ",".join(parts) + "\n"


def _vec(p: str):
    return tuple(F.col(f"{p}{a}") for a in "xyz")


SENSORS, TX, RX = X.SENSORS_SQL, X.TX_SQL, X.RX_SQL
DIST_RX = "sqrt((bx - sx) * (bx - sx) + (by_ - sy) * (by_ - sy) + (bz - sz) * (bz - sz))"


# Geodesy.


@query(_with(TX) + "SELECT event_id, round(bx, 3) + 0.0 AS x, round(by_, 3) + 0.0 AS y, round(bz, 3) + 0.0 AS z FROM tx")
def wgs84_to_ecef(spark, d):
    x, y, z = geo.wgs84_to_ecef(F.col("lat"), F.col("lon"), F.col("alt_m"))
    return X.transmissions(spark, d).select("event_id", r(x, 3).alias("x"), r(y, 3).alias("y"), r(z, 3).alias("z"))


@query(_with(TX) + "SELECT event_id, round(lat, 6) + 0.0 AS lat, round(lon, 6) + 0.0 AS lon, round(alt_m, 2) + 0.0 AS alt_m FROM tx")
def ecef_to_wgs84(spark, d):
    x, y, z = geo.wgs84_to_ecef(F.col("lat"), F.col("lon"), F.col("alt_m"))
    tx = X.transmissions(spark, d).select("event_id", x.alias("x"), y.alias("y"), z.alias("z"))
    lat, lon, alt = geo.ecef_to_wgs84(*(F.col(a) for a in "xyz"))
    return tx.select("event_id", r(lat, 6).alias("lat"), r(lon, 6).alias("lon"), r(alt, 2).alias("alt_m"))


@query(_with(SENSORS, TX, RX) + f"SELECT event_id, sensor_id, round({DIST_RX}, 3) + 0.0 AS distance_m FROM rx")
def ecef_distance(spark, d):
    return X.frames(spark, d).select("event_id", "sensor_id", r(geo.distance(_vec("b"), _vec("s")), 3).alias("distance_m"))


_ENU = """SELECT event_id, round(-sin(m) * vx + cos(m) * vy, 6) + 0.0 AS east,
  round(-sin(p) * cos(m) * vx - sin(p) * sin(m) * vy + cos(p) * vz, 6) + 0.0 AS north,
  round(cos(p) * cos(m) * vx + cos(p) * sin(m) * vy + sin(p) * vz, 6) + 0.0 AS up,
  round((-sin(p) * cos(m) * vx - sin(p) * sin(m) * vy + cos(p) * vz) / cast(111320 as double), 9) + 0.0 AS lat_rate,
  round((-sin(m) * vx + cos(m) * vy) / (cast(111320 as double) * greatest(abs(cos(p)), cast(1e-9 as double))), 9) + 0.0 AS lon_rate
FROM (SELECT event_id, radians(lat) AS p, radians(lon) AS m, value AS vx, cast(event_id % 200 - 100 as double) AS vy,
  cast(event_id % 50 - 25 as double) AS vz FROM tx)"""


@query(_with(TX) + _ENU)
def enu_velocity(spark, d):
    tx = X.transmissions(spark, d)
    v = (F.col("value"), (F.col("event_id") % 200 - 100).cast("double"), (F.col("event_id") % 50 - 25).cast("double"))
    east, north, up = geo.ecef_to_enu(v, F.col("lat"), F.col("lon"))
    la, lo = geo.degrees_per_second(east, north, F.col("lat"))
    return tx.select("event_id", r(east, 6).alias("east"), r(north, 6).alias("north"), r(up, 6).alias("up"), r(la, 9).alias("lat_rate"), r(lo, 9).alias("lon_rate"))


# Messages. Payloads are 14 bytes of a hash, whose bits are as good as random.

MSG = "msg AS (SELECT event_id, substr(md5(cast(event_id as varchar)), 1, 28) AS h, ts, user_id FROM events)"


def _messages(spark, d):
    e = X.table(spark, d, "events")
    h = F.substring(F.md5(F.col("event_id").cast("string")), 1, 28)
    return e.select("event_id", "user_id", F.unhex(h).alias("payload"), h.alias("h"))


@query(_with(MSG) + f"SELECT event_id, cast({X.residual_sql('h')} as bigint) AS residual FROM msg")
def crc24_residual(spark, d):
    return _messages(spark, d).select("event_id", modes.crc24_residual(F.col("payload")).cast("long").alias("residual"))


_DF = f"({X.byte_sql('h', 0)} >> 3)"


@query(_with(MSG) + f"SELECT event_id, cast({_DF} as bigint) AS df FROM msg")
def df_extract(spark, d):
    return _messages(spark, d).select("event_id", modes.downlink_format(F.col("payload")).cast("long").alias("df"))


@query(
    _with(MSG)
    + f"""SELECT event_id, icao24 FROM (SELECT event_id, CASE WHEN {_DF} IN (11, 17, 18) THEN upper(substr(h, 3, 6))
  WHEN {_DF} IN (4, 5, 20, 21) THEN lpad(upper(to_hex(cast({X.residual_sql('h')} as bigint))), 6, '0') END AS icao24 FROM msg) WHERE icao24 IS NOT NULL"""
)
def correlation_key(spark, d):
    m = _messages(spark, d).withColumn("crc", modes.crc24_residual(F.col("payload")))
    return m.select("event_id", modes.correlation_icao(F.col("payload"), F.col("crc")).alias("icao24")).filter("icao24 is not null")


_TC = f"({X.byte_sql('h', 4)} >> 3)"


@query(
    _with(MSG)
    + f"""SELECT event_id, cast(tc as bigint) AS tc, cast(CASE WHEN tc IN (9, 20) THEN 9 WHEN tc IN (10, 21) THEN 8 WHEN tc IN (11, 22) THEN 7
  WHEN tc BETWEEN 12 AND 17 THEN 18 - tc ELSE 0 END as bigint) AS nuc FROM (SELECT event_id, {_TC} AS tc FROM msg)"""
)
def type_code_nuc(spark, d):
    tc = modes.type_code(F.col("payload"))
    return _messages(spark, d).select("event_id", tc.cast("long").alias("tc"), modes.nuc(tc).cast("long").alias("nuc"))


RAW = f"raws AS (SELECT event_id, {X.byte_sql('h', 5)} * 16 + ({X.byte_sql('h', 6)} >> 4) AS a FROM msg)"


@query(
    _with(MSG, RAW)
    + """SELECT event_id, feet FROM (SELECT event_id, cast(25 * (((a & 4064) >> 1) | (a & 15)) - 1000 as double) AS feet FROM raws WHERE (a >> 4) & 1 = 1)
  WHERE feet BETWEEN -1000 AND 60000"""
)
def altitude_qbit(spark, d):
    feet = modes.altitude_25ft(modes.altitude_raw(F.col("payload")))
    return _messages(spark, d).select("event_id", feet.alias("feet")).filter("feet is not null")


def _gray_sql() -> str:
    bits = dict(zip("C1 A1 C2 A2 C4 A4 B1 Q B2 D2 B4 D4".split(), range(11, -1, -1)))
    names, terms = "D2 D4 A1 A2 A4 B1 B2 B4".split(), []
    for k in range(8):
        parity = " + ".join(f"((a >> {bits[n]}) & 1)" for n in names[: k + 1])
        terms.append(f"(({parity}) % 2) * {1 << (7 - k)}")
    c = [f"((a >> {bits[n]}) & 1)" for n in ("C1", "C2", "C4")]
    hundreds = f"({c[0]} * 4 + (({c[0]} + {c[1]}) % 2) * 2 + (({c[0]} + {c[1]} + {c[2]}) % 2))"
    return f"{' + '.join(terms)} AS v, CASE WHEN {hundreds} = 7 THEN 5 ELSE {hundreds} END AS c"


@query(
    _with(MSG, RAW)
    + f"""SELECT event_id, feet FROM (SELECT event_id, cast(500 * v + 100 * (CASE WHEN v % 2 = 1 THEN 6 - c ELSE c END) - 1300 as double) AS feet
  FROM (SELECT event_id, {_gray_sql()} FROM raws WHERE (a >> 4) & 1 = 0 AND a <> 0) WHERE c BETWEEN 1 AND 5) WHERE feet >= -1200"""
)
def altitude_gillham(spark, d):
    feet = modes.altitude_100ft(modes.altitude_raw(F.col("payload")))
    return _messages(spark, d).select("event_id", feet.alias("feet")).filter("feet is not null")


_B = {i: X.byte_sql("h", i) for i in range(6, 11)}
CPR = f"""cpr AS (SELECT event_id, user_id, ts, cast(({_B[6]} >> 2) & 1 as bigint) AS odd,
  cast(({_B[6]} & 3) * 32768 + {_B[7]} * 128 + ({_B[8]} >> 1) as bigint) AS lat_cpr,
  cast(({_B[8]} & 1) * 65536 + {_B[9]} * 256 + {_B[10]} as bigint) AS lon_cpr FROM msg)"""


@query(_with(MSG, CPR) + "SELECT event_id, odd, lat_cpr, lon_cpr FROM cpr")
def cpr_fields(spark, d):
    odd, lat, lon = modes.cpr_fields(F.col("payload"))
    return _messages(spark, d).select("event_id", odd.cast("long").alias("odd"), lat.cast("long").alias("lat_cpr"), lon.cast("long").alias("lon_cpr"))


_NL = "CASE WHEN abs({0}) >= 87 THEN 1 WHEN {0} = 0 THEN 59 ELSE floor(2 * pi() / acos(1 - (1 - cos(pi() / 30)) / (cos(radians({0})) * cos(radians({0}))))) END"


@query(f"SELECT event_id, cast({_NL.format('lat')} as bigint) AS zones FROM (SELECT event_id, cast(event_id * 977 % 17999 as double) / 100 - 90 AS lat FROM events)")
def nl_zone(spark, d):
    lat = (F.col("event_id") * 977 % 17999).cast("double") / 100 - 90
    return X.table(spark, d, "events").select("event_id", modes.nl(lat).cast("long").alias("zones"))


def _decode_sql(source: str, last: str) -> str:
    """Decoding from columns ye, xe, yo, xo (0 to 1) of source."""
    turn = lambda e, m: f"CASE WHEN {e} >= {m} THEN {e} - 360 ELSE {e} END"
    pm = lambda a, m: f"({a} - {m} * floor({a} / {m}))"
    j = "floor(59 * ye - 60 * yo + cast(0.5 as double))"
    return f"""d1 AS (SELECT *, {turn(f'(6 * ({pm(j, "cast(60 as double)")} + ye))', 270)} AS le, {turn(f'(cast(360 as double) / 59 * ({pm(j, "cast(59 as double)")} + yo))', 270)} AS lo FROM {source}),
d2 AS (SELECT *, {_NL.format('le')} AS ne, {_NL.format('lo')} AS no_ FROM d1 WHERE abs(le) <= 90 AND abs(lo) <= 90),
d3 AS (SELECT *, floor(xe * (ne - 1) - xo * ne + cast(0.5 as double)) AS m, greatest(CASE WHEN {last} = 1 THEN ne - 1 ELSE ne END, 1) AS ni FROM d2 WHERE ne = no_),
d4 AS (SELECT *, cast(360 as double) / ni * ({pm('m', 'ni')} + CASE WHEN {last} = 1 THEN xo ELSE xe END) AS l0, CASE WHEN {last} = 1 THEN lo ELSE le END AS la FROM d3),
decoded AS (SELECT *, CASE WHEN l0 >= 180 THEN l0 - 360 ELSE l0 END AS ln FROM d4)"""


PAIR0 = """pair0 AS (SELECT a.event_id, a.event_id % 2 AS last, cast(a.lat_cpr as double) / 131072 AS ye, cast(a.lon_cpr as double) / 131072 AS xe,
  cast(b.lat_cpr as double) / 131072 AS yo, cast(b.lon_cpr as double) / 131072 AS xo FROM cpr a JOIN cpr b ON b.event_id = a.event_id + 1)"""


@query(_with(MSG, CPR, PAIR0, _decode_sql("pair0", "last")) + "SELECT event_id, round(la, 6) + 0.0 AS lat, round(ln, 6) + 0.0 AS lon FROM decoded")
def cpr_decode(spark, d):
    _, lat, lon = modes.cpr_fields(F.col("payload"))
    c = _messages(spark, d).select("event_id", lat.cast("double").alias("y"), lon.cast("double").alias("x"))
    nxt = c.select((F.col("event_id") - 1).alias("event_id"), F.col("y").alias("y2"), F.col("x").alias("x2"))
    la, lo = modes.cpr_decode(F.col("y"), F.col("x"), F.col("y2"), F.col("x2"), F.col("event_id") % 2)
    return c.join(nxt, "event_id").select("event_id", r(la, 6).alias("lat"), r(lo, 6).alias("lon")).filter("lat is not null")


_LAST = "last_value(CASE WHEN odd = {0} THEN {1} END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY t_ns, odd ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
PAIR1 = f"""pt AS (SELECT event_id, user_id, odd, lat_cpr, lon_cpr, event_id * 3000000000 AS t_ns FROM cpr),
pair1 AS (SELECT event_id, odd AS last, cast({_LAST.format(0, 'lat_cpr')} as double) / 131072 AS ye, cast({_LAST.format(0, 'lon_cpr')} as double) / 131072 AS xe,
  cast({_LAST.format(1, 'lat_cpr')} as double) / 131072 AS yo, cast({_LAST.format(1, 'lon_cpr')} as double) / 131072 AS xo,
  {_LAST.format(0, 't_ns')} AS te, {_LAST.format(1, 't_ns')} AS to_ FROM (SELECT event_id, event_id % 3 AS user_id, odd, lat_cpr, lon_cpr, t_ns FROM pt)),
near AS (SELECT * FROM pair1 WHERE abs(te - to_) <= 10000000000)"""


@query(_with(MSG, CPR, PAIR1, _decode_sql("near", "last")) + "SELECT event_id, round(la, 6) + 0.0 AS lat, round(ln, 6) + 0.0 AS lon FROM decoded")
def cpr_pair_asof(spark, d):
    odd, lat, lon = modes.cpr_fields(F.col("payload"))
    m = _messages(spark, d).select(
        "event_id", (F.col("event_id") % 3).cast("string").alias("icao24"), (F.col("event_id") * 3_000_000_000).alias("t_ns"), odd.alias("odd"), lat.alias("lat_cpr"), lon.alias("lon_cpr")
    )
    return frames.cpr_positions(m).filter("lat is not null").select("event_id", r("lat", 6).alias("lat"), r("lon", 6).alias("lon"))


# Sources, registry and correlation.


@query(
    _with(SENSORS, TX, RX)
    + """SELECT event_id, sensor_id, s.lat + CASE WHEN sensor_id % 3 = 0 THEN 1 ELSE 0 END AS sensor_lat FROM rx JOIN sensors s USING (sensor_id)"""
)
def location_override(spark, d):
    f = X.frames(spark, d).withColumn("public_key", F.col("sensor_id").cast("string"))
    o = X.sensors(spark, d).filter("sensor_id % 3 = 0").select(F.col("sensor_id").cast("string").alias("public_key"), (F.col("lat") + 1).alias("lat"), "lon", "alt")
    return frames.override_locations(f, o).select("event_id", "sensor_id", "sensor_lat")


@query(
    _with(SENSORS, TX, RX)
    + """SELECT sensor_id, s.lat, s.lon, s.alt, n_frames FROM (SELECT sensor_id, count(*) AS n_frames FROM rx GROUP BY 1) JOIN sensors s USING (sensor_id)"""
)
def sensor_registry(spark, d):
    f = frames.finalize(X.frames(spark, d))
    return frames.registry(f).join(f.groupBy("sensor_id").agg(F.count("*").alias("n_frames")), "sensor_id")


@query(
    _with(SENSORS, TX, RX)
    + """SELECT event_id, sensor_id, t_ns FROM (SELECT event_id, sensor_id, t_ns FROM rx UNION ALL SELECT event_id, sensor_id, t_ns + 50 FROM rx)
  QUALIFY row_number() OVER (PARTITION BY event_id, sensor_id ORDER BY t_ns) = 1"""
)
def frame_dedupe(spark, d):
    f = frames.finalize(X.frames(spark, d)).select("event_id", "sensor_id", "payload", "t_ns")
    both = f.unionByName(f.withColumn("t_ns", F.col("t_ns") + 50))
    return both.groupBy("event_id", "sensor_id", "payload").agg(F.min("t_ns").alias("t_ns")).drop("payload")


_GROUPED = """grouped AS (SELECT event_id, count(*) AS n, min(t_ns) AS first_seen_ns, max(t_ns) - min(t_ns) AS spread_ns FROM rx WHERE event_id % 10 <> 99 GROUP BY event_id HAVING count(*) >= 2)"""


@query(_with(SENSORS, TX, RX, _GROUPED) + "SELECT event_id, n AS n_frames, first_seen_ns, spread_ns FROM grouped")
def correlate_groups(spark, d):
    g = _groups(spark, d)
    ends = F.element_at("frames", -1)["t_ns"] - F.col("frames")[0]["t_ns"]
    return g.select("event_id", F.size("frames").cast("long").alias("n_frames"), "first_seen_ns", ends.alias("spread_ns"))


def _keyed(spark, d) -> DataFrame:
    return frames.with_keys(frames.finalize(X.frames(spark, d)))


def _groups(spark, d) -> DataFrame:
    f = _keyed(spark, d)
    ids = f.select("payload", "event_id", "bx", "by", "bz").distinct()
    return frames.correlate(f).join(ids, "payload")


_ANCHORED = """
RECURSIVE rows_ AS (SELECT DISTINCT user_id % 20 AS k, (event_id * 7919 % 100003) * 10000000 AS t, event_id % 6 AS s FROM events),
a AS (SELECT k, min(t) AS anchor FROM rows_ GROUP BY k
  UNION ALL SELECT a.k, min(rows_.t) FROM a JOIN rows_ ON rows_.k = a.k AND rows_.t > a.anchor + 200000000 GROUP BY a.k, a.anchor)
SELECT a.k AS key, a.anchor AS first_seen_ns, count(DISTINCT s) AS n_sensors FROM a JOIN rows_ r ON r.k = a.k AND r.t BETWEEN a.anchor AND a.anchor + 200000000
GROUP BY 1, 2 HAVING count(DISTINCT s) >= 2"""


@query("WITH " + _ANCHORED)
def correlate_anchored(spark, d):
    e = X.table(spark, d, "events")
    rows = e.select((F.col("user_id") % 20).cast("string").alias("icao24"), F.unhex(F.lit("00")).alias("payload"), (F.col("event_id") * 7919 % 100003 * 10_000_000).alias("t_ns"), (F.col("event_id") % 6).alias("sensor_id"))
    g = frames.correlate(rows)
    return g.select(F.col("icao24").cast("long").alias("key"), "first_seen_ns", F.size("frames").cast("long").alias("n_sensors"))


PAIRS = f"""rxn AS (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY t_ns, sensor_id) AS pos FROM rx),
pairs AS (SELECT a.event_id, a.sensor_id AS sensor_i, b.sensor_id AS sensor_j, a.t_ns AS t_i, b.t_ns AS t_j, a.bx, a.by_, a.bz,
  a.sx AS ix, a.sy AS iy, a.sz AS iz, b.sx AS jx, b.sy AS jy, b.sz AS jz
  FROM rxn a JOIN rxn b ON a.event_id = b.event_id AND a.pos < b.pos)"""


def _pairs(spark, d) -> DataFrame:
    s = gdop.with_ecef(X.sensors(spark, d)).select("sensor_id", "x", "y", "z")
    out = frames.sensor_pairs(_groups(spark, d))
    for k in "ij":
        side = s.select(F.col("sensor_id").alias(f"sensor_{k}"), *(F.col(a).alias(f"{k}{a}") for a in "xyz"))
        out = out.join(side, f"sensor_{k}")
    return out


@query(_with(SENSORS, TX, RX, PAIRS) + "SELECT event_id, sensor_i, sensor_j, t_j - t_i AS dt_ns FROM pairs")
def sensor_pairs(spark, d):
    return _pairs(spark, d).select("event_id", "sensor_i", "sensor_j", (F.col("t_j") - F.col("t_i")).alias("dt_ns"))


_BASE = "sqrt((ix - jx) * (ix - jx) + (iy - jy) * (iy - jy) + (iz - jz) * (iz - jz))"
_DI = "sqrt((bx - ix) * (bx - ix) + (by_ - iy) * (by_ - iy) + (bz - iz) * (bz - iz))"
_DJ = "sqrt((bx - jx) * (bx - jx) + (by_ - jy) * (by_ - jy) + (bz - jz) * (bz - jz))"
OBS = f"""obs0 AS (SELECT event_id, sensor_i, sensor_j, least(t_i, t_j) AS timestamp_ns, {_BASE} AS baseline_m, 5 + event_id % 5 AS nuc,
  cast(t_i - t_j as double) - ({_DI} - {_DJ}) / cast({C.C_M_PER_NS} as double) AS r0 FROM pairs),
obs AS (SELECT event_id, least(sensor_i, sensor_j) AS sensor_i, greatest(sensor_i, sensor_j) AS sensor_j, timestamp_ns, baseline_m,
  CASE WHEN sensor_i > sensor_j THEN -r0 ELSE r0 END AS residual_ns,
  CASE nuc WHEN 5 THEN cast(0.5 as double) WHEN 6 THEN 1 WHEN 7 THEN 2 ELSE 4 END * least(baseline_m / 100000, 2) AS weight FROM obs0)"""


def _obs(spark, d) -> DataFrame:
    p = _pairs(spark, d).withColumn("nuc", 5 + F.col("event_id") % 5).withColumn("timestamp_ns", F.least("t_i", "t_j"))
    return clock.oriented(clock.beacon_residuals(p))


@query(_with(SENSORS, TX, RX, PAIRS, OBS) + "SELECT event_id, sensor_i, sensor_j, round(residual_ns, 1) + 0.0 AS residual_ns, round(weight, 6) + 0.0 AS weight FROM obs")
def beacon_residuals(spark, d):
    return _obs(spark, d).select("event_id", "sensor_i", "sensor_j", r("residual_ns", 1).alias("residual_ns"), r("weight", 6).alias("weight"))


EDGES = """fit AS (SELECT sensor_i, sensor_j, sum(residual_ns * weight) / sum(weight) AS mean_residual_ns, sum(weight) AS total_weight, count(*) AS obs_count,
  coalesce(regr_slope(residual_ns, t_s), 0) AS k, coalesce(regr_intercept(residual_ns, t_s), avg(residual_ns)) AS c
  FROM (SELECT *, cast(timestamp_ns - min(timestamp_ns) OVER (PARTITION BY sensor_i, sensor_j) as double) / 1e9 AS t_s FROM obs) GROUP BY 1, 2),
edges AS (SELECT f.sensor_i, f.sensor_j, any_value(mean_residual_ns) AS mean_residual_ns, any_value(total_weight) AS total_weight, any_value(obs_count) AS obs_count,
  list_sort(list(abs(residual_ns - c - k * t_s)))[count(*) // 2 + 1] AS mad_ns
  FROM (SELECT *, cast(timestamp_ns - min(timestamp_ns) OVER (PARTITION BY sensor_i, sensor_j) as double) / 1e9 AS t_s FROM obs) o JOIN fit f
  ON o.sensor_i = f.sensor_i AND o.sensor_j = f.sensor_j GROUP BY 1, 2)"""
_E = _with(SENSORS, TX, RX, PAIRS, OBS, EDGES)


@query(_E + "SELECT sensor_i, sensor_j, round(mean_residual_ns, 2) + 0.0 AS mean_residual_ns, round(total_weight, 4) + 0.0 AS total_weight, obs_count FROM edges")
def edge_stats(spark, d):
    return clock.edges(_obs(spark, d)).select("sensor_i", "sensor_j", r("mean_residual_ns", 2).alias("mean_residual_ns"), r("total_weight", 4).alias("total_weight"), "obs_count")


@query(_E + "SELECT sensor_i, sensor_j, round(mad_ns, 2) + 0.0 AS mad_ns, round(power(greatest(mad_ns, 50) / cast(0.6745 as double), 2), 1) + 0.0 AS variance_ns2 FROM edges")
def edge_mad(spark, d):
    return clock.pair_variance(clock.edges(_obs(spark, d))).select("sensor_i", "sensor_j", r("mad_ns", 2).alias("mad_ns"), r("variance_ns2", 1).alias("variance_ns2"))


@query(
    _with(SENSORS, TX, RX, PAIRS, OBS)
    + """SELECT sensor_i, sensor_j, count(*) AS sample_count, round(coalesce(regr_intercept(residual_ns, t_s), avg(residual_ns)), 1) + 0.0 AS offset_ns, count(*) >= 25 AS is_converged
  FROM (SELECT *, cast(timestamp_ns - max(timestamp_ns) OVER (PARTITION BY sensor_i, sensor_j) as double) / 1e9 AS t_s FROM obs
    QUALIFY row_number() OVER (PARTITION BY sensor_i, sensor_j ORDER BY timestamp_ns DESC, residual_ns) <= 50) GROUP BY 1, 2"""
)
def pair_ols(spark, d):
    return clock.pair_fit(_obs(spark, d)).select("sensor_i", "sensor_j", "sample_count", r("offset_ns", 1).alias("offset_ns"), "is_converged")


@query(
    _E
    + """SELECT n AS num_sensors, m AS num_edges, round(m / (n * (n - 1) / cast(2 as double)), 6) + 0.0 AS connectivity FROM
  (SELECT count(DISTINCT s) AS n FROM (SELECT sensor_i AS s FROM edges UNION ALL SELECT sensor_j FROM edges)), (SELECT count(*) AS m FROM edges)"""
)
def topology(spark, d):
    return clock.topology(clock.edges(_obs(spark, d))).select("num_sensors", "num_edges", r("connectivity", 6).alias("connectivity"))


@query(_E + "SELECT s AS sensor_id, count(*) AS degree FROM (SELECT sensor_i AS s FROM edges UNION ALL SELECT sensor_j FROM edges) GROUP BY 1")
def sensor_degree(spark, d):
    return clock.degrees(clock.edges(_obs(spark, d)))


@query(
    """SELECT event_id, CASE WHEN k > 1e8 THEN 'poor' WHEN rms < 50 AND c > 0.7 THEN 'excellent' WHEN rms < 100 AND c > 0.5 THEN 'good'
  WHEN rms < 300 AND c > 0.3 THEN 'marginal' ELSE 'poor' END AS health
  FROM (SELECT event_id, value AS rms, cast(event_id % 100 as double) / 100 AS c, cast(event_id % 11 as double) * 2e7 AS k FROM events)"""
)
def topology_health(spark, d):
    h = clock.topology_health(F.col("value"), (F.col("event_id") % 100).cast("double") / 100, (F.col("event_id") % 11).cast("double") * 2e7)
    return X.table(spark, d, "events").select("event_id", h.alias("health"))


# The chain behind the edges.


@query(
    _with(SENSORS, TX, RX)
    + "SELECT event_id, count(*) AS n_frames FROM rx WHERE 5 + event_id % 5 >= 6 GROUP BY 1 HAVING count(*) >= 2"
)
def beacon_eligibility(spark, d):
    g = _groups(spark, d).withColumn("nuc", 5 + F.col("event_id") % 5)
    return network.eligible_beacons(g).select("event_id", F.size("frames").cast("long").alias("n_frames"))


@query(
    _E
    + """SELECT e.sensor_i, e.sensor_j, round(sqrt((a.sx - b.sx) * (a.sx - b.sx) + (a.sy - b.sy) * (a.sy - b.sy) + (a.sz - b.sz) * (a.sz - b.sz)), 3) + 0.0 AS baseline_m
  FROM edges e JOIN sensors a ON a.sensor_id = e.sensor_i JOIN sensors b ON b.sensor_id = e.sensor_j"""
)
def edge_baseline(spark, d):
    e = network.with_baselines(clock.edges(_obs(spark, d)), _placed(spark, d))
    return e.select("sensor_i", "sensor_j", r("baseline_m", 3).alias("baseline_m"))


#: Offsets as if solved; every seventh sensor has none.
_OFFSETS = "solved AS (SELECT sensor_id, cast(sensor_id % 13 as double) * 25 AS offset_ns, 40 + cast(sensor_id % 5 as double) AS uncertainty_ns FROM sensors WHERE sensor_id % 7 <> 3)"
_LEFT = f"""{_OFFSETS}, leftover AS (SELECT e.sensor_i, e.sensor_j, e.sensor_i // {X.PER_REGION} AS region, mean_residual_ns - (coalesce(a.offset_ns, 0) - coalesce(b.offset_ns, 0)) AS residual_ns
  FROM edges e LEFT JOIN solved a ON a.sensor_id = e.sensor_i LEFT JOIN solved b ON b.sensor_id = e.sensor_j)"""


def _solved(spark, d) -> DataFrame:
    s = X.sensors(spark, d).filter("sensor_id % 7 <> 3")
    return s.select("sensor_id", ((F.col("sensor_id") % 13).cast("double") * 25).alias("offset_ns"), (40 + (F.col("sensor_id") % 5).cast("double")).alias("uncertainty_ns"))


@query(_E.rstrip() + "," + _LEFT + " SELECT sensor_i, sensor_j, round(residual_ns, 2) + 0.0 AS residual_ns FROM leftover")
def edge_residuals(spark, d):
    e = network.edge_residuals(clock.edges(_obs(spark, d)), _solved(spark, d))
    return e.select("sensor_i", "sensor_j", r("residual_ns", 2).alias("residual_ns"))


@query(_E.rstrip() + "," + _LEFT + " SELECT region, round(sqrt(avg(residual_ns * residual_ns)), 2) + 0.0 AS global_rms_ns FROM leftover GROUP BY 1")
def global_rms(spark, d):
    e = network.edge_residuals(clock.edges(_obs(spark, d)), _solved(spark, d)).withColumn("region", F.floor(F.col("sensor_i") / X.PER_REGION).cast("long"))
    return network.global_rms(e, ["region"]).select("region", r("global_rms_ns", 2).alias("global_rms_ns"))


@query(_with(SENSORS, TX, RX, PAIRS, _OFFSETS) + """SELECT event_id, sensor_i, sensor_j, round(power(coalesce(a.uncertainty_ns, 300), 2) + power(coalesce(b.uncertainty_ns, 300), 2), 2) + 0.0 AS pair_variance_ns2
  FROM pairs LEFT JOIN solved a ON a.sensor_id = sensor_i LEFT JOIN solved b ON b.sensor_id = sensor_j""")
def pair_variance_solved(spark, d):
    p = network.pair_variances(_pairs(spark, d), None, _solved(spark, d))
    return p.select("event_id", "sensor_i", "sensor_j", r("pair_variance_ns2", 2).alias("pair_variance_ns2"))


#: The last 50 samples of each pair as a line through seconds before the last one.
_LINES = """lastones AS (SELECT sensor_i, sensor_j, residual_ns AS e, max(timestamp_ns) OVER (PARTITION BY sensor_i, sensor_j) AS last_ns, cast(timestamp_ns - max(timestamp_ns) OVER (PARTITION BY sensor_i, sensor_j) as double) / 1e9 AS t
  FROM obs QUALIFY row_number() OVER (PARTITION BY sensor_i, sensor_j ORDER BY timestamp_ns DESC, residual_ns) <= 50),
line AS (SELECT sensor_i, sensor_j, last_ns, count(*) AS n, coalesce(regr_slope(e, t), 0) AS k, coalesce(regr_intercept(e, t), avg(e)) AS c FROM lastones GROUP BY 1, 2, 3),
spread AS (SELECT l.sensor_i, l.sensor_j, list_sort(list(abs(e - c - k * t)))[count(*) // 2 + 1] AS mad_ns FROM lastones o JOIN line l ON l.sensor_i = o.sensor_i AND l.sensor_j = o.sensor_j GROUP BY 1, 2)"""


@query(
    _with(SENSORS, TX, RX, PAIRS, OBS, _LINES)
    + """SELECT p.event_id, p.sensor_i, p.sensor_j, round(coalesce(CASE WHEN n >= 2 THEN power(greatest(mad_ns, 50) / cast(0.6745 as double), 2) END, 90000), 1) + 0.0 AS pair_variance_ns2 FROM pairs p
  LEFT JOIN line l ON l.sensor_i = least(p.sensor_i, p.sensor_j) AND l.sensor_j = greatest(p.sensor_i, p.sensor_j) LEFT JOIN spread s ON s.sensor_i = l.sensor_i AND s.sensor_j = l.sensor_j"""
)
def pair_variance_fallback(spark, d):
    p = network.pair_variances(_pairs(spark, d), network.pair_states(_obs(spark, d)))
    return p.select("event_id", "sensor_i", "sensor_j", r("pair_variance_ns2", 1).alias("pair_variance_ns2"))


@query(
    _with(SENSORS, TX, RX, PAIRS, OBS, _LINES)
    + """SELECT p.event_id, p.sensor_i, p.sensor_j, round(coalesce(CASE WHEN n >= 2 AND greatest(0, t_i - last_ns) < 30000000000 THEN
    CASE WHEN p.sensor_i > p.sensor_j THEN -1 ELSE 1 END * (c + k * cast(t_i - last_ns as double) / 1e9) END, 0), 1) + 0.0 AS pair_offset_ns FROM pairs p
  LEFT JOIN line l ON l.sensor_i = least(p.sensor_i, p.sensor_j) AND l.sensor_j = greatest(p.sensor_i, p.sensor_j)"""
)
def pair_fallback_offset(spark, d):
    p = _pairs(spark, d).select("event_id", F.col("sensor_i").alias("sensor_id"), F.col("sensor_j").alias("ref_sensor"), F.col("t_i").alias("at_ns"))
    out = network.pair_offsets(p, network.pair_states(_obs(spark, d)))
    return out.select("event_id", F.col("sensor_id").alias("sensor_i"), F.col("ref_sensor").alias("sensor_j"), r("pair_offset_ns", 1).alias("pair_offset_ns"))


@query()
def pair_gate(spark, d):
    return network.gated(_obs(spark, d))


@query()
def network_solve(spark, d):
    o = _obs(spark, d).withColumn("network", F.floor(F.col("sensor_i") / X.PER_REGION).cast("long"))
    return network.network_solve(o, _placed(spark, d))["topology"]


@query("SELECT event_id, CASE event_id % 10 WHEN 9 THEN 50.0 WHEN 8 THEN 100.0 WHEN 7 THEN 300.0 WHEN 6 THEN 500.0 WHEN 5 THEN 800.0 END::DOUBLE AS sigma_m FROM events")
def nuc_prior_sigma(spark, d):
    return X.table(spark, d, "events").select("event_id", network.prior_sigma(F.col("event_id") % 10).alias("sigma_m"))


@query(
    _with(TX)
    + """SELECT event_id, round(CASE WHEN event_id % 3 = 0 THEN bx + 50 WHEN event_id % 10 >= 5 THEN bx END, 3) + 0.0 AS prior_x,
  CASE WHEN event_id % 3 = 0 THEN cast(90000 as double) ELSE CASE event_id % 10 WHEN 9 THEN 2500.0 WHEN 8 THEN 10000.0 WHEN 7 THEN 90000.0 WHEN 6 THEN 250000.0 WHEN 5 THEN 640000.0 END::DOUBLE END AS variance_m2 FROM tx"""
)
def cold_start_prior(spark, d):
    x, y, z = geo.wgs84_to_ecef(F.col("lat"), F.col("lon"), F.col("alt_m"))
    t = _track(spark, d).withColumns({"claim_x": x, "claim_y": y, "claim_z": z, "nuc": F.col("event_id") % 10})
    known = F.col("event_id") % 3 == 0
    cov = F.array(*(F.lit(90_000.0 if i % 4 == 0 else 0.0) for i in range(9)))
    t = t.withColumn("track_prior", F.when(known, F.array(F.col("claim_x") + 50.0, F.col("claim_y"), F.col("claim_z")))).withColumn("track_cov", F.when(known, cov))
    return network.priors(t).select("event_id", r(F.get("prior", F.lit(0)), 3).alias("prior_x"), F.get("prior_cov", F.lit(4)).alias("variance_m2"))


# Clock series: 500 offsets, one a second, for each sensor; all events, so the sensors grow with them.

SERIES = """series AS (SELECT event_id // 500 AS sensor_id, (event_id % 500) * 1000000000 AS timestamp_ns, value * cast(1.4142135 as double) + cast(event_id % 40 as double) * (event_id // 500 % 8) AS offset_ns FROM events)"""


def _series(spark, d) -> DataFrame:
    e = X.table(spark, d, "events")
    sensor = F.floor(F.col("event_id") / 500).cast("long")
    offset = F.col("value") * F.lit(1.4142135) + (F.col("event_id") % 40).cast("double") * (sensor % 8)
    return e.select(sensor.alias("sensor_id"), (F.col("event_id") % 500 * 1_000_000_000).alias("timestamp_ns"), offset.alias("offset_ns"))


@query(
    _with(SERIES)
    + """SELECT sensor_id, timestamp_ns, round(CASE WHEN n < 2 THEN 0 ELSE k END, 4) + 0.0 AS drift_ns_per_s FROM (SELECT sensor_id, timestamp_ns, count(*) OVER w AS n,
  regr_slope(offset_ns, cast(timestamp_ns as double) / 1e9) OVER w AS k FROM series WINDOW w AS (PARTITION BY sensor_id ORDER BY timestamp_ns
  RANGE BETWEEN 60000000000 PRECEDING AND CURRENT ROW))"""
)
def drift_rate(spark, d):
    return clock.drift(_series(spark, d)).select("sensor_id", "timestamp_ns", r("drift_ns_per_s", 4).alias("drift_ns_per_s"))


ALLAN = """taus AS (SELECT unnest([1, 5, 10, 30, 60]) AS tau), num AS (SELECT *, cast(timestamp_ns as double) / 1e9 AS t, row_number() OVER (PARTITION BY sensor_id ORDER BY timestamp_ns) - 1 AS pos FROM series),
win AS (SELECT n.sensor_id, tau, n.t AS f, avg(m.offset_ns) AS mean FROM num n, taus, num m WHERE n.pos % tau = 0 AND m.sensor_id = n.sensor_id AND m.t >= n.t AND m.t < n.t + tau GROUP BY 1, 2, 3),
dif AS (SELECT *, mean - lag(mean) OVER (PARTITION BY sensor_id, tau ORDER BY f) AS s FROM win),
allan AS (SELECT sensor_id, cast(tau as double) AS tau_s, sqrt(sum(s * s) / (2 * (count(*) - 1))) AS adev FROM dif GROUP BY 1, 2 HAVING count(*) >= 2)"""


@query(_with(SERIES, ALLAN) + "SELECT sensor_id, tau_s, round(adev, 4) + 0.0 AS adev FROM allan")
def allan_deviation(spark, d):
    return clock.allan_deviation(_series(spark, d)).filter("adev is not null").select("sensor_id", "tau_s", r("adev", 4).alias("adev"))


@query(
    _with(SERIES, ALLAN)
    + """SELECT sensor_id, round(k, 5) + 0.0 AS ratio, CASE WHEN k < 0.7 THEN 'gps_locked' WHEN k < 1.5 THEN 'crystal' ELSE 'degraded' END AS oscillator_class
  FROM (SELECT sensor_id, arg_max(adev, tau_s) / arg_min(adev, tau_s) AS k FROM allan GROUP BY 1 HAVING count(*) >= 3)"""
)
def oscillator_class(spark, d):
    return clock.oscillator_class(clock.allan_deviation(_series(spark, d))).filter("ratio is not null").select("sensor_id", r("ratio", 5).alias("ratio"), "oscillator_class")


@query(
    _with(SERIES)
    + """, q AS (SELECT event_id, event_id // 500 AS sensor_id, event_id // 2000 * 4 AS ref_sensor, (event_id * 37 % 500) * 1000000000 + 500000000 AS ref_t FROM events),
  s AS (SELECT q.event_id, q.sensor_id, ref_sensor, q.ref_t, o.offset_ns + least((q.ref_t - o.timestamp_ns) / 1e9, 120) * 0.5 AS own FROM q ASOF JOIN series o ON o.sensor_id = q.sensor_id AND o.timestamp_ns < q.ref_t),
  z AS (SELECT q.event_id, o.offset_ns + least((q.ref_t - o.timestamp_ns) / 1e9, 120) * 0.5 AS ref FROM q ASOF JOIN series o ON o.sensor_id = q.ref_sensor AND o.timestamp_ns < q.ref_t)
  SELECT s.event_id, CASE WHEN s.sensor_id = s.ref_sensor THEN ref_t + 1000 ELSE greatest(0, ref_t + 1000 - cast(round(own - ref) as bigint)) END AS t_corrected FROM s JOIN z USING (event_id)"""
)
def clock_correction_asof(spark, d):
    sensor, ref = (F.floor(F.col("event_id") / n).cast("long") for n in (500, 2000))
    q = X.table(spark, d, "events").select("event_id", sensor.alias("sensor_id"), (ref * 4).alias("ref_sensor"), (F.col("event_id") * 37 % 500 * 1_000_000_000 + 500_000_000).alias("ref_t_ns"))
    q = q.withColumn("t_ns", F.col("ref_t_ns") + 1000)
    sol = _series(spark, d).select(F.col("timestamp_ns").alias("solve_ns"), "sensor_id", "offset_ns", F.lit(0.5).alias("drift_ns_per_s"))
    return clock.corrected_times(q, sol).filter("own is not null and ref is not null").select("event_id", "t_corrected")


# Multilateration inputs.


@query(
    _with(SENSORS, TX, RX, PAIRS)
    + f"SELECT event_id, bool_and(abs(t_i - t_j) <= cast(1.05 as double) * {_BASE} / cast({C.C_M_PER_NS} as double) + 1000) AS feasible FROM pairs GROUP BY 1"
)
def tdoa_feasibility(spark, d):
    return tracks.feasible(_pairs(spark, d), ["event_id"])


@query(
    _with(SENSORS, TX, RX)
    + f"""SELECT event_id, sensor_id, ref_sensor, round((t_ns - t0) * cast({C.C_M_PER_NS} as double), 3) + 0.0 AS tdoa_m FROM (SELECT *, first_value(sensor_id) OVER w AS ref_sensor,
  first_value(t_ns) OVER w AS t0, row_number() OVER w AS n, count(*) OVER (PARTITION BY event_id) AS c FROM rx WINDOW w AS (PARTITION BY event_id ORDER BY t_ns, sensor_id)) WHERE n > 1 AND c >= 2"""
)
def tdoa_vectors(spark, d):
    return tracks.tdoa(_groups(spark, d)).select("event_id", "sensor_id", "ref_sensor", r("tdoa_m", 3).alias("tdoa_m"))


@query(
    """SELECT event_id, round(CASE WHEN e <= 926 THEN 1 / e END, 8) + 0.0 AS weight FROM (SELECT event_id, cast(76.2 as double) + cast(21.3 as double) * (event_id % 60) AS e FROM events)"""
)
def altitude_weight(spark, d):
    return X.table(spark, d, "events").select("event_id", r(tracks.altitude_weight((F.col("event_id") % 60).cast("double")), 8).alias("weight"))


# Coverage.

BOX = """box AS (SELECT greatest(min(lat) - cast(2.7 as double), -85) AS south, least(max(lat) + cast(2.7 as double), 85) AS north,
  greatest(min(lon) - cast(3.5 as double), -180) AS west, least(max(lon) + cast(3.5 as double), 180) AS east FROM sensors)"""


def _grid_sql(step: str, alt: str, sensors: str = "sensors") -> str:
    px, py, pz = X.ecef_sql("lat", "lon", f"cast({alt} as double)")
    return f"""cells0 AS (SELECT i, j, south + i * cast({step} as double) AS lat, west + j * cast({step} as double) AS lon FROM
  (SELECT *, unnest(range(0, cast(floor((north - south) / cast({step} as double) + 1e-9) as bigint) + 1)) AS i FROM box) a,
  LATERAL (SELECT unnest(range(0, cast(floor((a.east - a.west) / cast({step} as double) + 1e-9) as bigint) + 1)) AS j)),
cells AS (SELECT *, {px} AS x, {py} AS y, {pz} AS z FROM cells0),
rf AS (SELECT sx AS rx_, sy AS ry_, sz AS rz_ FROM {sensors} ORDER BY sensor_id LIMIT 1),
dirs AS (SELECT cells.i, cells.j, cells.lat, cells.lon, sx - x AS ax, sy - y AS ay, sz - z AS az, rx_ - x AS cx, ry_ - y AS cy, rz_ - z AS cz FROM cells, {sensors}, rf),
unit AS (SELECT i, j, lat, lon, ax / d - cx / e AS hx, ay / d - cy / e AS hy, az / d - cz / e AS hz FROM (SELECT *, sqrt(ax * ax + ay * ay + az * az) AS d, sqrt(cx * cx + cy * cy + cz * cz) AS e FROM dirs)),
mats AS (SELECT i, j, lat, lon, count(*) AS n, sum(hx * hx) AS a, sum(hx * hy) AS b, sum(hx * hz) AS c, sum(hy * hy) AS d, sum(hy * hz) AS e, sum(hz * hz) AS f FROM unit GROUP BY 1, 2, 3, 4),
eig AS (SELECT *, (a + d + f) / 3 AS q, sqrt(((a - (a + d + f) / 3) * (a - (a + d + f) / 3) + (d - (a + d + f) / 3) * (d - (a + d + f) / 3)
  + (f - (a + d + f) / 3) * (f - (a + d + f) / 3) + 2 * (b * b + c * c + e * e)) / 6) AS p FROM mats),
ang AS (SELECT *, acos(greatest(-1, least(1, ((a - q) / p * ((d - q) / p * (f - q) / p - e / p * e / p) - b / p * (b / p * (f - q) / p - c / p * e / p) + c / p * (b / p * e / p - c / p * (d - q) / p)) / 2))) / 3 AS phi FROM eig),
points0 AS (SELECT *, q + 2 * p * cos(phi) AS top, q + 2 * p * cos(phi + 2 * pi() / 3) AS low FROM ang),
points AS (SELECT *, CASE WHEN low >= 1e-6 AND top / low <= 1e8 THEN sqrt(((d * f - e * e) + (a * f - c * c) + (a * d - b * b)) / (a * (d * f - e * e) - b * (b * f - c * e) + c * (b * e - c * d))) END AS gdop FROM points0),
graded AS (SELECT *, CASE WHEN gdop IS NULL THEN 'degenerate' WHEN gdop < 2 THEN 'excellent' WHEN gdop < 5 THEN 'good' WHEN gdop < 10 THEN 'moderate' WHEN gdop < 20 THEN 'poor' ELSE 'unacceptable' END AS quality FROM points)"""


_G = _with(SENSORS, BOX, _grid_sql("0.1", "9144"))


@query(_G + "SELECT i, j, round(lat, 6) + 0.0 AS lat, round(lon, 6) + 0.0 AS lon, round(gdop, 2) + 0.0 AS gdop FROM graded")
def gdop_grid(spark, d):
    return gdop.coverage(X.sensors(spark, d)).select("i", "j", r("lat", 6).alias("lat"), r("lon", 6).alias("lon"), r("gdop", 2).alias("gdop"))


@query(_G + "SELECT quality, count(*) AS n FROM graded GROUP BY 1")
def gdop_quality(spark, d):
    return gdop.coverage(X.sensors(spark, d)).groupBy("quality").agg(F.count("*").alias("n"))


_STATS = """SELECT count(*) AS total_points, count(*) FILTER (quality = 'excellent') AS excellent, count(*) FILTER (quality = 'good') AS good, count(*) FILTER (quality = 'moderate') AS moderate,
  count(*) FILTER (quality = 'poor') AS poor, count(*) FILTER (quality = 'unacceptable') AS unacceptable, count(*) FILTER (quality = 'degenerate') AS degenerate, round(avg(gdop), 2) + 0.0 AS mean_gdop,
  round(list_sort(list(gdop) FILTER (gdop IS NOT NULL))[count(gdop) // 2 + 1], 2) + 0.0 AS median_gdop FROM graded"""


@query(_G + _STATS)
def coverage_stats(spark, d):
    s = gdop.coverage_stats(gdop.coverage(X.sensors(spark, d)))
    return s.withColumn("mean_gdop", r("mean_gdop", 2)).withColumn("median_gdop", r("median_gdop", 2))


@query(_with(SENSORS, BOX) + "SELECT round(south, 6) + 0.0 AS south, round(north, 6) + 0.0 AS north, round(west, 6) + 0.0 AS west, round(east, 6) + 0.0 AS east FROM box")
def auto_bounds(spark, d):
    return gdop.bounds(X.sensors(spark, d)).select(*(r(c, 6).alias(c) for c in ("south", "north", "west", "east")))


# Tracks.


def _track(spark, d) -> DataFrame:
    return X.transmissions(spark, d)


@query(
    _with(TX)
    + """, c AS (SELECT *, lag(bx) OVER w AS px, lag(by_) OVER w AS py, lag(bz) OVER w AS pz FROM tx WINDOW w AS (PARTITION BY icao24 ORDER BY t_ns))
SELECT event_id, round(v, 2) + 0.0 AS divergence_m, v > 2000 AS spoofed FROM (SELECT event_id, coalesce(sqrt((bx - px) * (bx - px) + (by_ - py) * (by_ - py) + (bz - pz) * (bz - pz)), 0) AS v FROM c)"""
)
def spoof_asof(spark, d):
    t = _track(spark, d).withColumn("accuracy_m", F.lit(500.0)).withColumn("claim", F.struct("lat", "lon", "alt_m"))
    return tracks.spoof_check(t).select("event_id", r("divergence_m", 2).alias("divergence_m"), "spoofed")


@query(
    _with(TX)
    + """SELECT event_id, count(*) OVER w AS n_states, round(sum(value) OVER w, 4) + 0.0 AS sum_value, first_value(event_id) OVER w AS first_event FROM tx
  WINDOW w AS (PARTITION BY icao24 ORDER BY t_ns ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)"""
)
def history_window(spark, d):
    t = tracks.history(_track(spark, d), ["event_id", "value"])
    total = F.aggregate("states", F.lit(0.0), lambda a, s: a + s["value"])
    return t.select("event_id", F.size("states").cast("long").alias("n_states"), r(total, 4).alias("sum_value"), F.col("states")[0]["event_id"].alias("first_event"))


@query(
    _with(TX)
    + """SELECT event_id, round(coalesce((t_ns - max(CASE WHEN event_id % 4 = 0 THEN t_ns END) OVER (PARTITION BY icao24 ORDER BY t_ns ROWS UNBOUNDED PRECEDING)) / 1e9, 999), 3) + 0.0 AS alt_age_s FROM tx"""
)
def altitude_age(spark, d):
    t = _track(spark, d).withColumn("alt_m", F.when(F.col("event_id") % 4 == 0, F.col("alt_m")))
    return tracks.altitude_age(t).select("event_id", r("alt_age_s", 3).alias("alt_age_s"))


@query(
    _with(TX)
    + """SELECT event_id, coalesce(last_value(CASE WHEN a BETWEEN -500 AND 15000 THEN a END IGNORE NULLS) OVER (PARTITION BY icao24 ORDER BY t_ns ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
    CASE WHEN a BETWEEN -500 AND 15000 THEN a END, 5000) AS used_alt_m
  FROM (SELECT *, alt_m + CASE WHEN event_id % 3 = 0 THEN 9000 ELSE 0 END AS a FROM tx)"""
)
def last_valid_altitude(spark, d):
    t = _track(spark, d).withColumn("alt_m", F.col("alt_m") + F.when(F.col("event_id") % 3 == 0, 9000.0).otherwise(0.0))
    return tracks.last_valid_altitude(t).select("event_id", "used_alt_m")


@query(
    """WITH RECURSIVE r_ AS (SELECT DISTINCT user_id % 10 AS k, (event_id * 7919 % 100003) * 100000000 AS t FROM events),
a AS (SELECT k, min(t) AS t FROM r_ GROUP BY k UNION ALL SELECT a.k, min(r_.t) FROM a JOIN r_ ON r_.k = a.k AND r_.t >= a.t + 1000000000 GROUP BY a.k, a.t)
SELECT k AS key, t AS t_ns FROM a"""
)
def rate_limit(spark, d):
    t = X.table(spark, d, "events").select((F.col("user_id") % 10).cast("string").alias("icao24"), (F.col("event_id") * 7919 % 100003 * 100_000_000).alias("t_ns"))
    return tracks.rate_limited(t).select(F.col("icao24").cast("long").alias("key"), "t_ns")


@query(
    """WITH RECURSIVE r_ AS (SELECT k, t FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY t) AS n FROM (SELECT DISTINCT user_id % 10 AS k, (event_id * 7919 % 100003) * 500000000 AS t FROM events)) WHERE n >= 5),
a AS (SELECT k, min(t) AS t FROM r_ GROUP BY k UNION ALL SELECT a.k, min(r_.t) FROM a JOIN r_ ON r_.k = a.k AND r_.t > a.t + 5000000000 GROUP BY a.k, a.t)
SELECT k AS key, t AS t_ns FROM a"""
)
def classify_due(spark, d):
    t = X.table(spark, d, "events").select((F.col("user_id") % 10).cast("string").alias("icao24"), (F.col("event_id") * 7919 % 100003 * 500_000_000).alias("t_ns")).distinct()
    return tracks.classify_due(t).select(F.col("icao24").cast("long").alias("key"), "t_ns")


@query(
    _with(SENSORS, TX, RX)
    + """SELECT event_id, count(*) OVER (PARTITION BY icao24 ORDER BY first_ ROWS UNBOUNDED PRECEDING) AS n_beacons FROM
  (SELECT event_id, icao24, min(t_ns) AS first_ FROM rx GROUP BY 1, 2 HAVING count(*) >= 2)"""
)
def beacon_count(spark, d):
    return tracks.beacon_counts(_groups(spark, d)).select("event_id", "n_beacons")


@query(
    _with(TX)
    + """, i AS (SELECT lpad(to_hex(4194304 + c_custkey % 500), 6, '0') AS icao, nullif(trim(CASE WHEN c_custkey % 3 = 0 THEN ' ' ELSE c_name END), '') AS callsign, 1704067200 + c_custkey * 2003 AS at FROM customer)
SELECT event_id, CASE WHEN tx.t_ns - i.at * 1000000000 < 300000000000 THEN i.callsign END AS callsign FROM tx ASOF LEFT JOIN i ON lower(i.icao) = lower(tx.icao24) AND tx.t_ns >= i.at * 1000000000"""
)
def enrichment_ttl(spark, d):
    c = X.table(spark, d, "customer")
    info = c.select(
        F.lpad(F.hex(F.lit(4194304) + F.col("c_custkey") % 500), 6, "0").alias("icao24"), F.when(F.col("c_custkey") % 3 == 0, " ").otherwise(F.col("c_name")).alias("callsign"),
        F.lit("").alias("squawk"), F.lit(" ").alias("origin_country"), (F.lit(1704067200) + F.col("c_custkey") * 2003).alias("fetched_s"),
    )
    return tracks.enrich(_track(spark, d), info, C.ENRICHMENT_TTL_S).select("event_id", "callsign")


@query(
    _with(TX)
    + """, h AS (SELECT event_id, row_number() OVER (PARTITION BY icao24 ORDER BY t_ns) AS n, value FROM tx)
SELECT event_id, greatest(20 - n, 0) AS n_padding FROM h"""
)
def feature_pad_normalise(spark, d):
    t = tracks.history(_track(spark, d), ["value", "lat", "lon", "alt_m"])
    rows = F.transform("states", lambda s: F.array(s["lat"], s["lon"], s["alt_m"], s["value"], F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(0.0)))
    p = tracks.padded(t.withColumn("states", rows))
    empty = F.size(F.filter("states", lambda s: F.forall(s, lambda v: v == 0)))
    return p.select("event_id", empty.cast("long").alias("n_padding"))


@query(
    _with(TX)
    + """SELECT k AS feature, round(avg(v), 4) + 0.0 AS mean, round(stddev_pop(v) + 1e-8, 4) + 0.0 AS std FROM
  (SELECT 0 AS k, lat AS v FROM tx UNION ALL SELECT 1, lon FROM tx UNION ALL SELECT 2, alt_m FROM tx) GROUP BY 1"""
)
def feature_scales(spark, d):
    t = _track(spark, d).select(F.array(F.array("lat", "lon", "alt_m")).alias("states"))
    return tracks.feature_scales(t).select("feature", r("mean", 4).alias("mean"), r("std", 4).alias("std"))


@query(_with(TX) + """SELECT icao24, t_ns, '{"event_id":' || event_id || CASE WHEN event_id % 2 = 0 THEN ',"squawk":"s' || (event_id % 7) || '"' ELSE '' END || '}' AS json FROM tx""")
def aircraft_json(spark, d):
    t = _track(spark, d).withColumn("squawk", F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("s"), (F.col("event_id") % 7).cast("string"))))
    j = F.to_json(F.struct("event_id", "squawk"), {"ignoreNullFields": "true"})
    return t.select("icao24", "t_ns", j.alias("json"))


# Solvers: no SQL can express them; tests hold them against known geometry.


def _placed(spark, d) -> DataFrame:
    return gdop.with_ecef(X.sensors(spark, d)).select("sensor_id", "x", "y", "z")


@query()
def mlat_solve(spark, d):
    g = _groups(spark, d).select(F.col("event_id").alias("key"), "frames")
    inputs = solve.mlat_inputs(g, _placed(spark, d)).join(_track(spark, d).select(F.col("event_id").alias("key"), "alt_m", F.lit(0.0).alias("alt_age_s")), "key")
    return solve.mlat(inputs)


@query()
def semi_mlat_solve(spark, d):
    g = _groups(spark, d).select(F.col("event_id").alias("key"), F.slice("frames", 1, 2).alias("frames"))
    x, y, z = geo.wgs84_to_ecef(F.col("lat"), F.col("lon"), F.col("alt_m"))
    cov = F.array(*(F.lit(250_000.0 if i % 4 == 0 else 0.0) for i in range(9)))
    prior = _track(spark, d).select(F.col("event_id").alias("key"), F.array(x + 200.0, y + 200.0, z).alias("prior"), cov.alias("prior_cov"), "alt_m", F.lit(0.0).alias("alt_age_s"))
    rows = solve.mlat_inputs(g, _placed(spark, d)).select("key", "xs", (-F.col("tdoa_m")[0]).alias("tdoa_m"), F.lit(100.0).alias("var_m2"))
    return solve.semi(rows.join(prior, "key"))


@query()
def clock_solve(spark, d):
    e = clock.edges(_obs(spark, d)).withColumn("region", F.floor(F.col("sensor_i") / X.PER_REGION).cast("long"))
    return solve.clocks(e, "region")


@query()
def kalman_track(spark, d):
    return solve.kalman(_track(spark, d).withColumn("accuracy_m", F.lit(500.0)))


@query()
def anomaly_labels(spark, d):
    t = tracks.history(_track(spark, d), ["value", "lat", "lon", "alt_m"])
    rows = F.transform("states", lambda s: F.array(s["lat"], s["lon"], s["alt_m"], s["value"], F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(0.0)))
    p = tracks.padded(t.withColumn("states", rows)).select(F.col("event_id").alias("key"), "states")
    return solve.labels(p, solve.small_weights(), [0.0] * 8, [60.0, 60.0, 12000.0, 100.0, 1.0, 1.0, 1.0, 1.0])


@query(
    _with(SENSORS, TX, RX)
    + """SELECT event_id, sensor_id, t_ns // 1000000000 AS timestamp_seconds, t_ns % 1000000000 AS timestamp_nanoseconds FROM rx"""
)
def packet_decode(spark, d):
    f = X.frames(spark, d).withColumn("ingest_ts", F.timestamp_seconds("timestamp_seconds"))
    be = lambda c: F.unhex(F.lpad(F.hex(c), 16, "0"))
    zero = F.unhex(F.lit("00" * 24))
    p = F.concat(be(F.col("sensor_id")), zero, be(F.pmod("timestamp_seconds", F.lit(86400))), be(F.col("timestamp_nanoseconds")), F.unhex(F.lpad(F.hex("event_id"), 16, "0")))
    out = sources.decode_packets(f.select(F.lit("k").alias("public_key"), "ingest_ts", p.alias("packet")))
    return out.select(F.conv("raw_modes_hex", 16, 10).cast("long").alias("event_id"), "sensor_id", "timestamp_seconds", "timestamp_nanoseconds")


_MERGED = """merged AS (SELECT sensor_id, lat, lon, alt FROM sensors UNION ALL SELECT 1000000, cast(51 as double), cast(-5 as double), cast(100 as double)
  UNION ALL SELECT 1000001, cast(50.5 as double), cast(-4 as double), cast(200 as double))"""


@query(_with(SENSORS, _MERGED) + "SELECT sensor_id, round(lat, 6) + 0.0 AS lat, round(lon, 6) + 0.0 AS lon, alt FROM merged")
def planning_merge(spark, d):
    s = planning.PlanningSession(spark, X.sensors(spark, d))
    s.add(51.0, -5.0, 100.0)
    s.add(50.5, -4.0, 200.0)
    first = F.min(F.when(F.col("sensor_id") >= C.VIRTUAL_ID_START, F.col("sensor_id")))
    every = s.all_sensors()
    base = every.agg(first.alias("_f"))
    number = F.when(F.col("sensor_id") >= C.VIRTUAL_ID_START, F.col("sensor_id") - F.col("_f") + C.VIRTUAL_ID_START).otherwise(F.col("sensor_id"))
    return every.crossJoin(F.broadcast(base)).select(number.alias("sensor_id"), r("lat", 6).alias("lat"), r("lon", 6).alias("lon"), "alt")  # one row


@query(_with(SENSORS, "c AS (SELECT avg(sx) AS x, avg(sy) AS y, avg(sz) AS z FROM sensors)") + """SELECT round(x / n * 6381000, 2) + 0.0 AS x, round(y / n * 6381000, 2) + 0.0 AS y,
  round(z / n * 6381000, 2) + 0.0 AS z FROM (SELECT *, sqrt(x * x + y * y + z * z) AS n FROM c)""")
def sensor_centroid(spark, d):
    return gdop.centroid(X.sensors(spark, d)).select(*(r(a, 2).alias(a) for a in "xyz"))


_EPOCH = "SELECT event_id, s + CASE WHEN s - n > 43200 THEN -86400 WHEN n - s > 43200 THEN 86400 ELSE 0 END AS epoch_s FROM (SELECT event_id, n, n - n % 86400 + (event_id * 7919) % 86400 AS s FROM (SELECT event_id, epoch_us(ts) // 1000000 AS n FROM events))"


@query(_EPOCH)
def epoch_seconds(spark, d):
    t = _track(spark, d).select("event_id", F.timestamp_seconds(F.floor(F.col("t_ns") / 1_000_000_000)).alias("at"))
    return t.select("event_id", sources.epoch_seconds(F.col("event_id") * 7919 % 86400, F.col("at")).alias("epoch_s"))


@query("SELECT event_id, cast(json_extract_string(props, '$.k') as bigint) AS k FROM events")
def json_parse(spark, d):
    return X.table(spark, d, "events").select("event_id", F.from_json("props", "k long")["k"].alias("k"))


# A sensor's rows in order, with its state and the run of rows without edges.
_STATUS = """WITH RECURSIVE """ + SERIES + """, x AS (SELECT sensor_id, row_number() OVER (PARTITION BY sensor_id ORDER BY timestamp_ns) AS n, timestamp_ns, offset_ns * 3 AS g, timestamp_ns // 1000000000 % 8 // 2 AS d FROM series),
z AS (SELECT sensor_id, cast(0 as bigint) AS n, cast(0 as bigint) AS timestamp_ns, 'unknown' AS s, cast(0 as bigint) AS e FROM x WHERE n = 1
  UNION ALL SELECT x.sensor_id, x.n, x.timestamp_ns, CASE
    WHEN s = 'disconnected' THEN CASE WHEN d > 0 THEN 'marginal' ELSE s END
    WHEN s = 'unknown' AND d = 0 THEN s
    WHEN s <> 'unknown' AND d = 0 AND e + 1 >= 3 THEN 'disconnected'
    WHEN s = 'unstable' THEN CASE WHEN g < 400 THEN 'marginal' ELSE s END
    WHEN g > 500 THEN 'unstable'
    WHEN s = 'marginal' THEN CASE WHEN d >= 2 AND g < 200 THEN 'stable' ELSE s END
    WHEN d < 2 OR g > 350 THEN 'marginal' ELSE 'stable' END, CASE WHEN d = 0 THEN e + 1 ELSE 0 END
  FROM z JOIN x ON x.sensor_id = z.sensor_id AND x.n = z.n + 1)
"""


def _status_rows(spark, d) -> DataFrame:
    return _series(spark, d).select("sensor_id", "timestamp_ns", (F.col("offset_ns") * 3).alias("sigma_ns"), F.floor(F.col("timestamp_ns") / 1_000_000_000 % 8 / 2).alias("degree"))


@query(_STATUS + "SELECT sensor_id, timestamp_ns, s AS status FROM z WHERE n > 0")
def status_hysteresis(spark, d):
    return clock.status_series(_status_rows(spark, d)).select("sensor_id", "timestamp_ns", "status")


@query(_STATUS + "SELECT cast(count_if(s IN ('stable', 'marginal') AND (SELECT max(timestamp_ns) FROM x) - timestamp_ns <= 120000000000) as bigint) AS n_calibrated FROM z WHERE n > 0")
def calibrated_sensors(spark, d):
    rows = clock.status_series(_status_rows(spark, d)).withColumnRenamed("timestamp_ns", "solve_ns")
    return network.calibrated_count(rows.crossJoin(F.broadcast(rows.agg(F.max("solve_ns").alias("now")))), F.col("now"))  # one row


@query(
    _with(SENSORS, TX, RX, PAIRS, OBS)
    + """, b AS (SELECT event_id, sensor_i, sensor_j, timestamp_ns FROM obs WHERE weight > 0 AND timestamp_ns >= (SELECT max(timestamp_ns) FROM obs) - 60000000000)
SELECT event_id, sensor_i, sensor_j FROM b QUALIFY row_number() OVER (ORDER BY timestamp_ns DESC, sensor_i, sensor_j, event_id) <= 30000"""
)
def observation_buffer(spark, d):
    o = _obs(spark, d).select("event_id", "sensor_i", "sensor_j", "timestamp_ns")
    return clock.recent(o).select("event_id", "sensor_i", "sensor_j")


@query()
def geometry_screen(spark, d):
    g = _groups(spark, d).select(F.col("event_id").alias("key"), F.array_sort(F.transform("frames", lambda f: f["sensor_id"])).alias("sensor_ids"))
    return solve.screen(g, _placed(spark, d))


@query()
def label_training(spark, d):
    t = training.synthetic_tracks(spark)
    scales = {r["feature"]: (r["mean"], r["std"]) for r in tracks.feature_scales(t).collect()}  # eight rows
    mean, std = ([scales[i][k] for i in range(C.N_FEATURES)] for k in (0, 1))
    held = F.pmod(F.xxhash64("key"), F.lit(5)) == 0
    model = training.train(t.filter(~held), mean, std)
    return training.accuracy(model, t.filter(held), mean, std)
