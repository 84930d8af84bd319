import datetime

import pytest
from pyspark.sql import functions as F

from skylattice.functions import geo
from skylattice.plans import catalog

#: Just before a whole second, where a double rounds up to it.
LAST_NS = 999_999_969


@pytest.fixture(scope="module")
def edge(spark, tmp_path_factory):
    """Tables in which receptions fall into the last nanoseconds of a second."""
    duckdb = pytest.importorskip("duckdb")
    d = str(tmp_path_factory.mktemp("edge"))
    zero = datetime.datetime(2024, 1, 1, tzinfo=datetime.timezone.utc)
    spark.createDataFrame([(i,) for i in range(8)], "s_suppkey long").coalesce(1).write.parquet(f"{d}/supplier.parquet")

    def events(starts):
        rows = [(i, zero + datetime.timedelta(microseconds=m), i % 5, "view", float(i), "{}") for i, m in enumerate(starts)]
        return spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string, value double, props string").coalesce(1)

    events([i * 20_000_000 for i in range(400)]).write.parquet(f"{d}/events0.parquet")
    with duckdb.connect() as c:
        c.sql("set timezone = 'UTC'")
        c.sql(f"create view supplier as from '{d}/supplier.parquet/*.parquet'")
        c.sql(f"create view events as from '{d}/events0.parquet/*.parquet'")
        heard = dict(c.sql(catalog._with(catalog.SENSORS, catalog.TX, catalog.RX) + "SELECT event_id, max(t_ns) % 1000000000 FROM rx GROUP BY 1").fetchall())
    # Events are in microseconds: the last reception of each falls 31 to 1030 ns before the second; those by 128 at most matter.
    starts = [i * 20_000_000 + (LAST_NS - heard[i]) // 1000 for i in range(400)]
    assert any(heard[i] + (LAST_NS - heard[i]) // 1000 * 1000 > 999_999_880 for i in range(400))
    events(starts).write.parquet(f"{d}/events.parquet")
    return d


def oracle(d, name):
    import duckdb

    with duckdb.connect() as c:
        c.sql("set timezone = 'UTC'")
        for t in ("supplier", "events"):
            c.sql(f"create view {t} as from '{d}/{t}.parquet/*.parquet'")
        found = c.sql(catalog.ORACLES[name])
        return found.columns, sorted(found.fetchall())


@pytest.mark.parametrize(
    "name",
    [
        "beacon_eligibility", "beacon_residuals", "correlate_groups", "edge_stats", "frame_dedupe", "packet_decode", "pair_fallback_offset",
        "pair_variance_fallback", "pair_variance_solved", "sensor_pairs", "tdoa_vectors",
    ],
)
def test_times_just_before_a_whole_second(spark, edge, name):
    columns, want = oracle(edge, name)
    assert sorted(map(tuple, catalog.QUERIES[name](spark, edge).select(*columns).collect())) == want


def test_pair_ols_just_before_a_whole_second(spark, edge):
    columns, want = oracle(edge, "pair_ols")
    assert sorted(map(tuple, catalog.QUERIES["pair_ols"](spark, edge).select(*columns).collect())) == want


def test_pair_ols_of_users_beyond_24_bits(spark, edge, tmp_path):
    """Half the aircraft have numbers that an address has no room for; they are received like the others."""
    e = spark.read.parquet(f"{edge}/events.parquet").withColumn("user_id", F.col("user_id") + F.when(F.col("event_id") % 2 == 0, 20_000_000).otherwise(0))
    e.coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    spark.read.parquet(f"{edge}/supplier.parquet").coalesce(1).write.parquet(f"{tmp_path}/supplier.parquet")
    columns, want = oracle(str(tmp_path), "pair_ols")
    assert sorted(map(tuple, catalog.QUERIES["pair_ols"](spark, str(tmp_path)).select(*columns).collect())) == want


def test_divergences_that_meet_the_limit(spark, tmp_path):
    """Aircraft that climb and sink by 1000 and 2000 m in place: the last place of a sine decides what is above 2000 m."""
    pytest.importorskip("duckdb")
    d, rows = str(tmp_path), []
    for user, place in ((4212, 21), (9005, 45), (9015, 45), (9025, 45), (9035, 45), (9045, 45), (9085, 45), (9095, 45)):
        for level in (0, 1, 2, 0, 2, 1):
            at = datetime.datetime(2024, 1, 1, tzinfo=datetime.timezone.utc) + datetime.timedelta(seconds=len(rows))
            rows.append((place + 1000 * level + 3000 * len(rows), at, user, "view", 1.0, "{}"))
    spark.range(1600).withColumnRenamed("id", "s_suppkey").coalesce(1).write.parquet(f"{d}/supplier.parquet")
    spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string, value double, props string").coalesce(1).write.parquet(f"{d}/events.parquet")
    columns, want = oracle(d, "spoof_asof")
    assert sorted(map(tuple, catalog.QUERIES["spoof_asof"](spark, d).select(*columns).collect())) == want


def test_ecef_by_the_library_of_odd_angles(spark):
    rows = [(51.5, -0.1, 100.0), (None, 1.0, 1.0), (1.0, None, 1.0), (float("nan"), 1.0, 1.0), (1.0, float("inf"), 1.0), (-90.0, 180.0, 0.0)]
    t = spark.createDataFrame(rows, "lat double, lon double, alt double")
    both = [f(*(F.col(c) for c in t.columns)) for f in (geo.library_ecef, geo.wgs84_to_ecef)]
    for r in t.select(*(F.array(*found) for found in both)).collect():
        for a, b in zip(*r):
            assert a is None and b is None or a == pytest.approx(b, abs=1e-8, nan_ok=True)
