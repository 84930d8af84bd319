import pytest

from skylattice.operators import frames, network, solve
from skylattice.streaming import processors


@pytest.fixture
def stream(spark, tmp_path):
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    processors.configure(spark)

    def make(df):
        df.coalesce(1).write.parquet(str(tmp_path / "in"))
        return spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))

    def run(out, name):
        q = out.writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        q.awaitTermination(120)
        return spark.table(name)

    yield make, run
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)


def test_correlation_like_the_table(spark, stream):
    make, run = stream
    base = 1_700_000_000_000_000_000
    rows = [("A", b"p", base + i * 70_000_000, i % 3) for i in range(12)] + [("B", b"q", base, 1), ("Z", b"z", base + 60_000_000_000, 1)]
    df = spark.createDataFrame(rows, "icao24 string, payload binary, t_ns long, sensor_id long")
    got = run(processors.correlate(make(df)), "groups").collect()
    want = frames.correlate(df).collect()
    assert sorted((r["icao24"], r["first_seen_ns"], r["sensor_ids"]) for r in got) == sorted(
        (r["icao24"], r["first_seen_ns"], [f["sensor_id"] for f in r["frames"]]) for r in want
    )


def test_tracks_like_the_table(spark, stream):
    make, run = stream
    rows = [(f"{k:06X}", i * 10**9, 50 + i * 1e-3, 1.0 + k, 9000.0, 100.0) for k in range(3) for i in range(8)]
    df = spark.createDataFrame(rows, "icao24 string, t_ns long, lat double, lon double, alt_m double, accuracy_m double")
    got = run(processors.track(make(df)), "tracks").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, solve.kalman(df).collect()))


def test_pairs_like_the_table(spark, stream):
    make, run = stream
    base = 1_700_000_000_000_000_000
    rows = [(1, j, base + i * 10**9, 100.0 * j + 2.0 * i + (5000.0 if i == 20 else 0.0)) for j in (2, 3) for i in range(40)]
    df = spark.createDataFrame(rows, "sensor_i long, sensor_j long, timestamp_ns long, residual_ns double")
    got = run(processors.pair_clocks(make(df)), "pairs")
    want = network.gated(df)
    assert sorted(map(tuple, got.select(*want.columns).collect())) == sorted(map(tuple, want.collect()))
    last = got.filter(f"timestamp_ns = {base + 39 * 10**9} and sensor_j = 2").first()
    assert last["sample_count"] == 39 and abs(last["slope_ns_per_s"] - 2) < 1e-6 and abs(last["offset_ns"] - 278) < 1e-3


def test_late_rows_are_counted(spark, stream, tmp_path):
    make, run = stream
    base = 1_700_000_000_000_000_000
    frame = lambda t, s: spark.createDataFrame([(s, b"p", t)], "sensor_id long, payload binary, t_ns long").coalesce(1)
    source = make(frame(base + 60 * 10**9, 1))
    out = processors.deduplicated(source).drop("event_time")
    start = lambda: out.writeStream.format("noop").option("checkpointLocation", str(tmp_path / "late")).trigger(availableNow=True).start()
    start().awaitTermination(120)
    frame(base, 2).write.mode("append").parquet(str(tmp_path / "in"))
    q = start()
    q.awaitTermination(120)
    assert processors.late_rows(q) == 1
