import random

from skylattice.operators import frames


def anchors(rows, window_ns):
    """Sensors of each group, by its first time."""
    out, anchor = {}, None
    for t, s in sorted(rows):
        if anchor is None or t - anchor > window_ns:
            anchor = t
        out.setdefault(anchor, set()).add(s)
    return {a: len(s) for a, s in out.items() if len(s) >= 2}


def test_a_long_island_is_followed_whole(spark):
    """One key whose frames never pause: 60,000 in one island, which took time by the square of their number."""
    r = random.Random(9)
    rows = [(r.randrange(50_000) * 10_000_000, r.randrange(6)) for _ in range(60_000)]
    df = spark.createDataFrame([("a", bytearray(b"0"), t, s) for t, s in rows], "icao24 string, payload binary, t_ns long, sensor_id long")
    got = {x["first_seen_ns"]: len(x["frames"]) for x in frames.correlate(df, 200_000_000).collect()}
    assert got == anchors(rows, 200_000_000)
