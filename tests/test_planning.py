import json

import pytest

from skylattice import planning
from skylattice.operators import gdop
from skylattice.sources import sinks


@pytest.fixture
def session(spark):
    rows = [(1, 51.5, -1.0, 100.0), (2, 50.5, -1.0, 100.0)]
    return planning.PlanningSession(spark, spark.createDataFrame(rows, "sensor_id long, lat double, lon double, alt double"), capacity=2)


@pytest.mark.parametrize("place", [(91, 0, 0), (-91, 0, 0), (0, 181, 0), (0, -181, 0), (0, 0, -1), (0, 0, 20000), (float("nan"), 0, 0), (0, float("inf"), 0)])
def test_rejects(session, place):
    with pytest.raises(planning.Rejected):
        session.add(*place)


def test_registry(session):
    a, b = session.add(51, -0.5, 0), session.add(51, -1.5, 15240)
    assert b > a >= 1_000_000 and session.count() == 2
    with pytest.raises(planning.Rejected):
        session.add(0, 0, 0)
    assert session.remove(a) and not session.remove(a) and [x["id"] for x in session.export()] == [b]
    session.clear()
    assert session.count() == 0


def test_coverage_needs_three(session):
    with pytest.raises(planning.Rejected):
        session.coverage()
    session.add(51, -0.5, 100)
    session.add(51, -1.5, 100)
    points = session.coverage(1.0)
    stats = gdop.coverage_stats(points)
    text = json.loads(sinks.gdop_heatmap(points, stats, mode="planning").first()["json"])
    assert text["type"] == "gdop_heatmap" and len(text["points"]) == text["stats"]["total_points"] > 0


def test_commands(session):
    assert session.handle({"type": "add_virtual_sensor", "lat": 1, "lon": 2, "alt_m": 3})["type"] == "virtual_sensor_added"
    assert session.handle({"type": "set_planning_altitude", "altitude_m": 5.0})["type"] == "error"
    assert session.handle({"type": "remove_virtual_sensor", "id": 5})["type"] == "virtual_sensor_removed"
    assert planning.heatmap_due(None, 3) and planning.heatmap_due(10, 13) and not planning.heatmap_due(10, 12) and not planning.heatmap_due(None, 2)


def test_altitudes_are_apart_and_aircraft_are_told_about(spark, session):
    assert session.handle({"type": "set_live_heatmap_altitude", "altitude_m": 1524.0}) == {"type": "altitude_set", "altitude_m": 1524.0}
    assert session.live_altitude == 1524.0 and session.altitude == 9144.0
    rows = [("ABC123", "OLD1", "7000", " ", 100), ("abc123", "NEW1 ", "7001", "X", 900), ("DEF456", None, None, None, 900)]
    session.info = spark.createDataFrame(rows, "icao24 string, callsign string, squawk string, origin_country string, fetched_s long")
    ask = lambda icao, **now: session.handle({"type": "request_aircraft_info", "icao24": icao, **now})
    assert ask("abc123") == {"type": "aircraft_info", "icao24": "abc123", "callsign": "NEW1", "squawk": "7001", "origin_country": "X"}
    assert ask("ABC123", now_s=200)["callsign"] == "OLD1" and ask("ABC123", now_s=1300)["callsign"] is None and ask("def456")["callsign"] is None
