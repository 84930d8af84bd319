"""Planning with virtual sensors: what would coverage be if receivers stood there too?"""

from __future__ import annotations

import itertools
import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skylattice import consts as C
from skylattice.operators import gdop

_ids = itertools.count(C.VIRTUAL_ID_START)


class Rejected(ValueError):
    """A command that isn't allowed; its text says why."""


class PlanningSession:
    """One client's virtual sensors and planning altitude, over the real sensors (sensor_id, lat, lon, alt); the
    altitude of the live heatmap, of the real sensors alone, is another one. info(icao24, callsign, squawk,
    origin_country, fetched_s), where given, answers what is asked about an aircraft."""

    def __init__(self, spark: SparkSession, sensors: DataFrame, capacity: int = C.MAX_VIRTUAL, info: DataFrame | None = None):
        self.spark, self.sensors, self.capacity, self.info = spark, sensors, capacity, info
        self.altitude = self.live_altitude = C.HEATMAP_ALT_M
        self._virtual: dict[int, tuple[float, float, float]] = {}

    def add(self, lat: float, lon: float, alt_m: float) -> int:
        if len(self._virtual) >= self.capacity:
            raise Rejected(f"at most {self.capacity} virtual sensors")
        if not all(map(math.isfinite, (lat, lon, alt_m))):
            raise Rejected("a position must be finite")
        if not -90 <= lat <= 90:
            raise Rejected(f"latitude {lat} is not in -90..90")
        if not -180 <= lon <= 180:
            raise Rejected(f"longitude {lon} is not in -180..180")
        if not 0 <= alt_m <= C.VIRTUAL_ALT_MAX_M:
            raise Rejected(f"altitude {alt_m} is not in 0..{C.VIRTUAL_ALT_MAX_M:g}")
        number = next(_ids)
        self._virtual[number] = (float(lat), float(lon), float(alt_m))
        return number

    def remove(self, number: int) -> bool:
        return self._virtual.pop(number, None) is not None

    def clear(self) -> None:
        self._virtual.clear()

    def count(self) -> int:
        return len(self._virtual)

    def export(self) -> list[dict]:
        from skylattice.solvers.linear import to_ecef

        return [{"id": k, "lat": a, "lon": o, "alt_m": h} | dict(zip("xyz", to_ecef(a, o, h).tolist())) for k, (a, o, h) in sorted(self._virtual.items())]

    def set_altitude(self, altitude: float, live: bool = False) -> None:
        if altitude not in C.PLANNING_ALTITUDES:
            raise Rejected(f"altitude must be one of {C.PLANNING_ALTITUDES}")
        if live:
            self.live_altitude = altitude
        else:
            self.altitude = altitude

    def live_coverage(self, step: float = C.GRID_STEP_DEG) -> DataFrame:
        """Coverage by the real sensors alone, at the altitude of the live heatmap."""
        return gdop.coverage(self.sensors, step, self.live_altitude)

    def aircraft_info(self, icao24: str, now_s: int | None = None) -> dict:
        """What the latest fetch said of an aircraft; nothing if there is none, or if it is older than five minutes."""
        found = None
        if self.info is not None:
            rows = self.info.filter(F.lower("icao24") == icao24.lower())
            if now_s is not None:
                rows = rows.filter(F.col("fetched_s").between(now_s - C.ENRICHMENT_TTL_S + 1, now_s))
            found = rows.orderBy(F.desc("fetched_s"), "callsign").first()  # one row
        clean = lambda v: (v or "").strip() or None
        return {k: clean(found[k]) if found else None for k in ("callsign", "squawk", "origin_country")}

    def all_sensors(self) -> DataFrame:
        rows = [(k, *v) for k, v in sorted(self._virtual.items())]
        virtual = self.spark.createDataFrame(rows, "sensor_id long, lat double, lon double, alt double")
        return self.sensors.select("sensor_id", "lat", "lon", "alt").unionByName(virtual)

    def coverage(self, step: float = C.GRID_STEP_DEG) -> DataFrame:
        every = self.all_sensors()
        if every.limit(3).count() < 3:
            raise Rejected("coverage needs three sensors, real or virtual")
        return gdop.coverage(every, step, self.altitude)

    def handle(self, command: dict) -> dict:
        """A client's command, told by its type; the answer as a message."""
        kind = command.get("type")
        try:
            if kind == "add_virtual_sensor":
                return {"type": "virtual_sensor_added", "id": self.add(command["lat"], command["lon"], command["alt_m"])}
            if kind == "remove_virtual_sensor":
                self.remove(command["id"])
                return {"type": "virtual_sensor_removed", "id": command["id"]}
            if kind == "clear_virtual_sensors":
                self.clear()
                return {"type": "virtual_sensors_cleared"}
            if kind in ("set_planning_altitude", "set_live_heatmap_altitude"):
                self.set_altitude(command["altitude_m"], live=kind != "set_planning_altitude")
                return {"type": "altitude_set", "altitude_m": command["altitude_m"]}
            if kind == "request_aircraft_info":
                return {"type": "aircraft_info", "icao24": command["icao24"]} | self.aircraft_info(command["icao24"], command.get("now_s"))
        except Rejected as e:
            return {"type": "error", "message": str(e)}
        return {"type": "error", "message": f"unknown command {kind!r}"}


def heatmap_due(last_count: int | None, count: int) -> bool:
    """Whether sensors changed enough for a new heatmap: the first time, or by over a fifth."""
    if count < 3:
        return False
    return last_count is None or abs(count - last_count) / max(last_count, 1) > 0.2


def planned_stats(points: DataFrame, real: int, virtual: int) -> DataFrame:
    return gdop.coverage_stats(points).withColumns({"mode": F.lit("planning"), "real_sensors": F.lit(real), "virtual_sensors": F.lit(virtual)})
