"""Coverage quality: geometric dilution of precision over a grid, from sensors and an altitude."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skylattice import consts as C
from skylattice.functions import geo, linalg3

SUMS = ("xx", "xy", "xz", "yy", "yz", "zz")
#: Sensors that are broadcast at most; beyond, Spark pairs blocks of cells and sensors instead.
SENSOR_BLOCK = 20_000


def quality(gdop: Column) -> Column:
    finite = gdop.isNotNull() & ~F.isnan(gdop) & (gdop < float("inf"))
    out = F.lit("unacceptable")
    for name, limit in reversed(C.GDOP_CLASSES):
        out = F.when(gdop < limit, name).otherwise(out)
    return F.when(finite, out).otherwise("degenerate")


def with_ecef(df: DataFrame, alt: str = "alt") -> DataFrame:
    x, y, z = geo.wgs84_to_ecef(F.col("lat"), F.col("lon"), F.col(alt))
    return df.withColumns({"x": x, "y": y, "z": z})


def bounds(sensors: DataFrame) -> DataFrame:
    """One row (south, north, west, east): the box of the sensors, padded and clamped; the default box without sensors."""
    s, n, w, e = C.DEFAULT_BOUNDS
    agg = sensors.agg(F.min("lat").alias("a"), F.max("lat").alias("b"), F.min("lon").alias("c"), F.max("lon").alias("d"))
    lit = lambda v: F.lit(float(v))
    some = lambda column, value, otherwise: F.when(F.col(column).isNotNull(), value).otherwise(lit(otherwise))
    return agg.select(
        some("a", F.greatest(F.col("a") - C.PAD_LAT_DEG, lit(-C.LAT_LIMIT)), s).alias("south"),
        some("b", F.least(F.col("b") + C.PAD_LAT_DEG, lit(C.LAT_LIMIT)), n).alias("north"),
        some("c", F.greatest(F.col("c") - C.PAD_LON_DEG, lit(-C.LON_LIMIT)), w).alias("west"),
        some("d", F.least(F.col("d") + C.PAD_LON_DEG, lit(C.LON_LIMIT)), e).alias("east"),
    )


def grid(box: DataFrame, step: float = C.GRID_STEP_DEG) -> DataFrame:
    """(i, j, lat, lon): cells from south-west on, both ends included, latitudes outermost."""
    count = lambda a, b: F.floor((F.col(b) - F.col(a)) / F.lit(step) + 1e-9).cast("long")
    rows = box.select("*", F.explode(F.sequence(F.lit(0).cast("long"), count("south", "north"))).alias("i"))
    cells = rows.select("*", F.explode(F.sequence(F.lit(0).cast("long"), count("west", "east"))).alias("j"))
    return cells.select("i", "j", (F.col("south") + F.col("i") * F.lit(step)).alias("lat"), (F.col("west") + F.col("j") * F.lit(step)).alias("lon"))


def normal_matrix(points: DataFrame, sensors: DataFrame, keys: list[str]) -> DataFrame:
    """For each point (keys, x, y, z) the sums of products of directions to sensors (sensor_id, sx, sy,
    sz) less the direction to the reference sensor, the one with the smallest id. Sensors are a
    dimension; they are broadcast behind a check of their number, otherwise the join is left to Spark."""
    small = sensors.limit(SENSOR_BLOCK + 1).count() <= SENSOR_BLOCK
    side = F.broadcast(sensors) if small else sensors
    reference = sensors.agg(F.min_by(F.struct("sx", "sy", "sz"), "sensor_id").alias("r")).select(*(F.col(f"r.s{a}").alias(f"r{a}") for a in "xyz"))
    base = points.crossJoin(F.broadcast(reference))  # one row
    to = lambda p: F.sqrt(sum(((F.col(f"{p}{a}") - F.col(a)) * (F.col(f"{p}{a}") - F.col(a)) for a in "yz"), (F.col(f"{p}x") - F.col("x")) * (F.col(f"{p}x") - F.col("x"))))
    joined = base.withColumn("rd", to("r")).join(side)
    joined = joined.withColumn("d", to("s"))
    h = {a: (F.col(f"s{a}") - F.col(a)) / F.col("d") - (F.col(f"r{a}") - F.col(a)) / F.col("rd") for a in "xyz"}
    rows = joined.select(*keys, "d", *(v.alias(f"h{a}") for a, v in h.items()))
    sums = [F.sum(F.col(f"h{k[0]}") * F.col(f"h{k[1]}")).alias(k) for k in SUMS]
    return rows.groupBy(*keys).agg(F.count("*").alias("num_sensors"), F.min("d").alias("nearest"), *sums)


def diagnose(matrices: DataFrame) -> DataFrame:
    """Adds gdop (null where degenerate), condition_number and quality."""
    m = [F.col(k) for k in SUMS]
    top, low = linalg3.eigenvalues(*m)
    out = matrices.withColumn("top", top).withColumn("low", low)
    enough = (F.col("num_sensors") >= 3) & (F.col("nearest") >= C.MIN_DISTANCE_M)
    condition = F.when(enough & (F.col("low") > 0), F.col("top") / F.col("low"))
    sound = enough & (F.col("low") >= C.GRID_MIN_SINGULAR) & (condition <= C.MAX_CONDITION)
    out = out.withColumn("condition_number", condition).withColumn("gdop", F.when(sound, F.sqrt(linalg3.inverse_trace(*m))))
    return out.withColumn("quality", quality(F.col("gdop"))).drop("top", "low")


def coverage(sensors: DataFrame, step: float = C.GRID_STEP_DEG, altitude: float = C.HEATMAP_ALT_M, box: DataFrame | None = None) -> DataFrame:
    """sensors(sensor_id, lat, lon, alt): (i, j, lat, lon, gdop, quality, num_sensors, condition_number)."""
    placed = with_ecef(sensors).select("sensor_id", *(F.col(a).alias(f"s{a}") for a in "xyz"))
    cells = with_ecef(grid(bounds(sensors) if box is None else box, step).withColumn("alt", F.lit(float(altitude))))
    # Cells are generated in one partition; the sums are work for all.
    cells = cells.repartition(F.col("i"))
    found = diagnose(normal_matrix(cells, placed, ["i", "j", "lat", "lon"]))
    return found.select("i", "j", "lat", "lon", "gdop", "quality", "num_sensors", "condition_number")


def coverage_stats(points: DataFrame) -> DataFrame:
    """One row: points of each class, mean and upper median of finite GDOP (null: none)."""
    names = [n for n, _ in C.GDOP_CLASSES] + ["unacceptable", "degenerate"]
    return points.agg(
        F.count("*").alias("total_points"),
        *(F.count_if(F.col("quality") == n).alias(n) for n in names),
        F.avg("gdop").alias("mean_gdop"),
        upper_median("gdop").alias("median_gdop"),
    )


def upper_median(column: str) -> Column:
    """The element n // 2 of the sorted values."""
    return F.expr(f"percentile_disc(0.5) WITHIN GROUP (ORDER BY {column} DESC)")


def centroid(sensors: DataFrame) -> DataFrame:
    """The sensors' mean direction at cruise altitude: (x, y, z)."""
    mean = with_ecef(sensors).agg(*(F.avg(a).alias(a) for a in "xyz"))
    norm = F.sqrt(sum((F.col(a) * F.col(a) for a in "yz"), F.col("x") * F.col("x")))
    return mean.select(*((F.col(a) / norm * C.CRUISE_RADIUS_M).alias(a) for a in "xyz"))
