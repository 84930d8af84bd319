"""Receiver clocks: beacon residuals, edges of the sensor graph, drift, Allan deviation, topology."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skylattice import consts as C
from skylattice.functions import geo
from skylattice.operators.gdop import upper_median


#: Times are counted in seconds from here, so that a double keeps their nanoseconds better.
EPOCH_NS = 1_700_000_000_000_000_000


def beacon_residuals(pairs: DataFrame) -> DataFrame:
    """pairs(sensor_i, t_i, sensor_j, t_j, nuc, bx.., ix.., jx..): adds baseline_m, residual_ns and weight.
    Times are subtracted as integers, as a double can't hold nanoseconds of an epoch."""
    vec = lambda p: tuple(F.col(f"{p}{a}") for a in "xyz")
    d_i, d_j = geo.distance(vec("b"), vec("i")), geo.distance(vec("b"), vec("j"))
    level = F.lit(0.0)
    for n, w in C.NUC_WEIGHT.items():
        level = F.when(F.col("nuc") == n, w).otherwise(level)
    out = pairs.withColumn("baseline_m", geo.distance(vec("i"), vec("j")))
    out = out.withColumn("residual_ns", (F.col("t_i") - F.col("t_j")).cast("double") - (d_i - d_j) / F.lit(C.C_M_PER_NS))
    return out.withColumn("weight", level * F.least(F.col("baseline_m") / 100_000.0, F.lit(2.0)))


def oriented(obs: DataFrame) -> DataFrame:
    """Observations with the smaller sensor first; the residual changes its sign with them. Observations
    without weight (co-located sensors) are dropped."""
    swap = F.col("sensor_i") > F.col("sensor_j")
    kept = obs.filter("weight > 0 and sensor_i <> sensor_j")
    return kept.withColumns(
        {
            "residual_ns": F.when(swap, -F.col("residual_ns")).otherwise(F.col("residual_ns")),
            "sensor_i": F.least("sensor_i", "sensor_j"),
            "sensor_j": F.greatest("sensor_i", "sensor_j"),
        }
    )


def recent(obs: DataFrame, now_ns: Column | int | None = None, window_ns: int = C.DRIFT_WINDOW_NS, capacity: int = C.BUFFER_CAPACITY) -> DataFrame:
    """The observations that a bounded buffer would hold: the last so many, of the last so long before now
    (not given: the latest observation). The last so many come first, so the window is over those only."""
    last = obs.orderBy(F.desc("timestamp_ns"), "sensor_i", "sensor_j").limit(capacity)
    now = F.max("timestamp_ns").over(Window.partitionBy()) if now_ns is None else F.lit(now_ns)
    return last.withColumn("_now", now).filter(F.col("timestamp_ns") >= F.col("_now") - window_ns).drop("_now")


def edges(obs: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(by, sensor_i, sensor_j, mean_residual_ns, total_weight, obs_count, mad_ns): weighted mean, and the
    upper median of absolute residuals about the line over time. The line needs one pass (its sums are about
    the means, so any epoch will do), and the median another."""
    keys = [*(by or []), "sensor_i", "sensor_j"]
    timed = oriented(obs).withColumn("t_s", (F.col("timestamp_ns") - EPOCH_NS).cast("double") / 1e9)
    fit = timed.groupBy(*keys).agg(
        (F.sum(F.col("residual_ns") * F.col("weight")) / F.sum("weight")).alias("mean_residual_ns"),
        F.sum("weight").alias("total_weight"),
        F.count("*").alias("obs_count"),
        F.coalesce(F.regr_slope("residual_ns", "t_s"), F.lit(0.0)).alias("slope"),
        F.avg("residual_ns").alias("level"),
        F.avg("t_s").alias("middle"),
    )
    line = F.col("level") + F.col("slope") * (F.col("t_s") - F.col("middle"))
    off = timed.select(*keys, "residual_ns", "t_s").join(fit.select(*keys, "slope", "level", "middle"), keys).withColumn("off", F.abs(F.col("residual_ns") - line))
    mad = off.groupBy(*keys).agg(upper_median("off").alias("mad_ns"))
    return fit.join(mad, keys).select(*keys, "mean_residual_ns", "total_weight", "obs_count", "mad_ns")


def pair_fit(obs: DataFrame, samples: int = C.PAIR_SAMPLES) -> DataFrame:
    """The latest samples of each pair: (sensor_i, sensor_j, sample_count, slope_ns_per_s, offset_ns, is_converged)."""
    keys = ["sensor_i", "sensor_j"]
    order = Window.partitionBy(*keys).orderBy(F.desc("timestamp_ns"), "residual_ns")
    last = oriented(obs).withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= samples)
    end = F.max("timestamp_ns").over(Window.partitionBy(*keys))
    timed = last.withColumn("t_s", (F.col("timestamp_ns") - end).cast("double") / 1e9)
    return timed.groupBy(*keys).agg(
        F.count("*").alias("sample_count"),
        F.coalesce(F.regr_slope("residual_ns", "t_s"), F.lit(0.0)).alias("slope_ns_per_s"),
        F.coalesce(F.regr_intercept("residual_ns", "t_s"), F.avg("residual_ns")).alias("offset_ns"),
        (F.count("*") >= 25).alias("is_converged"),
    )


def pair_variance(edge: DataFrame) -> DataFrame:
    """Adds variance_ns2: the square of the (floored) deviation scaled to a standard deviation."""
    scaled = F.greatest(F.col("mad_ns"), F.lit(C.MAD_FLOOR_NS)) / C.MAD_TO_SIGMA
    return edge.withColumn("variance_ns2", scaled * scaled)


def drift(offsets: DataFrame, window_ns: int = C.DRIFT_WINDOW_NS) -> DataFrame:
    """offsets(sensor_id, timestamp_ns, offset_ns): adds drift_ns_per_s over the window up to each row."""
    order = Window.partitionBy("sensor_id").orderBy("timestamp_ns").rangeBetween(-window_ns, 0)
    at = F.min("timestamp_ns").over(Window.partitionBy("sensor_id"))
    timed = offsets.withColumn("_t", (F.col("timestamp_ns") - at).cast("double") / 1e9)
    slope = F.coalesce(F.regr_slope("offset_ns", "_t").over(order), F.lit(0.0))
    return timed.withColumn("drift_ns_per_s", slope).drop("_t")


def allan_deviation(offsets: DataFrame, taus: tuple[float, ...] = C.ALLAN_TAUS_S) -> DataFrame:
    """(sensor_id, tau_s, adev): null where the series spans less than 1.1 tau or has below two windows.
    Windows begin at each stride of round(tau / first gap) samples, and hold the samples of one tau."""
    order = Window.partitionBy("sensor_id").orderBy("timestamp_ns")
    t0 = F.min("timestamp_ns").over(Window.partitionBy("sensor_id"))
    rows = offsets.withColumn("t_s", (F.col("timestamp_ns") - t0).cast("double") / 1e9).withColumn("pos", F.row_number().over(order) - 1)
    span = rows.groupBy("sensor_id").agg(F.max("t_s").alias("span"), F.greatest(F.max(F.when(F.col("pos") == 1, F.col("t_s"))), F.lit(0.1)).alias("dt0"))
    listed = F.explode(F.array(*(F.lit(float(t)) for t in taus))).alias("tau_s")
    each = span.select("sensor_id", "span", "dt0", listed).withColumn("stride", F.greatest(F.lit(1), F.round(F.col("tau_s") / F.col("dt0")).cast("int")))
    starts = rows.join(each.filter(F.col("span") >= 1.1 * F.col("tau_s")), "sensor_id").filter("pos % stride = 0")
    starts = starts.select("sensor_id", "tau_s", F.col("t_s").alias("from_s"), (F.col("t_s") + F.col("tau_s")).alias("to_s"))
    samples = rows.select("sensor_id", "t_s", "offset_ns")
    # Half-open windows of one tau: samples are matched by the tau-sized bins a window touches.
    binned = starts.withColumn("bin", F.explode(F.expr("array(floor(from_s / tau_s), floor(from_s / tau_s) + 1)")))
    taus_of = each.select("sensor_id", "tau_s")
    by_bin = samples.join(taus_of, "sensor_id").withColumn("bin", F.floor(F.col("t_s") / F.col("tau_s")))
    inside = binned.join(by_bin, ["sensor_id", "tau_s", "bin"]).filter("t_s >= from_s and t_s < to_s")
    means = inside.groupBy("sensor_id", "tau_s", "from_s").agg(F.avg("offset_ns").alias("mean"))
    step = F.col("mean") - F.lag("mean").over(Window.partitionBy("sensor_id", "tau_s").orderBy("from_s"))
    diffs = means.withColumn("step", step).groupBy("sensor_id", "tau_s").agg(F.count("*").alias("m"), F.sum(F.col("step") * F.col("step")).alias("s"))
    adev = diffs.select("sensor_id", "tau_s", F.when(F.col("m") >= 2, F.sqrt(F.col("s") / (2.0 * (F.col("m") - 1)))).alias("adev"))
    return taus_of.join(adev, ["sensor_id", "tau_s"], "left")


def oscillator_class(deviations: DataFrame) -> DataFrame:
    """(sensor_id, ratio, oscillator_class): last against first finite deviation; null below three."""
    listed = deviations.groupBy("sensor_id").agg(F.array_sort(F.collect_list(F.when(F.col("adev").isNotNull(), F.struct("tau_s", "adev")))).alias("a"))
    ratio = F.when((F.size("a") >= 3) & (F.col("a")[0]["adev"] > 0), F.element_at("a", -1)["adev"] / F.col("a")[0]["adev"])
    kind = F.when(F.col("ratio") < 0.7, "gps_locked").when(F.col("ratio") < 1.5, "crystal").when(F.col("ratio").isNotNull(), "degraded")
    return listed.withColumn("ratio", ratio).select("sensor_id", "ratio", kind.alias("oscillator_class"))


def topology(edge: DataFrame) -> DataFrame:
    """One row: num_sensors, num_edges, connectivity."""
    ends = edge.select(F.explode(F.array("sensor_i", "sensor_j")).alias("sensor_id"))
    counts = ends.groupBy("sensor_id").agg(F.count("*").alias("degree"))
    sizes = counts.agg(F.count("*").alias("num_sensors"), F.coalesce(F.sum("degree") / 2, F.lit(0)).cast("long").alias("num_edges"))
    n = F.col("num_sensors")
    possible = F.when(n <= 1, 1.0).otherwise(n * (n - 1) / 2.0)
    return sizes.withColumn("connectivity", F.col("num_edges") / possible)


def degrees(edge: DataFrame) -> DataFrame:
    return edge.select(F.explode(F.array("sensor_i", "sensor_j")).alias("sensor_id")).groupBy("sensor_id").agg(F.count("*").alias("degree"))


def topology_health(rms: Column, connectivity: Column, condition: Column) -> Column:
    return (
        F.when(condition > 1e8, "poor")
        .when((rms < 50) & (connectivity > 0.7), "excellent")
        .when((rms < 100) & (connectivity > 0.5), "good")
        .when((rms < 300) & (connectivity > 0.3), "marginal")
        .otherwise("poor")
    )


def status_step(state: Column, sigma: Column, degree: Column, empty_run: Column, degraded: Column | None = None) -> Column:
    """The next of six states. A sensor gets worse beyond one threshold and better only below a lower one; without
    edges it is given up after a run of solves, and comes back as marginal."""
    poor = (sigma > C.UNSTABLE_NS) | (F.lit(False) if degraded is None else degraded)
    weak = (degree < C.MIN_EDGES) | (sigma > C.MARGINAL_ENTER_NS)
    lost = (degree == 0) & (empty_run >= C.DISCONNECTED_AFTER)
    return (
        F.when(state == "disconnected", F.when(degree > 0, "marginal").otherwise("disconnected"))
        .when((state == "unknown") & (degree == 0), "unknown")
        .when((state != "unknown") & lost, "disconnected")
        .when(state == "unstable", F.when((sigma < C.UNSTABLE_EXIT_NS) & ~(F.lit(False) if degraded is None else degraded), "marginal").otherwise("unstable"))
        .when(poor, "unstable")
        .when(state == "marginal", F.when((degree >= C.MIN_EDGES) & (sigma < C.MARGINAL_EXIT_NS), "stable").otherwise("marginal"))
        .otherwise(F.when(weak, "marginal").otherwise("stable"))
    )


#: Rows of a sensor that are walked at once.
STATUS_BLOCK = 512
STATES = ("unknown", "stable", "marginal", "unstable", "disconnected")


def status_series(series: DataFrame) -> DataFrame:
    """series(sensor_id, timestamp_ns, sigma_ns, degree): adds status after each row.

    What a block of rows does to every state it may begin in (state, solves without edges so far) is worked out
    for all blocks at once; then only these short tables are walked from block to block, and each block again
    from the state it does begin in. So no row holds a sensor's whole history."""
    order = Window.partitionBy("sensor_id").orderBy("timestamp_ns", "sigma_ns", "degree")
    numbered = series.withColumn("_block", F.floor((F.row_number().over(order) - 1) / STATUS_BLOCK))
    listed = numbered.groupBy("sensor_id", "_block").agg(F.array_sort(F.collect_list(F.struct("timestamp_ns", "sigma_ns", "degree"))).alias("rows"))

    def walk(acc, r):
        empty = F.when(r["degree"] == 0, F.least(acc["empty"] + 1, F.lit(C.DISCONNECTED_AFTER))).otherwise(0)
        return F.struct(status_step(acc["state"], r["sigma_ns"], r["degree"], empty).alias("state"), empty.alias("empty"))

    starts = [F.struct(F.lit(s).alias("state"), F.lit(e).alias("empty")) for s in STATES for e in range(C.DISCONNECTED_AFTER + 1)]
    ends = F.array(*(F.aggregate("rows", s, walk) for s in starts))
    number = lambda s: (F.array_position(F.array(*map(F.lit, STATES)), s["state"]) - 1) * (C.DISCONNECTED_AFTER + 1) + s["empty"]
    tables = listed.select("sensor_id", "_block", F.transform(ends, lambda s: number(s).cast("int")).alias("to"))
    chain = tables.groupBy("sensor_id").agg(F.array_sort(F.collect_list(F.struct("_block", "to"))).alias("blocks"))
    came = F.aggregate("blocks", F.array(F.lit(0)), lambda acc, b: F.concat(acc, F.array(F.get(b["to"], F.element_at(acc, -1)))))
    begins = chain.select("sensor_id", F.posexplode(came).alias("_at", "_start")).select("sensor_id", F.col("_at").cast("long").alias("_block"), "_start")
    begun = listed.join(begins, ["sensor_id", "_block"]).withColumn("_from", F.get(F.array(*starts), F.col("_start")))
    out = F.struct(F.col("_from.state").alias("state"), F.col("_from.empty").alias("empty"), F.array().cast("array<string>").alias("all"))

    def keep(acc, r):
        after = walk(acc, r)
        return F.struct(after["state"].alias("state"), after["empty"].alias("empty"), F.concat(acc["all"], F.array(after["state"])).alias("all"))

    zipped = F.arrays_zip("rows", F.aggregate("rows", out, keep)["all"].alias("status"))
    return begun.select("sensor_id", F.explode(zipped).alias("z")).select("sensor_id", "z.rows.timestamp_ns", "z.rows.sigma_ns", "z.rows.degree", "z.status")


def statuses(series: DataFrame) -> DataFrame:
    """(sensor_id, status): the status after each sensor's last row."""
    last = F.max_by("status", F.struct("timestamp_ns", "sigma_ns", "degree")).alias("status")
    return status_series(series).groupBy("sensor_id").agg(last)


def corrected_times(frames: DataFrame, solutions: DataFrame) -> DataFrame:
    """frames(group_id, sensor_id, t_ns, ref_sensor, ref_t_ns), solutions(solve_ns, sensor_id, offset_ns,
    drift_ns_per_s): adds t_corrected. The solution used is the latest before the reference time, with
    drift for 120 s at most; the reference frame keeps its time, and without a solution the correction is 0."""
    latest = _latest(frames, solutions, "sensor_id", "own")
    both = _latest(latest, solutions, "ref_sensor", "ref")
    correction = F.round(F.coalesce(F.col("own") - F.col("ref"), F.lit(0.0))).cast("long")
    moved = F.greatest(F.lit(0).cast("long"), F.col("t_ns") - correction)
    return both.withColumn("t_corrected", F.when(F.col("sensor_id") == F.col("ref_sensor"), F.col("t_ns")).otherwise(moved))


def _latest(rows: DataFrame, solutions: DataFrame, by: str, name: str) -> DataFrame:
    """As-of join by a union and a running last value, so that neither side is multiplied."""
    mine = rows.withColumn("_k", F.col(by)).withColumn("_t", F.col("ref_t_ns")).withColumn("_s", F.lit(None).cast("struct<at: bigint, offset: double, drift: double>"))
    theirs = solutions.select(
        *(F.lit(None).cast(f.dataType).alias(f.name) for f in rows.schema.fields),
        F.col("sensor_id").alias("_k"),
        F.col("solve_ns").alias("_t"),
        F.struct(F.col("solve_ns").alias("at"), F.col("offset_ns").alias("offset"), F.col("drift_ns_per_s").alias("drift")).alias("_s"),
    )
    both = mine.withColumn("_own", F.lit(True)).unionByName(theirs.withColumn("_own", F.lit(False)))
    # Rows come before solutions of the same time, as a solution counts strictly later.
    order = Window.partitionBy("_k").orderBy("_t", F.desc("_own")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = both.withColumn("_f", F.last("_s", ignorenulls=True).over(order)).filter("_own")
    ahead = F.least(F.col("_t") - F.col("_f.at"), F.lit(C.MAX_EXTRAPOLATION_NS).cast("long")).cast("double") / 1e9
    value = F.col("_f.offset") + F.col("_f.drift") * ahead
    return found.withColumn(name, value).drop("_k", "_t", "_s", "_own", "_f")
