"""The clock chain as a whole: eligible beacons, gated samples of pairs, fallback offsets and variances, and the
solve of a network at a series of times."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skylattice import consts as C
from skylattice.functions import geo
from skylattice.operators import clock, solve
from skylattice.staging import drop_stage, stage

PAIR = ["sensor_i", "sensor_j"]


def eligible_beacons(groups: DataFrame, least_nuc: int = C.BEACON_NUC, least: int = 2) -> DataFrame:
    """groups(frames, nuc): those whose claimed position is good enough to calibrate clocks."""
    return groups.filter((F.size("frames") >= least) & (F.col("nuc") >= least_nuc))


def line_fit(t: np.ndarray, e: np.ndarray) -> tuple[float, float]:
    """(slope, value at t = 0) of a least-squares line; level where all t are equal."""
    if len(t) < 2 or np.ptp(t) == 0:
        return 0.0, float(e.mean())
    off = t - t.mean()
    slope = float((off * e).sum() / (off * off).sum())
    return slope, float(e.mean() - slope * t.mean())


def gate(times: np.ndarray, residuals: np.ndarray, samples: int = C.PAIR_SAMPLES, kept: tuple[np.ndarray, np.ndarray] | None = None) -> tuple[np.ndarray, tuple[np.ndarray, np.ndarray]]:
    """Which of one pair's samples, in order of time, are taken: within three deviations of the line through the
    last taken ones; within a microsecond of their mean while there are two to four; all before that. kept: the
    samples (times, residuals) taken before; those kept after are returned too."""
    taken = np.zeros(len(times), dtype=bool)
    kept_t, kept_e = kept if kept else (np.empty(0, dtype=np.int64), np.empty(0))
    for k, (t, e) in enumerate(zip(times, residuals)):
        if len(kept_t) >= 5:
            seconds = (kept_t - t) / 1e9
            slope, now = line_fit(seconds, kept_e)
            off = np.sort(np.abs(kept_e - now - slope * seconds))
            fits = abs(e - now) <= 3.0 * max(float(off[len(off) // 2]), C.MAD_FLOOR_NS)
        else:
            fits = len(kept_t) < 2 or abs(e - kept_e.mean()) <= C.WARM_UP_GATE_NS
        if fits:
            taken[k] = True
            kept_t, kept_e = np.append(kept_t, t)[-samples:], np.append(kept_e, e)[-samples:]
    return taken, (kept_t, kept_e)


def gated(obs: DataFrame) -> DataFrame:
    """obs(sensor_i, sensor_j, timestamp_ns, residual_ns), oriented: adds accepted. Whether a sample is taken depends
    on those taken before, so one pair's samples are walked in order; a group grows with one pair's."""
    schema = "sensor_i long, sensor_j long, timestamp_ns long, residual_ns double, accepted boolean"

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["timestamp_ns", "residual_ns"], kind="stable")
        return pdf.assign(accepted=gate(pdf["timestamp_ns"].to_numpy(), pdf["residual_ns"].to_numpy())[0])

    return obs.select(*PAIR, "timestamp_ns", "residual_ns").groupBy(*PAIR).applyInPandas(walk, schema)


def pair_states(taken: DataFrame, samples: int = C.PAIR_SAMPLES) -> DataFrame:
    """The last samples of each pair as a line: (sensor_i, sensor_j, sample_count, last_ns, slope_ns_per_s, offset_ns
    at last_ns, mad_ns)."""
    order = Window.partitionBy(*PAIR).orderBy(F.desc("timestamp_ns"), "residual_ns")
    last = taken.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= samples)
    listed = last.groupBy(*PAIR).agg(F.max("timestamp_ns").alias("last_ns"), F.collect_list(F.struct("timestamp_ns", "residual_ns")).alias("s"))
    rows = listed.select(*PAIR, "last_ns", F.explode("s").alias("s")).select(
        *PAIR, "last_ns", F.col("s.residual_ns").alias("e"), ((F.col("s.timestamp_ns") - F.col("last_ns")).cast("double") / 1e9).alias("t")
    )
    fit = rows.groupBy(*PAIR, "last_ns").agg(
        F.count("*").alias("sample_count"),
        F.coalesce(F.regr_slope("e", "t"), F.lit(0.0)).alias("slope_ns_per_s"),
        F.coalesce(F.regr_intercept("e", "t"), F.avg("e")).alias("offset_ns"),
        F.collect_list(F.struct("t", "e")).alias("s"),  # `samples` at most
    )
    off = F.array_sort(F.transform("s", lambda s: F.abs(s["e"] - F.col("offset_ns") - F.col("slope_ns_per_s") * s["t"])))
    return fit.withColumn("mad_ns", F.get(off, F.floor(F.size("s") / 2).cast("int"))).drop("s")


def _paired(wanted: DataFrame, a: str, b: str, states: DataFrame) -> DataFrame:
    """wanted with the state of its pair, and _sign, which turns the pair's offset into that of a less b."""
    named = states.select(
        F.col("sensor_i").alias("_i"), F.col("sensor_j").alias("_j"),
        *(F.col(c).alias(f"_{c}") for c in ("sample_count", "last_ns", "slope_ns_per_s", "offset_ns", "mad_ns")),
    )
    joined = wanted.join(named, (F.least(a, b) == F.col("_i")) & (F.greatest(a, b) == F.col("_j")), "left")
    return joined.withColumn("_sign", F.when(F.col(a) > F.col(b), -1.0).otherwise(1.0))


_STATE = ("_i", "_j", "_sample_count", "_last_ns", "_slope_ns_per_s", "_offset_ns", "_mad_ns", "_sign")


def pair_offsets(wanted: DataFrame, states: DataFrame) -> DataFrame:
    """wanted(sensor_id, ref_sensor, at_ns): adds pair_offset_ns, sensor less reference, by the pair's line if it has
    two samples at least and the last one is less than 30 s old; 0 otherwise."""
    joined = _paired(wanted, "sensor_id", "ref_sensor", states)
    age = F.greatest(F.lit(0).cast("long"), F.col("at_ns") - F.col("_last_ns"))
    valid = (F.col("_sample_count") >= 2) & (age < C.PAIR_VALIDITY_NS)
    at = F.col("_offset_ns") + F.col("_slope_ns_per_s") * (F.col("at_ns") - F.col("_last_ns")).cast("double") / 1e9
    return joined.withColumn("pair_offset_ns", F.coalesce(F.when(valid, F.col("_sign") * at), F.lit(0.0))).drop(*_STATE)


def pair_variances(wanted: DataFrame, states: DataFrame, solution: DataFrame | None = None) -> DataFrame:
    """wanted(sensor_i, sensor_j): adds pair_variance_ns2. With a solution(sensor_id, uncertainty_ns) the squares of
    both uncertainties (300 ns where a sensor has none); without one that of the pair's deviation if it has two
    samples; else the default."""
    if solution is not None:
        out = wanted
        for k in "ij":
            side = solution.select(F.col("sensor_id").alias(f"_s{k}"), F.col("uncertainty_ns").alias(f"_u{k}"))
            out = out.join(side, F.col(f"sensor_{k}") == F.col(f"_s{k}"), "left")
        square = lambda k: F.pow(F.coalesce(f"_u{k}", F.lit(C.DEFAULT_SIGMA_NS)), F.lit(2.0))
        return out.withColumn("pair_variance_ns2", square("i") + square("j")).drop("_si", "_sj", "_ui", "_uj")
    joined = _paired(wanted, "sensor_i", "sensor_j", states)
    sigma = F.greatest(F.col("_mad_ns"), F.lit(C.MAD_FLOOR_NS)) / C.MAD_TO_SIGMA
    found = F.when(F.col("_sample_count") >= 2, sigma * sigma)
    return joined.withColumn("pair_variance_ns2", F.coalesce(found, F.lit(C.DEFAULT_PAIR_VARIANCE_NS2))).drop(*_STATE)


def with_baselines(edges: DataFrame, sensors: DataFrame) -> DataFrame:
    """edges with baseline_m from sensors(sensor_id, x, y, z); 0 where a sensor isn't known."""
    out = edges
    for k in "ij":
        out = out.join(sensors.select(F.col("sensor_id").alias(f"sensor_{k}"), *(F.col(a).alias(f"_{k}{a}") for a in "xyz")), f"sensor_{k}", "left")
    d = geo.distance(tuple(F.col(f"_i{a}") for a in "xyz"), tuple(F.col(f"_j{a}") for a in "xyz"))
    return out.withColumn("baseline_m", F.coalesce(d, F.lit(0.0))).select(*edges.columns, "baseline_m")


def edge_residuals(edges: DataFrame, offsets: DataFrame, by: list[str] | None = None) -> DataFrame:
    """edges with residual_ns: what the solved offsets(by, sensor_id, offset_ns) leave of the mean; sensors without
    an offset have 0."""
    by = by or []
    out = edges
    for k in "ij":
        out = out.join(offsets.select(*by, F.col("sensor_id").alias(f"sensor_{k}"), F.col("offset_ns").alias(f"_o{k}")), [*by, f"sensor_{k}"], "left")
    left = F.col("mean_residual_ns") - (F.coalesce("_oi", F.lit(0.0)) - F.coalesce("_oj", F.lit(0.0)))
    return out.withColumn("residual_ns", left).select(*edges.columns, "residual_ns")


def global_rms(residuals: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(by, global_rms_ns): the root of the mean square of residual_ns; 0 without edges."""
    rms = F.coalesce(F.sqrt(F.avg(F.col("residual_ns") * F.col("residual_ns"))), F.lit(0.0)).alias("global_rms_ns")
    return residuals.groupBy(*(by or [])).agg(rms)


def calibrated_count(statuses: DataFrame, now_ns: Column | int) -> DataFrame:
    """One row, n_calibrated: sensors of statuses(sensor_id, status, solve_ns) that are stable or marginal by a solve
    of the last 120 s."""
    now = F.lit(now_ns) if isinstance(now_ns, int) else now_ns
    return statuses.agg(F.count_if(F.col("status").isin("stable", "marginal") & (now - F.col("solve_ns") <= C.MAX_EXTRAPOLATION_NS)).alias("n_calibrated"))


def same_windows(obs: DataFrame, every_ns: int, window_ns: int, by: str) -> DataFrame:
    """obs(by, timestamp_ns): a row for each run of solves (start_ns to end_ns, multiples of every_ns) whose windows hold
    the observation and differ in no other of its network. A window holds what is at most window_ns before its solve."""
    t = F.col("timestamp_ns")
    down = lambda c: c - F.pmod(c, F.lit(every_ns).cast("long"))
    o = obs.filter(F.col(by).isNotNull()).withColumns({"_first": down(t + (every_ns - 1)), "_last": down(t + window_ns)}).filter("_first <= _last")
    kinds = o.select(by, "_first", "_last").distinct()
    changes = kinds.select(by, F.explode(F.array(F.col("_first"), F.col("_last") + every_ns)).alias("start_ns")).distinct()
    runs = changes.withColumn("end_ns", F.lead("start_ns").over(Window.partitionBy(by).orderBy("start_ns")) - every_ns)
    at = F.explode(F.sequence("_first", "_last", F.lit(every_ns).cast("long"))).alias("start_ns")
    held = kinds.select(by, "_first", "_last", at).join(runs, [by, "start_ns"])
    return o.join(held, [by, "_first", "_last"]).drop("_first", "_last")


def network_solve(obs: DataFrame, sensors: DataFrame, every_ns: int = C.SOLVE_EVERY_NS, window_ns: int = C.DRIFT_WINDOW_NS, by: str = "network") -> dict[str, DataFrame]:
    """The solve of each network at each multiple of every_ns that has observations in the window up to it. Solves whose
    windows hold the same observations are one, worked out once; networks of one shape are solved together.

    obs(by, sensor_i, sensor_j, timestamp_ns, residual_ns, weight), sensors(sensor_id, x, y, z). Tables: edges (with
    baseline_m and residual_ns), sensors (offset, uncertainty, drift, status), topology (one row for each solve, with
    global_rms_ns, connectivity, condition_number and health) and deviations (Allan deviation and oscillator class of
    a sensor over all solves). A solve without edges, or that fails, gives no rows, so the last one stays in force."""
    keys, run = [by, "solve_ns"], [by, "start_ns", "end_ns"]
    own = stage(clock.oriented(obs.select(by, *PAIR, "timestamp_ns", "residual_ns", "weight")), "network-obs")
    edges = with_baselines(clock.edges(same_windows(own, every_ns, window_ns, by), run), sensors)
    fields = [*PAIR, "mean_residual_ns", "total_weight", "obs_count", "mad_ns", "baseline_m"]
    listed = edges.groupBy(*run).agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("edges"))
    found = stage(solve.clock_rows(listed), "network-solves")
    drop_stage(own)
    each = found.withColumn("solve_ns", F.explode(F.sequence("start_ns", "end_ns", F.lit(every_ns).cast("long"))))
    left = each.select(*keys, F.explode(F.arrays_zip("edges", "residuals")).alias("e")).select(*keys, "e.edges.*", F.col("e.residuals").alias("residual_ns"))
    offsets = each.select(*keys, F.explode("solved").alias("s"), "condition_number").select(*keys, "s.*", "condition_number")
    rows = clock.drift(offsets.withColumn("timestamp_ns", F.col("solve_ns")), window_ns).drop("timestamp_ns")
    series = rows.select("sensor_id", F.col("solve_ns").alias("timestamp_ns"), F.col("uncertainty_ns").alias("sigma_ns"), "degree")
    status = clock.status_series(series).select("sensor_id", F.col("timestamp_ns").alias("solve_ns"), "status")
    deviations = clock.allan_deviation(offsets.select("sensor_id", F.col("solve_ns").alias("timestamp_ns"), "offset_ns"))
    n = F.col("num_sensors")
    topology = each.select(*keys, F.size("edges").cast("long").alias("num_edges"), "condition_number", F.size("solved").cast("long").alias("num_sensors"), "global_rms_ns")
    topology = topology.withColumn("connectivity", F.col("num_edges") / F.when(n > 1, n * (n - 1) / 2.0).otherwise(1.0))
    topology = topology.withColumn("health", clock.topology_health(F.col("global_rms_ns"), F.col("connectivity"), F.col("condition_number")))
    return {
        "edges": left,
        "sensors": rows.join(status, ["sensor_id", "solve_ns"]).select(*keys, "sensor_id", "offset_ns", "uncertainty_ns", "drift_ns_per_s", "degree", "status"),
        "topology": topology,
        "deviations": deviations.join(clock.oscillator_class(deviations), "sensor_id"),
    }


def prior_sigma(nuc: Column) -> Column:
    """Standard deviation, in metres, of a claimed position of that category; null below the least one."""
    out = F.lit(None).cast("double")
    for n, sigma in C.NUC_SIGMA_M.items():
        out = F.when(nuc == n, F.lit(sigma)).otherwise(out)
    return out


def priors(rows: DataFrame) -> DataFrame:
    """rows(track_prior, track_cov or null; claim_x, claim_y, claim_z, nuc or null): adds prior and prior_cov: those of
    the track, else the claimed position with the deviation of its category, else null."""
    sigma = prior_sigma(F.col("nuc"))
    claim = F.when(sigma.isNotNull() & F.col("claim_x").isNotNull(), F.array("claim_x", "claim_y", "claim_z"))
    spread = F.when(sigma.isNotNull() & F.col("claim_x").isNotNull(), F.array(*(sigma * sigma if i % 4 == 0 else F.lit(0.0) for i in range(9))))
    return rows.withColumn("prior", F.coalesce("track_prior", claim)).withColumn("prior_cov", F.coalesce("track_cov", spread))

