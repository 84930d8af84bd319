import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from skylattice import consts as C
from skylattice.operators import clock, network
from skylattice.solvers import linear


def automaton(rows):
    """The status after each (sigma, degree)."""
    state, empty, out = "unknown", 0, []
    for sigma, degree in rows:
        empty = empty + 1 if degree == 0 else 0
        bad, weak = sigma > 500, degree < 2 or sigma > 350
        if state != "unknown" and state != "disconnected" and degree == 0 and empty >= 3:
            state = "disconnected"
        elif state == "unknown":
            state = "unknown" if degree == 0 else "unstable" if bad else "marginal" if weak else "stable"
        elif state == "stable":
            state = "unstable" if bad else "marginal" if weak else "stable"
        elif state == "marginal":
            state = "unstable" if bad else "stable" if degree >= 2 and sigma < 200 else "marginal"
        elif state == "unstable":
            state = "marginal" if sigma < 400 else "unstable"
        elif degree > 0:
            state = "marginal"
        out.append(state)
    return out


def test_statuses_across_blocks(spark, monkeypatch):
    monkeypatch.setattr(clock, "STATUS_BLOCK", 7)
    r = random.Random(4)
    rows = [(s, t, r.choice([100.0, 250.0, 380.0, 450.0, 600.0]), r.choice([0, 0, 0, 1, 2, 3])) for s in range(3) for t in range(60)]
    df = spark.createDataFrame(rows, "sensor_id long, timestamp_ns long, sigma_ns double, degree int")
    got = {(x["sensor_id"], x["timestamp_ns"]): x["status"] for x in clock.status_series(df).collect()}
    want = {}
    for s in range(3):
        for t, state in enumerate(automaton([x[2:] for x in rows if x[0] == s])):
            want[s, t] = state
    assert got == want and set(want.values()) == set(clock.STATES)
    last = {x["sensor_id"]: x["status"] for x in clock.statuses(df).collect()}
    assert last == {s: want[s, 59] for s in range(3)}
    assert clock.statuses(df.limit(0)).collect() == []


def test_gate_keeps_the_line_and_drops_what_is_off_it(spark):
    r = np.random.default_rng(2)
    t = np.arange(80, dtype=np.int64) * 1_000_000_000
    e = 300 + 2.0 * np.arange(80) + r.normal(size=80) * 10
    e[[3, 40, 60]] += [1500, 900, -900]
    taken, kept = network.gate(t, e)
    half, before = network.gate(t[:33], e[:33])
    assert (np.concatenate([half, network.gate(t[33:], e[33:], kept=before)[0]]) == taken).all() and len(kept[0]) == C.PAIR_SAMPLES
    assert not taken[[3, 40, 60]].any() and taken.sum() == 77
    rows = [(1, 2, int(a), float(b)) for a, b in zip(t, e)] + [(1, 3, 5, 7.0)]
    df = spark.createDataFrame(rows, "sensor_i long, sensor_j long, timestamp_ns long, residual_ns double")
    found = network.gated(df).filter("accepted")
    state = {x["sensor_j"]: x for x in network.pair_states(found).collect()}
    assert state[2]["sample_count"] == C.PAIR_SAMPLES and state[2]["slope_ns_per_s"] == pytest.approx(2, abs=0.3) and state[2]["mad_ns"] < 30
    assert state[3]["sample_count"] == 1
    wanted = spark.createDataFrame(
        [(1, 2, 80_000_000_000), (2, 1, 80_000_000_000), (1, 2, 200_000_000_000), (1, 3, 6), (4, 5, 0)], "sensor_id long, ref_sensor long, at_ns long"
    )
    got = {(x[0], x[1], x[2]): x["pair_offset_ns"] for x in network.pair_offsets(wanted, network.pair_states(found)).collect()}
    assert got[1, 2, 80_000_000_000] == pytest.approx(460, abs=30) and got[2, 1, 80_000_000_000] == -got[1, 2, 80_000_000_000]
    assert got[1, 2, 200_000_000_000] == got[1, 3, 6] == got[4, 5, 0] == 0


def test_network_solve_finds_offsets(spark):
    """Three sensors with known offsets and some noise: deviations below 100 ns, all stable at the end."""
    r = random.Random(1)
    true = {1: 0.0, 2: 140.0, 3: -80.0}
    rows = []
    for k in range(400):
        i, j = r.choice([(1, 2), (1, 3), (2, 3), (3, 1)])
        rows.append((0, i, j, k * 75_000_000, true[i] - true[j] + r.uniform(-5, 5), 2.0))
    obs = spark.createDataFrame(rows, "network int, sensor_i long, sensor_j long, timestamp_ns long, residual_ns double, weight double")
    sensors = spark.createDataFrame([(1, 0.0, 0.0, 0.0), (2, 3e4, 4e4, 0.0)], "sensor_id long, x double, y double, z double")
    found = network.network_solve(obs, sensors)
    at = 30_000_000_000
    last = {x["sensor_id"]: x for x in found["sensors"].filter(F.col("solve_ns") == at).collect()}
    for s, offset in true.items():
        assert last[s]["offset_ns"] == pytest.approx(offset, abs=5) and last[s]["uncertainty_ns"] < 100 and last[s]["status"] == "stable"
    edges = {(x["sensor_i"], x["sensor_j"]): x for x in found["edges"].filter(F.col("solve_ns") == at).collect()}
    assert edges[1, 2]["baseline_m"] == 5e4 and edges[1, 3]["baseline_m"] == 0 and abs(edges[1, 2]["residual_ns"]) < 5
    topology = found["topology"].filter(F.col("solve_ns") == at).first()
    assert topology["connectivity"] == 1 and topology["num_edges"] == 3 and topology["global_rms_ns"] < 5 and topology["health"] == "excellent"
    assert found["topology"].filter("solve_ns > 120000000000").count() == 0
    assert network.network_solve(obs.limit(0), sensors)["topology"].count() == 0


def test_network_solve_equals_each_window_by_itself(spark):
    """Few observations, so many windows hold the same ones; the first are a nanosecond after a solve, at it, and a
    window before one, at times where a double's last place is over a hundred nanoseconds."""
    r, day, step = random.Random(6), 1_704_067_200_000_000_000, C.SOLVE_EVERY_NS
    rows = [(1, 1, 2, day + 1, 40.0, 1.0), (1, 2, 3, day, 7.0, 2.0), (2, 4, 5, day - 1, 9.0, 1.0)]
    for _ in range(60):
        i, k = r.sample(range(6), 2)
        rows.append((3, 10 + i, 10 + k, day + r.randrange(600) * 1_000_000_000 + r.randrange(3), r.uniform(-900, 900), r.choice([0.0, 0.5, 1.0, 4.0])))
    obs = spark.createDataFrame(rows, "network int, sensor_i long, sensor_j long, timestamp_ns long, residual_ns double, weight double")
    sensors = spark.createDataFrame([(1, 0.0, 0.0, 0.0)], "sensor_id long, x double, y double, z double")
    found = network.network_solve(obs, sensors)
    offsets, shapes, degrees = {}, {}, {}
    for net in (1, 2, 3):
        for at in range(day // step * step, day + 700 * 10**9, step):
            sums = {}
            for n, i, k, t, e, w in rows:
                if n == net and w > 0 and 0 <= at - t <= C.DRIFT_WINDOW_NS:
                    a = sums.setdefault((min(i, k), max(i, k)), [0.0, 0.0])
                    a[0] += w * (e if i < k else -e)
                    a[1] += w
            if not sums:
                continue
            pairs = sorted(sums)
            mean = np.array([sums[p][0] / sums[p][1] for p in pairs])
            solved = linear.solve_clocks(pairs, mean, np.array([sums[p][1] for p in pairs]))
            if solved:
                left = [m - (solved[0][i] - solved[0][k]) for (i, k), m in zip(pairs, mean)]
                shapes[net, at] = (len(pairs), len(solved[0]), float(np.sqrt(np.mean(np.square(left)))), solved[2])
                offsets |= {(net, at, s): (solved[0][s], solved[1][s]) for s in solved[0]}
                degrees |= {(net, at, s): sum(s in p for p in pairs) for s in solved[0]}
    topology = {(x["network"], x["solve_ns"]): (x["num_edges"], x["num_sensors"], x["global_rms_ns"], x["condition_number"]) for x in found["topology"].collect()}
    assert topology.keys() == shapes.keys() and all(topology[k] == pytest.approx(shapes[k], rel=1e-6, abs=1e-6) for k in shapes)
    got = {(x["network"], x["solve_ns"], x["sensor_id"]): x for x in found["sensors"].collect()}
    assert got.keys() == offsets.keys() and all((x["offset_ns"], x["uncertainty_ns"]) == pytest.approx(offsets[k], rel=1e-6, abs=1e-6) for k, x in got.items())
    assert {k: x["degree"] for k, x in got.items()} == degrees
    assert found["edges"].count() == sum(x[0] for x in shapes.values())
    runs = network.same_windows(clock.oriented(obs), step, C.DRIFT_WINDOW_NS, "network").select("network", "start_ns", "end_ns").distinct()
    assert runs.count() < len(shapes) / 2


def test_networks_solved_together_equal_each_alone():
    r = np.random.default_rng(8)
    ends = [(1, 2), (1, 3), (2, 3), (2, 4), (3, 4)]
    i, k = (np.array([[p[x] * 3 + n for p in ends] for n in range(40)]) for x in (0, 1))
    e, w = r.normal(size=i.shape) * 300, r.uniform(0.5, 8, size=i.shape)
    for weights in (w, np.where(np.arange(40)[:, None] == 7, -w, w)):
        good, ids, theta, sigma, kappa = linear.solve_clock_rows(i, k, e, weights)
        alone = [linear.solve_clocks(list(zip(i[n].tolist(), k[n].tolist())), e[n], weights[n]) for n in range(40)]
        assert good.tolist() == [n for n in range(40) if alone[n]]
        for row, n in enumerate(good):
            assert alone[n][0] == pytest.approx(dict(zip(ids[row].tolist(), theta[row])), rel=1e-9)
            assert alone[n][1] == pytest.approx(dict(zip(ids[row].tolist(), sigma[row])), rel=1e-9) and alone[n][2] == pytest.approx(kappa[row])


def test_an_inverse_that_fails_leaves_the_offsets(monkeypatch):
    def fail(_):
        raise np.linalg.LinAlgError

    monkeypatch.setattr(linear.np.linalg, "inv", fail)
    offsets, sigma, kappa = linear.solve_offsets([(1, 2), (2, 3)], np.array([10.0, 5.0]), np.array([1.0, 1.0]))
    assert offsets[2] == pytest.approx(-10, abs=1e-3) and sigma[3] == 500 and kappa == float("inf")


def test_a_track_begins_from_a_solution():
    k = linear.Kalman.begun(np.array([6.385e6, 0.0, 0.0]), np.eye(3) * 400.0, 7)
    point, cov = k.prior()
    assert point.tolist() == [6.385e6, 0, 0] and cov[0, 0] == 400 and k.p[4, 4] == 2500 and k.last_ns == 7
    assert k.step(np.array([6.385e6 + 10, 0.0, 0.0]), 100.0, 1_000_000_007) and 0 < k.x[0] - 6.385e6 < 10
