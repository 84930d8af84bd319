import numpy as np

from skylattice import consts as C
from skylattice.operators import solve, tracks, training


def test_odd_tracks_are_odd_in_their_way(spark):
    rows = {x["key"]: x for x in training.synthetic_tracks(spark, 40, 40).collect()}
    assert [sum(x["kind"] == k for x in rows.values()) for k in training.KINDS] == [40, 10, 10, 10, 10]
    for x in rows.values():
        s = np.array(x["states"])
        steps = np.diff(s[:, :3], axis=0)
        assert s.shape == (20, 8) and len(set(s[:, 6])) == 20 and (s[:, 7] >= 500).all() == (x["label"] == 1)
        if x["kind"] == "normal":
            assert np.allclose(steps, 0.1 * s[:-1, 3:6])
        elif x["kind"] == "flip":
            assert np.allclose(np.abs(s[:, 3:5]), np.abs(s[0, 3:5])) and (s[-1, 3:5] == -s[0, 3:5]).all() and np.allclose(steps[:, :2], 0.1 * s[0, 3:5]) and len(set(s[:, 5])) == 1
        elif x["kind"] == "frozen":
            assert (steps[-5:, :2] == 0).all() and np.allclose(steps[:, 2], 0.1 * s[0, 5])
        elif x["kind"] == "jump":
            shift = steps[:, :2].max(axis=0) - 0.1 * s[0, 3:5]
            assert (shift > 0.019).all() and shift[0] != shift[1]
        else:
            assert steps[:, 2].max() > 1900 and np.allclose(steps[:, :2], 0.1 * s[0, 3:5])


def test_models_are_kept(spark, tmp_path):
    weights = solve.small_weights()
    training.save_model(spark, weights, [1.0] * 8, [2.0] * 8, f"{tmp_path}/model")
    got, mean, std = training.load_model(spark, f"{tmp_path}/model")
    assert mean == [1.0] * 8 and std == [2.0] * 8
    histories = training.synthetic_tracks(spark, 5, 5).select("key", "states")
    same = [sorted(map(tuple, solve.labels(histories, w, mean, std).collect())) for w in (weights, got)]
    assert same[0] == same[1]
    none, mean, std = training.load_model(spark, f"{tmp_path}/nothing")
    assert none is None and {x["label"] for x in solve.labels(histories, none, mean, std).collect()} == {"unknown"}


def test_when_a_track_is_labelled(spark):
    second = 1_000_000_000
    times = [0, 1, 2, 3, 4, 5, 9, 9.5, 20]
    df = spark.createDataFrame([("A", int(t * second)) for t in times] + [("B", 0)], "icao24 string, t_ns long")
    assert sorted((x[0], x[1] / second) for x in tracks.classify_due(df).collect()) == [("A", 4), ("A", 9.5), ("A", 20)]
    assert C.CLASSIFY_STATES == 5
