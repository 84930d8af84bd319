import numpy as np

from skylattice.llm import embedding_dedup


def brute(rows, threshold):
    ids = [r[0] for r in rows]
    ok = []
    for _, v, label in rows:
        good = label is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)
        ok.append(np.array(v, dtype=float) if good else None)
    n = len(rows)
    links, parent = [0] * n, list(range(n))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(n):
        for j in range(i + 1, n):
            a, b = ok[i], ok[j]
            if a is None or b is None or len(a) != len(b) or rows[i][2] != rows[j][2]:
                continue
            if a @ b / np.sqrt((a @ a) * (b @ b)) >= threshold:
                links[i] += 1
                links[j] += 1
                parent[root(j)] = root(i)
    least = {}
    for i in range(n):
        least[root(i)] = min(least.get(root(i), ids[i]), ids[i])
    return sorted((ids[i], links[i], least[root(i)], ids[i] == least[root(i)]) for i in range(n))


def vectors(seed, n=260, dim=16):
    r = np.random.default_rng(seed)
    rows = []
    centres = r.normal(size=(6, dim))
    for i in range(n):
        v = centres[i % 6] + r.normal(size=dim) * r.choice([0.05, 0.15, 0.3, 1])
        rows.append((i, [float(np.float32(x)) for x in v], int(i % 3)))
    rows += [(900 + i, rows[5][1], rows[5][2]) for i in range(8)]
    rows += [(950, [2 * x for x in rows[5][1]], rows[5][2]), (960, rows[5][1], None), (961, None, 1), (962, [], 1), (963, [0.0] * dim, 1)]
    rows += [(964, [float("nan")] + [1.0] * (dim - 1), 1), (965, [float("inf")] + [1.0] * (dim - 1), 1), (966, [None] + [1.0] * (dim - 1), 1), (967, [1.0] * 4, 1)]
    return rows


def test_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "TILE", 40)
    rows = vectors(1)
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<float>, label int, kept string")
    assert sorted(map(tuple, embedding_dedup.near_duplicates(df, 0.98).collect())) == brute(rows, 0.98)


def test_empty(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<double>, label int")
    assert embedding_dedup.near_duplicates(df).collect() == []


def test_bounds_hold():
    v = np.random.default_rng(3).normal(size=(80, 24))
    every = np.arange(80)
    unit = v / np.linalg.norm(v, axis=1)[:, None]
    assert (embedding_dedup.linked(v, every, every, 0.2) == (unit @ unit.T >= 0.2)).all()
