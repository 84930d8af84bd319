import random

import numpy as np
import xxhash

from skylattice.llm import simhash


def brute_fp(text, k):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    pieces = [b" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))]
    hashes = [xxhash.xxh64_intdigest(p, 42) for p in pieces]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def corpus(seed):
    r = random.Random(seed)
    words = ["".join(r.choice("abcdeéßZ") for _ in range(r.randint(1, 6))) for _ in range(200)]
    base = [" ".join(r.choices(words, k=r.randint(80, 200))) for _ in range(12)]
    rows = []
    for i in range(150):
        w = r.choice(base).split()
        for _ in range(r.choice([0, 0, 1, 2, 4])):
            w[r.randrange(len(w))] = r.choice(words)
        rows.append((i, r.choice([" ", "\n", "\t "]).join(w)))
    return rows + [(500, None), (501, ""), (502, " \n"), (503, "one"), (504, "ONE"), (505, "a b"), (506, "a b c"), (507, "x y z w")]


def brute(rows, k, distance):
    fps = [brute_fp(t, k) for _, t in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= distance:
                parent[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[root(i)] = min(least.get(root(i), d), d)
    return sorted((rows[i][0], fps[i], least[root(i)]) for i in range(len(rows)))


def test_equals_brute_force(spark):
    rows = corpus(1)
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, fp string")
    found = simhash.near_duplicates(df, 3, 3).collect()
    assert sorted((r[0], r[1] % (1 << 64), r[2]) for r in found) == brute(rows, 3, 3)


def test_large_buckets_are_tiled(spark, monkeypatch):
    monkeypatch.setattr(simhash, "TILE", 10)
    r = random.Random(4)
    base = r.getrandbits(64)
    fps = {base}
    while len(fps) < 120:
        fps.add(r.choice(sorted(fps)) ^ (1 << r.randrange(64)) ^ (1 << r.randrange(64)))
    values = sorted(fps)
    signed = [(int(np.uint64(x).astype(np.int64)),) for x in values]
    from skylattice.llm.graph import components

    edges = simhash.fingerprint_links(spark.createDataFrame(signed, "fp long"), 3)
    found = {n: c for n, c in components(edges).collect()}
    groups = {}
    for (s,), x in zip(signed, values):
        groups.setdefault(found.get(s, s), set()).add(x)
    parent = {x: x for x in values}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for x in values:
        for y in values:
            if bin(x ^ y).count("1") <= 3:
                parent[root(x)] = root(y)
    want = {}
    for x in values:
        want.setdefault(root(x), set()).add(x)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, want.values()))


def test_keeps_first_of_a_group_and_columns(spark):
    text = " ".join(f"w{i}" for i in range(60))
    df = spark.createDataFrame([(1, text, "a"), (2, text, "b"), (3, "else " + text[::-1], "c")], "doc_id long, text string, component_id string")
    kept = simhash.drop_near_duplicates(df)
    assert kept.columns == df.columns and sorted(r[0] for r in kept.collect()) == [1, 3]
    assert simhash.near_duplicates(df.limit(0)).collect() == []
