import random

import corpus_pipeline
from skylattice.llm import similar, simhash


def sets_of(text, k=5):
    words = (text or "").encode().lower().split()
    return {b" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))} if words else set()


def brute(rows, t=0.8):
    found = [(d, sets_of(x)) for d, x in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, (_, a) in enumerate(found):
        for j, (_, b) in enumerate(found[:i]):
            if (not a and not b) or (a | b and len(a & b) / len(a | b) >= t):
                parent[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[root(i)] = min(least.get(root(i), d), d)
    return sorted((rows[i][0], least[root(i)]) for i in range(len(rows)))


def corpus(seed):
    r = random.Random(seed)
    words = ["".join(r.choice("abcdeéßZ") for _ in range(r.randint(1, 6))) for _ in range(200)]
    passage = " ".join(r.choices(words, k=30))
    base = [" ".join(r.choices(words, k=r.randint(30, 200))) for _ in range(12)]
    rows = []
    for i in range(200):
        w = r.choice(base).split()
        for _ in range(r.choice([0, 1, 2, 3, 4, 6])):
            w[r.randrange(len(w))] = r.choice(words)
        rows.append((i, " ".join(w + passage.split() * (i % 3 == 0))))
    return rows + [(500, None), (501, ""), (502, " \n"), (503, "one"), (504, "ONE"), (505, "a b c d e"), (506, "a b c d e f")]


def test_equals_brute_force(spark, monkeypatch):
    rows = corpus(1)
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, id string")
    want = brute(rows)
    assert sorted(map(tuple, similar.near_duplicates(df).collect())) == want
    monkeypatch.setattr(similar, "TILE", 7)
    assert sorted(map(tuple, similar.near_duplicates(df).collect())) == want


def test_limit_itself_counts(spark):
    words = [f"w{i}" for i in range(39)]
    rows = [(1, " ".join(words)), (2, " ".join(words[:32])), (3, " ".join(words[:31]) + " x"), (4, " ".join(words[8:]))]
    assert similar.near_duplicates(spark.createDataFrame(rows[:2], "doc_id long, text string")).collect()[1][1] == 1
    found = similar.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(tuple, found)) == brute(rows)


def test_the_pipeline_stage_drops_copies_of_lower_similarity(spark):
    r = random.Random(3)
    words = [f"{r.getrandbits(40):x}" for _ in range(120)]
    other = [*words[:40], "changed", *words[41:80], "again", *words[81:]]
    assert 0.8 <= len(sets_of(" ".join(words)) & sets_of(" ".join(other))) / len(sets_of(" ".join(words)) | sets_of(" ".join(other))) < 0.9
    df = spark.createDataFrame([(1, " ".join(words), "a"), (2, " ".join(other), "b"), (3, "else", "c"), (None, "else", "d")], "doc_id long, text string, s string")
    kept = corpus_pipeline.distinct_documents(spark, df, "")
    assert kept.columns == df.columns and sorted((x[0] or 0, x[2]) for x in kept.collect()) == [(0, "d"), (1, "a"), (3, "c")]
    assert similar.near_duplicates(df.limit(0)).collect() == []


def test_the_stage_links_by_simhash(spark, monkeypatch):
    """Without min-hash blocks, pairs within three bits are still found, those further apart aren't."""
    r = random.Random(5)
    words = [f"{r.getrandbits(40):x}" for _ in range(400)]
    rows = [(1, words), (2, [*words[:-1], "near"]), (3, [f"far{i}" if i % 50 == 20 else w for i, w in enumerate(words)]), (4, words[::-1]), (5, [*words, "next"])]
    rows = [(d, " ".join(w)) for d, w in rows]
    prints = [simhash.of_hashes(similar.shingles(x.encode(), 5)) for _, x in rows]
    assert [(prints[0] ^ p).bit_count() <= 3 for p in prints] == [True, True, False, False, True]
    assert prints[0] == simhash.fingerprint(rows[0][1].encode(), 5) and simhash.of_hashes(similar.shingles(b"", 5)) == 0
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, similar.near_duplicates(df).collect())) == [(1, 1), (2, 1), (3, 1), (4, 4), (5, 1)]
    monkeypatch.setattr(similar, "blocks", lambda x: x[:0])
    kept = corpus_pipeline.distinct_documents(spark, df, "")
    assert sorted(x["doc_id"] for x in kept.collect()) == [1, 3, 4]


def test_simhash_links_below_the_limit_do_not_count(spark, monkeypatch):
    rows = corpus(2)
    monkeypatch.setattr(similar, "of_hashes", lambda x: 7 if len(x) % 2 else 8)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, similar.near_duplicates(df).collect())) == brute(rows)
