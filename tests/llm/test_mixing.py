import math
import random
import warnings

import pytest
from pyspark.sql import functions as F

from skylattice.llm import mixing


def tables(spark):
    r = random.Random(3)
    words = {"a": [f"alpha{i}" for i in range(40)], "b": [f"beta{i}" for i in range(40)], "c": [f"gamma{i}" for i in range(40)]}
    docs, labels = [], []
    for i in range(300):
        d = r.choices("abc", weights=(6, 3, 1))[0]
        docs.append((i, " ".join(r.choices(words[d], k=r.randint(5, 200))), "x"))
        if i % 3 == 0:
            labels.append((i, d))
    docs += [(900, None, "x"), (901, "", "x"), (902, docs[0][1], "x"), (None, "alpha1 beta1", "x")]
    labels += [(0, "b"), (None, "a"), (3, None)]
    return spark.createDataFrame(docs, "doc_id long, text string, rate string"), spark.createDataFrame(labels, "doc_id long, domain string")


def test_totals_meet_targets(spark):
    docs, labels = tables(spark)
    targets = {"a": 0.2, "b": 0.5, "c": 0.3}
    found = mixing.rates(docs, labels, targets)
    total = found.agg(F.sum("n_tokens")).first()[0]
    got = found.agg(*(F.sum(F.col("rate") * F.col("n_tokens") * F.get("p", F.lit(i))).alias(d) for i, d in enumerate("abc"))).first()
    for d, w in targets.items():
        assert got[d] == pytest.approx(w * total, rel=0.01)
    assert found.filter("rate < 0 or rate is null").count() == 0 and found.count() == 304


def test_mix_keeps_columns_and_rows(spark):
    docs, labels = tables(spark)
    out = mixing.mix(docs, labels, {"a": 0.2, "b": 0.5, "c": 0.3})
    assert out.columns == ["doc_id", "text", "rate"] and out.count() == 304
    twice = mixing.mix(docs.union(docs), labels, {"a": 0.2, "b": 0.5, "c": 0.3})
    assert twice.count() == 608
    assert twice.groupBy("doc_id", "text").agg(F.count("*").alias("n"), F.count_distinct("rate").alias("k")).filter("n <> 2 or k <> 1").count() == 0


def brute(docs, labels, targets, rounds=40):
    """The whole of rates() in plain Python, over rows (doc_id, text): [(doc_id, n_tokens, p, rate)]."""
    import xxhash

    def bucket(word):
        h = xxhash.xxh64_intdigest(word.encode(), 42)
        return (h - (1 << 64) if h >> 63 else h) % mixing.BUCKETS

    domains = sorted(targets)
    said = {}
    for i, d in labels:
        if i is not None and d in domains:
            said.setdefault(i, set()).add(d)
    said = {i: next(iter(x)) for i, x in said.items() if len(x) == 1}
    counts = {d: [0.0] * mixing.BUCKETS for d in domains}
    for i, text in docs:
        if i in said:
            for w in (text or "").split():
                counts[said[i]][bucket(w)] += 1
    mass = {d: sum(counts[d]) for d in domains}
    shared = [1 / mixing.BUCKETS + sum(counts[d][b] / mass[d] for d in domains if mass[d]) for b in range(mixing.BUCKETS)]
    shared = [x / sum(shared) for x in shared]
    weight = {d: 0.02 * mass[d] + 1000 for d in domains}
    like = {d: [math.log((counts[d][b] + weight[d] * shared[b]) / ((mass[d] + weight[d]) * shared[b])) for b in range(mixing.BUCKETS)] for d in domains}
    prior = {d: math.log((sum(x == d for x in said.values()) + 1) / (len(said) + len(domains))) for d in domains}
    rows = []
    for i, text in docs:
        words = (text or "").split()
        z = [prior[d] + sum(like[d][bucket(w)] for w in words) for d in domains]
        e = [math.exp(max(x - max(z), -60)) for x in z]
        rows.append([i, len(words), [x / sum(e) for x in e], 1.0])
    total = sum(r[1] for r in rows)
    masses = [sum(r[1] * r[2][k] for r in rows) for k in range(len(domains))]
    want = [targets[d] / sum(targets.values()) * total for d in domains]
    for k, m in enumerate(masses):  # one rare domain at most in these tests
        if want[k] > 4 * m:
            rest = sum(targets[d] for j, d in enumerate(domains) if j != k)
            want = [4 * m if j == k else (total - 4 * m) * targets[d] / rest for j, d in enumerate(domains)]
    for _ in range(rounds):
        reached = [sum(r[3] * r[1] * r[2][k] for r in rows) for k in range(len(domains))]
        if sum(abs(a - b) for a, b in zip(reached, want)) <= 1e-4 * total:
            break
        step = [(a - b) / s for a, b, s in zip(reached, want, masses)]
        for r in rows:
            r[3] = max(0.0, r[3] - sum(p * x for p, x in zip(r[2], step)))
    return rows


def test_equals_brute_force(spark):
    docs, labels = tables(spark)
    long = "alpha1\tbeta2\n" * 20_000
    docs = docs.union(docs.limit(3)).union(spark.createDataFrame([(950, long, "x"), (951, " \n ", "x"), (902, "gamma1\ngamma2", "y")], docs.schema))
    targets = {"a": 0.2, "b": 0.5, "c": 0.3}
    want = brute([(x[0], x[1]) for x in docs.collect()], [tuple(x) for x in labels.collect()], targets)
    key = lambda x: (x[0] is None, x[0], x[1])
    got = sorted(((x["doc_id"], x["n_tokens"], x["p"], x["rate"]) for x in mixing.rates(docs, labels, targets).collect()), key=key)
    assert len(got) == len(want)
    for a, b in zip(got, sorted(want, key=key)):
        assert a[:2] == tuple(b[:2]) and a[2] == pytest.approx(b[2], abs=1e-3) and a[3] == pytest.approx(b[3], abs=5e-3)


def test_a_domain_that_is_hardly_there_costs_no_other_documents(spark):
    docs, labels = tables(spark)
    found = mixing.rates(docs, labels, {"a": 0.5, "b": 0.3, "c": 0.1, "none": 0.1}).filter("n_tokens > 60").collect()
    assert min(x["rate"] for x in found) > 0.3
    assert mixing.reachable([0.5, 0.4, 0.1], [50.0, 49.0, 1.0], 100.0, 4.0) == pytest.approx([96 * 5 / 9, 96 * 4 / 9, 4.0])


def test_a_target_that_cannot_be_met_is_warned_about(spark):
    docs, labels = tables(spark)
    with pytest.warns(UserWarning, match="totals miss"):
        mixing.rates(docs, labels.limit(0), {"a": 0.9, "b": 0.1}, rounds=3)  # all are alike
    with warnings.catch_warnings():
        warnings.simplefilter("error", UserWarning)
        mixing.rates(docs, labels, {"a": 0.2, "b": 0.5, "c": 0.3})


def test_columns_of_any_name_are_kept(spark):
    docs, labels = tables(spark)
    odd = docs.withColumns({c: F.lit(i) for i, c in enumerate(("_id", "_h", "_rate", "h", "p", "copies"))})
    out = mixing.mix(odd, labels, {"a": 0.2, "b": 0.5, "c": 0.3})
    assert out.columns == [c for c in odd.columns if c != "rate"] + ["rate"] and out.count() == 304


def test_odd_tables(spark):
    docs, labels = tables(spark)
    assert mixing.mix(docs.limit(0), labels, {"a": 1.0, "b": 1.0}).collect() == []
    assert mixing.rates(docs, labels.limit(0), {"a": 1.0, "b": 1.0}).filter("rate is null").count() == 0
