import itertools
import random
import zlib

import numpy as np

from skylattice.llm import quality


def test_marginals_equal_enumeration():
    r = np.random.default_rng(2)
    sizes, stay = [1, 4, 6, 2], np.array([0.8, 0.3])
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    theta = r.normal(size=offsets[-1])
    got = quality.marginals(theta, offsets, stay)[0]
    for a, b in zip(offsets, offsets[1:]):
        weights = {}
        for y in itertools.product((0, 1), repeat=b - a):
            s = sum(t for t, v in zip(theta[a:b], y) if v)
            s += sum(stay[0] if p and q else stay[1] if not p and not q else 0 for p, q in zip(y, y[1:]))
            weights[y] = np.exp(s)
        total = sum(weights.values())
        want = [sum(w for y, w in weights.items() if y[i]) / total for i in range(b - a)]
        assert np.allclose(got[a:b], want)


def tables(spark, n=400):
    r = random.Random(1)
    docs, labels = [], []
    for i in range(n):
        words = ["".join(r.choice("abcdefghij") for _ in range(r.randint(2, 8))) for _ in range(r.randint(8, 60))]
        good = r.random() < 0.7
        text = " ".join(words) if good else " ".join(w + r.choice(["***", "###", "%%%"]) for w in words)
        docs.append((i, text.replace(" ", "\n", 2), "x"))
        labels.append((i, int(good), 0))
    docs += [(n, None, "x"), (n + 1, "", "x"), (n + 2, "\n\n", "x"), (n + 3, "a " * 20000, "x")]
    labels += [(5, 1 - labels[5][1], 0), (None, 1, 0), (7, None, 0)]
    return spark.createDataFrame(docs, "doc_id long, text string, score string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), n


def test_held_out_accuracy(spark):
    docs, labels, n = tables(spark)
    scores = {r["doc_id"]: r["score"] for r in quality.score(docs, labels).collect()}
    assert len(scores) == n + 4 and all(0 <= s <= 1 for s in scores.values())
    truth = {r["doc_id"]: r["quality"] for r in labels.filter("doc_id is not null and doc_id <> 5 and quality is not null").collect()}
    held = [i for i in truth if zlib.crc32(str(i).encode()) % 5 == 0]
    assert held and np.mean([(scores[i] >= 0.3) == truth[i] for i in held]) > 0.95
    kept = quality.keep_good(docs, labels)
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.collect()} == {i for i, s in scores.items() if s >= 0.3}


def test_without_labels_and_documents(spark):
    docs, labels, n = tables(spark, 20)
    assert {r["score"] for r in quality.score(docs, labels.filter("quality = 1")).collect()} == {0.5}
    assert quality.score(docs.limit(0), labels).collect() == []
