import hashlib
import random

import pytest

from skylattice.llm import substring_dedup

SCHEMA = "doc_id long, text string, n_removed string"


def brute(rows, length):
    seen, out = set(), []
    for doc_id, text in sorted(((d, (t or "").encode()) for d, t in rows), key=lambda r: (r[0] is not None, r[0] or 0)):
        gone = bytearray(len(text))
        for i in range(len(text) - length + 1):
            piece = text[i : i + length]
            if piece in seen:
                gone[i : i + length] = b"\x01" * length
            seen.add(piece)
        kept = bytes(c for c, g in zip(text, gone) if not g)
        spans = sum(1 for i in range(len(text)) if gone[i] and (i == 0 or not gone[i - 1]))
        out.append((doc_id, len(text), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def run(spark, rows, length=100):
    docs = spark.createDataFrame([(d, t, "x") for d, t in rows], SCHEMA)
    found = substring_dedup.digest(docs, length)
    return sorted(map(tuple, found.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()), key=str)


def corpus(seed, n=40):
    r = random.Random(seed)
    words = ["".join(r.choice("abcdeé") for _ in range(r.randint(1, 7))) for _ in range(300)]
    passages = [" ".join(r.choices(words, k=r.randint(12, 60))) for _ in range(6)]
    rows = []
    for i in range(n):
        parts = []
        for _ in range(r.randint(0, 6)):
            parts.append(r.choice(passages) if r.random() < 0.4 else " ".join(r.choices(words, k=r.randint(1, 40))))
        rows.append((i * 3, "\n".join(parts)))
    rows += [(500, rows[3][1]), (501, rows[5][1][7:]), (502, "a" * 700), (503, "ab" * 300 + "c"), (504, "xy abc " * 90), (505, None), (506, "")]
    rows += [(507, "a" * 450 + "b"), (508, passages[0] + passages[0])]
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_brute_force(spark, seed):
    rows = corpus(seed)
    assert run(spark, rows) == brute(rows, 100)


def test_small_chunks_change_nothing(spark, monkeypatch):
    monkeypatch.setattr(substring_dedup, "CHUNK", 150)
    rows = corpus(3, 15)
    assert run(spark, rows) == brute(rows, 100)


def test_empty_table(spark):
    assert run(spark, []) == []


def test_repeated_and_null_ids(spark):
    r = random.Random(5)
    text = "".join(r.choice("abcdefgh ") for _ in range(300))
    found = run(spark, [(1, text), (1, text), (None, text)])
    assert sorted(x[2] for x in found) == [0, 300, 300]
    assert [x[2] for x in found if x[0] is None] == [0]


def prefix_doubling(docs, length=100):
    """Positions (key, i) of docs(key, text) whose string of that length also starts earlier, by plain prefix
    doubling: the rank of a position is that of its first bytes; Spark sorts the pairs of ranks at growing
    offsets and ranks them anew; positions whose rank is unique drop out."""
    import numpy as np
    import pyarrow as pa
    from pyspark.sql import functions as F

    def positions(it):
        for batch in it:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.large_binary())):
                data = text.as_py()
                if len(data) < length:
                    continue
                eight = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(np.frombuffer(data, dtype=np.uint8), 8)).view(">i8").ravel()
                at = np.arange(len(eight), dtype=np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), key)), pa.array(at), pa.array(eight.astype(np.int64))], names=["key", "i", "r"])

    ranked, reach = docs.mapInArrow(positions, "key long, i long, r long"), 8
    while True:
        repeated = ranked.groupBy("r").agg(F.count("*").alias("n")).filter("n > 1").select("r")
        ranked = ranked.join(repeated, "r", "left_semi")
        if reach == length:
            break
        step = min(reach, length - reach)
        pairs = ranked.join(ranked.select("key", (F.col("i") - step).alias("i"), F.col("r").alias("r2")), ["key", "i"])
        names = pairs.select("r", "r2").distinct().repartitionByRange("r", "r2").sortWithinPartitions("r", "r2").withColumn("rank", F.monotonically_increasing_id())
        names = names.checkpoint()  # the numbers must not change
        ranked = pairs.join(names, ["r", "r2"]).select("key", "i", F.col("rank").alias("r")).checkpoint()
        reach += step
    first = ranked.groupBy("r").agg(F.min(F.struct("key", "i")).alias("first"))
    return ranked.join(first, "r").filter("struct(key, i) <> first").select("key", "i")


def test_equals_plain_prefix_doubling(spark, tmp_path):
    import random

    spark.sparkContext.setCheckpointDir(str(tmp_path))
    r = random.Random(12)
    parts = ["".join(r.choice("abcd é") for _ in range(r.choice([30, 90, 130, 260]))) for _ in range(12)]
    rows = [(i, "".join(r.choices(parts, k=r.randint(0, 5)))) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    starts = {}
    for x in prefix_doubling(docs.selectExpr("doc_id as key", "text")).collect():
        starts.setdefault(x["key"], set()).add(x["i"])
    found = {x["doc_id"]: x for x in substring_dedup.cut(docs, 100).collect()}
    for i, text in rows:
        gone = {b for s in starts.get(i, ()) for b in range(s, s + 100)}
        assert found[i]["n_removed"] == len(gone)
        assert found[i]["kept"] == bytes(b for k, b in enumerate(text.encode()) if k not in gone)
