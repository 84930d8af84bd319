import random

from skylattice.llm import decontaminate


def brute(docs, items, rate, shortest):
    out = set()
    for d, t in docs:
        text = decontaminate.normalise(t or "")
        for i, s in items:
            item = decontaminate.normalise(s or "")
            if len(item) < shortest:
                if item and b" " + item + b" " in b" " + text + b" ":
                    out.add((d, i, 0))
                continue
            most = min(int(len(item) * rate), len(item) // 8 - 1)
            row = [0] * (len(text) + 1)
            for x in range(1, len(item) + 1):
                new = [x]
                for y in range(1, len(text) + 1):
                    new.append(min(row[y] + 1, new[-1] + 1, row[y - 1] + (item[x - 1] != text[y - 1])))
                row = new
            if min(row) <= most:
                out.add((d, i, min(row)))
    return out


def corpus(seed):
    r = random.Random(seed)
    words = ["".join(r.choice("abcdeé") for _ in range(r.randint(2, 7))) for _ in range(80)]
    items = [(i, " ".join(r.choices(words, k=r.randint(9, 16)))) for i in range(6)] + [(90, words[0]), (91, None), (92, f"{words[1]} {words[2]}"), (93, "!"), (94, words[0])]
    docs = []
    for d in range(24):
        body = r.choices(words, k=r.randint(0, 25))
        if d % 2:
            item = list(r.choice(items[:6])[1])
            for _ in range(r.choice([0, 0, 2, 4, 5, 12])):
                at = r.randrange(len(item))
                item[at] = r.choice(["x", "", "zz"])
            at = r.randint(0, len(body))
            body = body[:at] + [r.choice(["!! ", ""]) + "".join(item).upper()] + body[at:]
        docs.append((d, "\n".join(body)))
    return docs + [(100, None), (101, "")], items


def test_recall_and_exactness(spark):
    total = found_all = 0
    for seed in (1, 2):
        docs, items = corpus(seed)
        want = brute(docs, items, 0.1, 40)
        df = spark.createDataFrame([(*d, "x") for d in docs], "doc_id long, text string, item_id string")
        bench = spark.createDataFrame(items, "item_id long, text string")
        got = set(map(tuple, decontaminate.contaminated(df, bench).collect()))
        assert {x[:2] for x in got} <= {x[:2] for x in want}
        assert {x[:2] for x in want if x[2] == 0} <= {x[:2] for x in got}
        total, found_all = total + len(want), found_all + len({x[:2] for x in got} & {x[:2] for x in want})
        kept = decontaminate.drop_contaminated(df, bench)
        assert kept.columns == df.columns
        assert {r[0] for r in kept.collect()} == {d for d, _ in docs} - {x[0] for x in got}
    assert found_all >= 0.95 * total > 0


def test_empty(spark):
    docs = spark.createDataFrame([(1, "some text")], "doc_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.contaminated(docs, none).collect() == []
    assert decontaminate.drop_contaminated(docs, none).count() == 1
    assert decontaminate.contaminated(docs.limit(0), docs.select(docs.doc_id.alias("item_id"), "text")).collect() == []


def test_recall_at_ten_per_cent_of_edits(spark):
    r = random.Random(5)
    word = lambda: "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.randint(2, 9)))
    items = [(i, " ".join(word() for _ in range(r.randint(12, 60)))) for i in range(300)]
    docs = []
    for i, t in items:
        letters = list(t)
        for at in r.sample(range(len(letters)), int(0.1 * len(decontaminate.normalise(t)))):
            letters[at] = r.choice("abcdefghij") if letters[at] != " " else " "
        docs.append((i, " ".join(word() for _ in range(20)) + " " + "".join(letters) + " " + word()))
    df, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    found = {(x["doc_id"], x["item_id"]) for x in decontaminate.contaminated(df, bench).collect()}
    assert all(a == b for a, b in found)
    print("recall at 10 % of edits:", len(found) / 300)
    assert len(found) >= 0.97 * 300


def test_blocks_chunks_and_long_items(spark, monkeypatch):
    """Many blocks, a text of many chunks, an item of 20,000 bytes; extra columns with the operator's names."""
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 3000)
    monkeypatch.setattr(decontaminate, "CHUNK", 50_000)
    r = random.Random(9)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(r.randint(3, 9)))
    items = [(i, " ".join(word() for _ in range(40))) for i in range(40)] + [(99, " ".join(word() for _ in range(3000))), (100, "tiny item")]
    filler = " ".join(word() for _ in range(30_000))
    edited = items[99 - 59][1].replace(" a", " b")
    docs = [(1, filler + " " + items[7][1] + " " + filler), (2, edited), (3, "a tiny  ITEM!"), (4, "tiny items"), (5, filler)]
    df = spark.createDataFrame([(*d, 1, 2) for d in docs], "doc_id long, text string, item_id int, edits int")
    bench = spark.createDataFrame(items, "item_id long, text string")
    assert {(x[0], x[1]) for x in decontaminate.contaminated(df, bench).collect()} == {(1, 7), (2, 99), (3, 100)}
    kept = decontaminate.drop_contaminated(df, bench)
    assert kept.columns == df.columns and sorted(x[0] for x in kept.collect()) == [4, 5]


def test_what_travels_is_small():
    import pickle

    items = decontaminate.Items([(1, b"some words " * 20_000)], 0.1)
    items.indexed().keys([items.texts[0][:4000]], 4000)
    assert len(pickle.dumps(items)) < 2 * 220_000
