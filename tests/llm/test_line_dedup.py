import random

from pyspark.sql import functions as F

from skylattice.llm import line_dedup


def distance(a, b, most):
    """Edit distance, or something above most; cells further than most from the diagonal can't help."""
    far = most + 1
    row = {j: j for j in range(min(len(b), most) + 1)}
    for i in range(1, len(a) + 1):
        new = {}
        for j in range(max(0, i - most), min(len(b), i + most) + 1):
            options = [row.get(j, far) + 1, new.get(j - 1, far) + 1]
            if j:
                options.append(row.get(j - 1, far) + (a[i - 1] != b[j - 1]))
            new[j] = min(options)
        row = new
    return row.get(len(b), far)


def brute(rows, edits, shortest, fuzzy):
    lines = []
    for d, t in rows:
        for i, raw in enumerate((t or "").split("\n") if t is not None else []):
            lines.append(((d, i), raw.rstrip(" \t\r")))
    first = {}
    for at, line in sorted(lines):
        if len(line) >= shortest:
            first.setdefault(line, at)
    near = set()
    for a, fa in first.items():
        if len(a) < fuzzy:
            continue
        for b, fb in first.items():
            if fb < fa and len(b) >= fuzzy and abs(len(a) - len(b)) <= edits and distance(a, b, edits) <= edits:
                near.add(a)
                break
    out = {}
    for d, t in rows:
        if t is None:
            out[d] = None
            continue
        kept = []
        for i, raw in enumerate(t.split("\n")):
            line = raw.rstrip(" \t\r")
            if len(line) >= shortest and (first[line] != (d, i) or line in near):
                continue
            kept.append(raw)
        out[d] = "\n".join(kept)
    return out


def corpus(seed, copies=25):
    r = random.Random(seed)
    letters = "abcdeé "
    base = ["".join(r.choice(letters) for _ in range(r.randint(10, 70))).strip() + "x" for _ in range(30)]
    rows = []
    for d in range(60):
        lines = []
        for _ in range(r.randint(0, 8)):
            line = list(r.choice(base))
            for _ in range(r.choice([0, 0, 1, 2, 3])):
                at = r.randrange(len(line))
                kind = r.random()
                if kind < 0.4:
                    line[at] = r.choice(letters)
                elif kind < 0.7:
                    line.insert(at, r.choice(letters))
                elif len(line) > 1:
                    del line[at]
            lines.append("".join(line) + r.choice(["", "\r", "  "]))
        rows.append((d, "\n".join(lines)))
    hot = "".join(r.choice(letters) for _ in range(60)) + "x"
    for d in range(copies):
        line = list(hot)
        for _ in range(3):
            line[r.randrange(len(line))] = r.choice("uvw")
        rows.append((100 + d, "".join(line)))
    return rows + [(200, None), (201, ""), (202, "\n\n"), (203, "short")]


def run(spark, rows, **how):
    df = spark.createDataFrame([(d, t, "s") for d, t in rows], "doc_id long, text string, line string")
    out = line_dedup.drop_repeated_lines(df, **how)
    assert out.columns == df.columns
    return {d: t for d, t, _ in out.collect()}


def test_equals_brute_force(spark):
    rows = corpus(1)
    assert run(spark, rows, edits=2, shortest=12, fuzzy=20) == brute(rows, 2, 12, 20)


def test_other_thresholds(spark, monkeypatch):
    rows = corpus(2)
    monkeypatch.setattr(line_dedup, "TILE", 3)
    assert run(spark, rows, edits=1, shortest=1, fuzzy=10) == brute(rows, 1, 1, 10)


def test_counts_and_odd_tables(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert line_dedup.drop_repeated_lines(df).collect() == []
    line = "this line is long enough to count as one"
    df = spark.createDataFrame([(1, line + "\n" + line), (1, line), (None, line), (2, line + "\nb")], "doc_id long, text string")
    found = line_dedup.drop_repeated_lines(df, counts=True).collect()
    texts = sorted((str(r[0]), r[1], r["_n_lines"], r["_n_removed"]) for r in found)
    assert texts == [("1", "", 1, 1), ("1", "", 2, 2), ("2", "b", 2, 1), ("None", line, 1, 0)]


def test_hot_key_and_long_lines(spark, monkeypatch):
    """One segment that hundreds of lines share, near ones and others, in groups that are split and tiled."""
    monkeypatch.setattr(line_dedup, "TILE", 4)
    r = random.Random(3)
    hot = "a common beginning of lines "
    rows = []
    for d in range(150):
        tail = list("the rest of the line is not so common")
        for _ in range(r.choice([1, 2, 3, 6])):
            tail[r.randrange(len(tail))] = r.choice("xyz")
        rows.append((d, hot + "".join(tail)))
    long = "".join(r.choice("abcd ") for _ in range(30_000)) + "x"
    rows += [(300, long), (301, long[:100] + "e" + long[101:]), (302, long[:9] + "eee" + long[12:])]
    assert run(spark, rows) == brute(rows, 2, 20, 20)


def test_places_that_are_equal_are_not_before_each_other(spark):
    line = "this line is long enough to count as one"
    rows = [(7, line + "a"), (7, line + "b"), (8, line + "c"), (8, line + "d")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted((x[0], x[1]) for x in line_dedup.drop_repeated_lines(df).collect()) == [(7, line + "a"), (7, line + "b"), (8, ""), (8, "")]


def test_columns_of_any_name_are_kept(spark):
    line = "this line is long enough to count as one"
    columns = ["_gone", "_id", "_h", "_n_near", "_key", "_near", "_lines", "_edges", "line", "id", "no", "first"]
    df = spark.createDataFrame([(1, line, *range(12)), (2, line, *range(12))], "doc_id long, text string, " + ", ".join(f"{c} int" for c in columns))
    out = line_dedup.drop_repeated_lines(df)
    assert out.columns == df.columns and sorted(tuple(x) for x in out.collect()) == [(1, line, *range(12)), (2, "", *range(12))]
    counted = line_dedup.drop_repeated_lines(df, counts=True)
    assert counted.columns == [c for c in df.columns if c != "_n_near"] + ["_n_lines", "_n_removed", "_n_near"]
    assert sorted(x["_n_removed"] for x in counted.collect()) == [0, 1]


def test_near_equals_edit_distance(spark):
    r = random.Random(8)
    pairs = []
    for _ in range(300):
        a = [r.choice("abé𝄞") for _ in range(r.randint(0, 9))]
        b = list(a)
        for _ in range(r.randint(0, 4)):
            at = r.randrange(len(b) + 1)
            b[at : at + r.randint(0, 1)] = r.choices("abé𝄞", k=r.randint(0, 1))
        pairs.append(("".join(a), "".join(b)))
    df = spark.createDataFrame(pairs, "a string, b string")
    for k in (0, 1, 2, 3):
        found = df.select("a", "b", line_dedup.near(df["a"], df["b"], k).alias("n")).collect()
        assert all(x["n"] == (distance(x["a"], x["b"], k) <= k) for x in found)


def test_marks_lose_no_row(spark):
    rows = spark.range(100_000).select(F.xxhash64("id").alias("id"), F.col("id").alias("k"))
    found = line_dedup._marked(rows, rows.filter("k % 3 = 0"))
    assert found.filter("k % 3 = 0").count() == 33_334 and found.filter("k % 3 <> 0").count() < 200


def test_large_groups_of_near_lines_of_many_lengths(spark, monkeypatch):
    """Groups in which few rows have the key as their own segment, and some rows only meet by another's."""
    monkeypatch.setattr(line_dedup, "TILE", 8)
    r = random.Random(5)
    base = "".join(r.choice("abcdefgh ") for _ in range(300)) + "x"
    rows = []
    for d in range(120):
        line = list(base[: 180 + r.randrange(120)] + "x")
        for _ in range(r.choice([1, 3, 4])):
            line[r.randrange(len(line) - 1)] = r.choice("uvw")
        rows.append((d, "".join(line)))
    assert run(spark, rows) == brute(rows, 2, 20, 20)


def test_rows_of_a_large_group_are_copied_for_own_rows_only(spark):
    rows = [(1, i < 20, i, i) for i in range(500)] + [(2, False, i, i) for i in range(300)] + [(3, True, 7, 7)]
    rows += [(4, i < 100, i, i) for i in range(150)]
    every, owned = line_dedup.tiled(spark.createDataFrame(rows, "key long, own boolean, id long, id2 int"))
    assert {x["key"]: x["count"] for x in every.groupBy("key").count().collect()} == {1: 500, 4: 300}
    assert {x["key"]: x["count"] for x in owned.groupBy("key").count().collect()} == {1: 20, 4: 100}
