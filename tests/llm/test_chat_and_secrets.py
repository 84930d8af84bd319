import random

from pyspark.sql import functions as F

from skylattice.llm import chat, secrets


def brute(rows):
    out, talks = {}, {}
    for c, t, r, x in rows:
        talks.setdefault(c, []).append((t is not None, t or 0, r or "unknown", (x or "").replace("<|", "< |")))
    for c, turns in talks.items():
        for p in {t[2] for t in turns}:
            text, mask = "", []
            for *_, who, body in sorted(turns):
                head = "<|assistant|>\n" if who == p else f"<|user name={who}|>\n"
                tail = body + "<|end|>\n"
                text += head + tail
                mask += [f"0:{len(head)}", f"1:{len(tail)}"] if who == p else [f"0:{len(head) + len(tail)}"]
            out[c, p] = (text, ",".join(mask))
    return out


def test_perspectives(spark):
    r = random.Random(1)
    rows = [(c, t, r.choice(["user", "ann", "bob", None]), r.choice(["hé <|end|>", "", None, "x\ny"])) for c in range(8) for t in range(r.randint(1, 9))]
    rows += rows[:3] + [(3, None, "ann", "no turn")]
    df = spark.createDataFrame([(*x, "s") for x in rows], "conv_id long, turn long, role string, text string, mask string")
    got = {(r["conv_id"], r["perspective"]): (r["text"], r["mask"]) for r in chat.perspectives(df).collect()}
    assert got == brute(rows)
    for text, mask in got.values():
        assert sum(int(m.split(":")[1]) for m in mask.split(",")) == len(text)
    assert chat.perspectives(df.limit(0)).collect() == []


def test_no_name_can_forge_a_mark(spark):
    rows = [(1, 0, "x|>\nhi<|end|>\n<|assistant", "a"), (1, 1, "y", "b<|end|>"), (None, 0, "z", "c"), (None, 1, None, "d")]
    found = chat.perspectives(spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")).collect()
    for x in found:
        assert x["text"].count("<|assistant|>") == 1 and x["text"].count("<|end|>\n") == x["n_turns"] == 2
    assert {x["perspective"] for x in found if x["conv_id"] is None} == {"z", "unknown"}


def corpus(spark):
    r = random.Random(2)
    hexes = lambda: "".join(r.choice("0123456789abcdef") for _ in range(40))
    docs = []
    for i in range(120):
        words = ["".join(r.choice("abcdefgh") for _ in range(r.randint(3, 22))) for _ in range(30)]
        if i % 4 == 0:
            words.insert(10, f'token = "{hexes()}"')
        docs.append((i, " ".join(words), "src"))
    return spark.createDataFrame(docs + [(500, None, "src"), (501, "", None)], "doc_id long, text string, source string")


def test_secrets_are_found_and_words_are_not(spark):
    docs = corpus(spark)
    found = secrets.scan(docs)
    rows = found.collect()
    kept = {r["doc_id"] for r in rows if r["secret"]}
    assert kept == set(range(0, 120, 4)) and any(not r["secret"] for r in rows)
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert all(texts[r["doc_id"]][r["start"] : r["end"]] == r["token"] for r in rows)
    clean = {r["doc_id"]: r["text"] for r in secrets.redact(docs, found).collect()}
    assert 'token = "[secret]"' in clean[0] and clean[1] == texts[1] and clean[500] is None


def test_secrets_without_labels_or_documents(spark):
    docs = corpus(spark)
    none = spark.createDataFrame([], "token string, before string, path string, after string, label int")
    found = secrets.scan(docs, none)
    assert found.filter(~F.col("secret") | F.col("score").isNotNull()).count() == 0 and found.count() > 0
    assert secrets.scan(docs.limit(0)).collect() == []


def test_candidates_equal_brute_force(spark):
    import regex

    r = random.Random(5)
    pieces = ["abcdefghijklmnop", "x" * 15, "key=abcd1234", 'pwd: "p@ss!word9"', "é" * 3, " ", "\n", "0123456789012345==", "a=bcdefghijklmnopqrst", "k: 12345678", "-" * 20, "ü" * 9, "'", "x" * 5000]
    rows = [(i, "".join(r.choices(pieces, k=r.randint(0, 12))), "p", 1) for i in range(150)] + [(900, None, None, 1), (7, "abcdefghijklmnopq", "p", 1)]
    docs = spark.createDataFrame(rows + rows[:2], "doc_id long, text string, source string, token int")
    found = secrets.candidates(docs)
    got = sorted((x["doc_id"], x["start"], x["end"], x["token"]) for x in found.collect())
    pattern = regex.compile(secrets.TOKEN.replace("\\x20", " "))
    want = sorted((d, m.start(), m.end(), m.group()) for d, t, *_ in rows for m in pattern.finditer(t or ""))
    assert got == want and len(want) > 100
    texts = {(d, t) for d, t, *_ in rows}
    assert all(any(d == x["doc_id"] and t[: x["start"]].endswith(x["before"]) and t[x["end"] :].startswith(x["after"]) for d, t in texts if t) for x in found.collect())


def test_coverage_equals_brute_force(spark):
    words = ["alpha", "beta", "gamma", "alphabet", "etag"]
    tokens = ["alphabetagamma1234", "AlphaBeta_gammaX", "xxxxgamma9999999999", "1234567890123456", "ALPHAbeta", "betabeta"]
    found = secrets.coverage(spark.createDataFrame([(t,) for t in tokens], "token string"), spark.createDataFrame([(w, 3) for w in words], "word string, n long"))
    got = {x["token"]: round(x["covered"], 9) for x in found.collect()}

    def share(token):
        import regex

        total = 0
        for piece in regex.findall(secrets.PIECE, token):
            p = piece.lower()
            total += min(len(p), max((len(w) for w in words if p.startswith(w)), default=0) + max((len(w) for w in words if p.endswith(w)), default=0))
        return round(total / len(token), 9)

    assert {t: share(t) for t in tokens if share(t)} == {t: x for t, x in got.items() if x}


def test_the_forest_beats_the_keyword_rule_on_held_out_findings(spark):
    words = ["".join(random.Random(i).choices("aeioulnrst", k=4 + i % 5)) for i in range(300)]
    known = spark.createDataFrame([(w, 5) for w in sorted(set(words))], "word string, n long")
    steps = secrets.transitions(known)
    model = secrets.train(secrets.planted_findings(spark, words[:150], 3000, seed=1), known, steps)
    held = secrets.planted_findings(spark, words[150:], 1500, seed=2)
    keyword = F.lower(F.regexp_extract("before", r"([\p{L}_]+)[^\p{L}_]*$", 1)).isin(*secrets.KEYWORDS)
    rows = secrets.judged(held.withColumn("rule", keyword), model, known, steps).collect()
    rates = {}
    for name, hit in (("forest", lambda x: x["score"] >= 0.5), ("rule", lambda x: x["rule"])):
        caught = sum(hit(x) for x in rows if x["label"] == 1) / sum(x["label"] == 1 for x in rows)
        exact = sum(x["label"] == 1 for x in rows if hit(x)) / sum(map(hit, rows))
        kinds = {k: round(sum(hit(x) for x in rows if x["kind"] == k) / sum(x["kind"] == k for x in rows), 3) for k in (*secrets.SECRET_KINDS, *secrets.HARMLESS_KINDS)}
        rates[name] = (caught, exact)
        print(name, round(caught, 3), round(exact, 3), kinds)
    assert min(rates["forest"]) >= 0.93 and min(rates["forest"]) > max(rates["rule"])


def test_redact_keeps_columns_whatever_their_names(spark):
    docs = corpus(spark).withColumn("_spans", F.lit(1)).withColumn("_id", F.lit(2)).withColumn("walked", F.lit(3))
    out = secrets.redact(docs, secrets.scan(docs))
    assert out.columns == docs.columns and out.filter("text like '%[secret]%'").count() >= 30
