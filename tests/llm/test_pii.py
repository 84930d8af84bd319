import hashlib
import random
import re

from skylattice.llm import pii

KINDS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (2 if i % 2 else 1)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def base(text):
    out = []
    for rank, (kind, pattern) in enumerate(KINDS.items()):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            good = {
                "email": lambda: True,
                "ip": lambda: all(int(p) <= 255 for p in m[0].split(".")),
                "card": lambda: 14 <= len(digits) <= 19 and luhn(digits),
                "phone": lambda: 10 <= len(digits) <= 15,
            }[kind]()
            if good:
                out.append((m.start(), rank, kind, m.end()))
    return sorted(out)


TEXTS = [
    None, "", "mail a.b+c@x-y.example.org, or a@b.c_x@d.e.f. and @no.pe x@y", "10.0.0.1 1.2.3.4.5 999.1.1.1 0010.1.1.255 1.2.3.",
    "4111 1111 1111 1111 and 4111-1111-1111-1112; 378282246310005 5", "+1 (415) 555-2671 +44 20 7946 0958. +123 +49 89 1234567890123456", "é😀 ünïcode a@b.de 😀 8.8.8.8",
    "a" * 5000, "1" * 5000, "1.1" * 800, "a@" * 500 + "b.c", "x@y" + ".z" * 3000, "+1" + " " * 3000, "+1 " * 500, "a@b.c" * 50, "4111111111111111 " * 20,
]


def fuzz(seed):
    r = random.Random(seed)
    parts = ["a", "Z9", "@", ".", "-", "_", "+", " ", "1", "255", "256", "4111111111111111", "(", ")", "é", "\n", "x@y.z", "+1 415 555 2671", "8.8.8.8"]
    return ["".join(r.choices(parts, k=r.randint(1, 60))) for _ in range(150)]


def test_base_spans_equal_brute_force(spark):
    texts = TEXTS + fuzz(1)
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, h string")
    found = {r["doc_id"]: r for r in pii.digest(df).collect()}
    assert len(found) == len(texts)
    for i, t in enumerate(texts):
        want = base(t or "")
        joined = ",".join(f"{k}:{s}:{e}" for s, _, k, e in want)
        assert found[i]["base_sha256"] == hashlib.sha256(joined.encode()).hexdigest(), (t or "")[:80]
        assert [found[i][f"n_{k}"] for k in KINDS] == [sum(x[2] == k for x in want) for k in KINDS]
        others = [s for s in found[i]["spans"].split(",") if s and not s.startswith("term")]
        assert ",".join(others) == joined


def test_terms_that_tell(spark):
    docs = [(i, f"Contact Zebulon under z@mail.example.com about matter number{'abcdefgh'[i]}") for i in range(6)]
    docs += [(100 + i, f"Contact us about matter {w} today") for i, w in enumerate(["wood", "iron", "clay", "sand"] * 10)]
    docs += [(900, "Zebulon alone"), (901, docs[0][1]), (902, None)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    rows = {r["doc_id"]: r for r in pii.digest(df, support=3, disclosure=0.5).collect()}
    assert rows[0]["n_term"] >= 1 and "term:8:15" in rows[0]["spans"] and rows[901]["spans"] == rows[0]["spans"]
    assert rows[100]["n_term"] == 0 and rows[900]["n_term"] == 0
    clean = {r["doc_id"]: r["text"] for r in pii.sanitise(df, support=3, disclosure=0.5).collect()}
    assert "[email]" in clean[0] and "Zebulon" not in clean[0] and clean[100] == docs[6][1] and clean[902] == ""


def test_entities_of_one_text_at_production_parameters(spark):
    import math

    r = random.Random(5)
    common = ["contact", "about", "matter", "today", "under", "number"]
    rare = ["".join(r.choices("abcdefghijklmnop", k=8)) for _ in range(60)]
    texts = [" ".join(r.choices(common, k=6) + r.choices(rare, k=3)) for _ in range(300)]
    texts[0] = "Zebulon under z@mail.example.com or 8.8.8.8 today " + rare[0]
    texts[1] = "Quillon under q@mail.example.com today about"
    texts[2] = texts[1] + " again"
    texts[3] = texts[0]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    words = [set(re.findall(r"[^\W\d_]{4,}", t.lower())) for t in texts]
    held = [{(k, t[s:e].lower()) for s, _, k, e in base(t)} for t in texts]
    n = len(texts)
    for row in pii.digest(df).collect():
        i, want = row["doc_id"], []
        for m in re.finditer(r"[^\W\d_]{4,}", texts[i]):
            term = m[0].lower()
            if any(s < m.end() and m.start() < e for s, _, _, e in base(texts[i])):
                continue
            for x in held[i]:
                n_e, n_t = sum(x in h for h in held), sum(term in w for w in words)
                n_te = sum(x in h and term in w for h, w in zip(held, words))
                if math.log2(n_te * n / (n_t * n_e)) >= 0.8 * math.log2(n / n_e) - 1e-12:
                    want.append(f"term:{m.start()}:{m.end()}")
                    break
        assert [s for s in row["spans"].split(",") if s.startswith("term")] == want and row["n_term"] == len(want)
        assert i not in (0, 1) or "term:0:7" in want


def test_empty(spark):
    assert pii.digest(spark.createDataFrame([], "doc_id long, text string")).collect() == []
