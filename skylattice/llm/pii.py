"""Personal data, and the terms of the corpus that give it away.

Base spans are matched by pattern: email, ip, card (Luhn) and phone. Around them works an
information-theoretic sanitiser: over the distinct texts of the corpus, a term t tells about a protected
entity e (a matched value) PMI(t; e) = log2(n(t, e) N / (n(t) n(e))) bits of its IC(e) = log2(N / n(e)).
A term that tells at least `disclosure` of IC(e) is a span where both occur: it is removed where it tells
everything, and generalised otherwise. All counts are of all documents. Entities of a single text are
judged like any other; `support` asks for more distinct texts that hold both, where that is wanted.

Everything here is DataFrame functions. Patterns are written with possessive quantifiers and anchored
to the start of a run, or to the end of the match before, so that they are linear in the text.

Cases: a null text counts as empty and has no spans; rows that repeat doc_id and text have equal
results; rows that repeat a doc_id with other texts are apart; a null doc_id is kept; other columns are
ignored; an empty table gives an empty result. Ties cannot matter: every number is a count.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skylattice.llm.common import stage

#: Kinds in the order of spans with one start, and their patterns.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: A term: letters, four at least.
TERM = r"\p{L}{4,}+"
KINDS = [*PATTERNS, "term"]


def _luhn(digits: Column) -> Column:
    """Whether the digits pass the Luhn test, from the right."""
    doubled = lambda d: F.when(d > 4, 2 * d - 9).otherwise(2 * d)
    value = lambda i: F.substring(digits, F.length(digits) - i, F.lit(1)).cast("int")
    total = F.aggregate(
        F.sequence(F.lit(0), F.length(digits) - 1),
        F.lit(0),
        lambda a, i: a + F.when(i % 2 == 1, doubled(value(i))).otherwise(value(i)),
    )
    return total % 10 == 0


def _valid(kind: str, match: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(match, r"\."), lambda p: p.cast("double") <= 255)
    if kind == "card":
        digits = F.regexp_replace(match, "[^0-9]", "")
        return F.length(digits).between(14, 19) & F.when(F.length(digits).between(14, 19), _luhn(digits)).otherwise(False)
    if kind == "phone":
        return F.length(F.regexp_replace(match, "[^0-9]", "")).between(10, 15)
    return F.lit(True)


def _pieces(text: Column, pattern: str) -> Column:
    """An array of (gap, match): each match and the number of code points between it and the last."""
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.transform(F.split(text, pattern, -1), lambda g: F.length(g))
    zipped = F.arrays_zip(F.slice(gaps, 1, F.size(matches)).alias("gap"), matches.alias("match"))
    return F.when(F.size(matches) > 0, zipped)


def _placed(pieces: DataFrame, *by: str) -> DataFrame:
    """Start and end of each match from the gaps and matches before it."""
    order = Window.partitionBy(*by).orderBy("pos")
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (
        pieces.withColumn("end", F.sum(F.col("gap") + F.length("match")).over(upto))
        .withColumn("start", F.col("end") - F.length("match"))
        .drop("gap")
    )


def _texts(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text")).withColumn("h", F.xxhash64("text"))


def base_spans(texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(spans, found). spans: (h, kind, rank, start, end, value) of each distinct text; found: the distinct texts
    that may hold personal data, (h, text). h stands for a text."""
    sign = {"email": F.contains("text", F.lit("@")), "phone": F.contains("text", F.lit("+"))}
    arrays = [F.when(sign.get(k, F.lit(True)), _pieces(F.col("text"), p)).alias(k) for k, p in PATTERNS.items()]
    some = " or ".join(f"{k} is not null" for k in PATTERNS)
    found = stage(texts.select("h", "text", *arrays).filter(some).dropDuplicates(["h"]), "pii-found")
    parts = [
        found.select("h", F.lit(k).alias("kind"), F.lit(i).alias("rank"), F.posexplode(k).alias("pos", "p"))
        .select("h", "kind", "rank", "pos", "p.gap", F.col("p.match").alias("match"))
        .withColumn("valid", _valid(k, F.col("match")))
        for i, k in enumerate(PATTERNS)
    ]
    rows = parts[0]
    for x in parts[1:]:
        rows = rows.unionByName(x)
    spans = _placed(rows, "h", "kind").filter("valid").select("h", "kind", "rank", "start", "end", F.col("match").alias("value"))
    return stage(spans, "pii-spans"), found.select("h", "text")


def _words(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(TERM), F.lit(0)))


def holders(spans: DataFrame) -> DataFrame:
    """(h, e): the distinct texts of each entity. Entities of the very same texts have equal counts with
    every term, so one e stands for them."""
    rows = spans.select("h", F.xxhash64("kind", F.lower("value")).alias("v")).distinct()
    alike = rows.groupBy("v").agg(F.xxhash64(F.count("*"), F.expr("bit_xor(xxhash64(h))"), F.min("h"), F.max("h")).alias("e"))
    return stage(rows.join(alike, "v").select("h", "e").distinct(), "pii-holders")


def _occurring(found: DataFrame, held: DataFrame) -> DataFrame:
    """The columns of held(h, e, ...) with each term of the text h."""
    return found.join(held, "h").select(*held.columns, F.explode(_words(F.col("text"))).alias("term"))


def disclosing(texts: DataFrame, held: DataFrame, found: DataFrame, support: int, disclosure: float) -> DataFrame:
    """(e, term, ratio): terms that tell at least the given share of the entity's information, seen
    together in `support` distinct texts at least. Counts are of all documents."""
    weights = stage(texts.groupBy("h").agg(F.count("*").alias("w")), "pii-weights")
    total = weights.agg(F.sum("w").alias("n_docs"))
    rows = held.join(weights, "h")
    sizes = rows.groupBy("e").agg(F.count("*").alias("k"), F.sum("w").alias("n_e")).filter(F.col("k") >= support).drop("k")
    together = (
        _occurring(found, rows)
        .groupBy("e", "term")
        .agg(F.count("*").alias("k"), F.sum("w").alias("n_te"))
        .filter(F.col("k") >= support)
        .join(sizes, "e")
    )
    counts = texts.select(F.explode(_words(F.col("text"))).alias("term")).groupBy("term").agg(F.count("*").alias("n_t"))
    bits = F.log2(F.col("n_docs") / F.col("n_e"))
    return (
        together.join(counts, "term")
        .join(F.broadcast(total))  # one row
        .withColumn("ratio", F.when(bits > 0, 1 + F.log2(F.col("n_te") / F.col("n_t")) / bits).otherwise(0.0))
        .filter(F.col("ratio") >= disclosure)
        .select("e", "term", "ratio")
    )


def term_spans(spans: DataFrame, held: DataFrame, found: DataFrame, telling: DataFrame) -> DataFrame:
    """Occurrences of telling terms in texts that hold their entity, outside base spans:
    (h, kind, rank, start, end, value, removed)."""
    # By entity and term, since an entity of many texts may have many terms that are in one of them each.
    mine = _occurring(found, held).join(telling, ["e", "term"]).groupBy("h", "term").agg(F.max("ratio").alias("ratio"))
    wanted = found.join(mine.select("h").distinct(), "h", "left_semi")
    rows = wanted.select("h", F.posexplode(_pieces(F.col("text"), TERM)).alias("pos", "p")).select("h", "pos", "p.gap", F.col("p.match").alias("match"))
    placed = _placed(rows, "h").withColumn("term", F.lower("match"))
    hits = placed.join(mine, ["h", "term"]).select(
        "h", F.lit("term").alias("kind"), F.lit(KINDS.index("term")).alias("rank"), "start", "end", F.col("match").alias("value"), (F.col("ratio") >= 1).alias("removed")
    )
    base = spans.select(F.col("h").alias("b_h"), F.col("start").alias("b_start"), F.col("end").alias("b_end"))
    return hits.join(base, F.expr("h = b_h and start < b_end and b_start < end"), "left_anti")


def all_spans(docs: DataFrame, support: int = 1, disclosure: float = 0.8) -> tuple[DataFrame, DataFrame]:
    """(texts, spans): texts (doc_id, text, h), and all spans of each distinct text h."""
    texts = _texts(docs)
    spans, found = base_spans(texts)
    held = holders(spans)
    telling = stage(disclosing(texts, held, found, support, disclosure), "pii-telling")
    more = term_spans(spans, held, found, telling)
    return texts, spans.withColumn("removed", F.lit(False)).unionByName(more)


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def _by_text(spans: DataFrame) -> DataFrame:
    counts = [F.count_if(F.col("kind") == k).alias(f"n_{k}") for k in KINDS]
    listed = F.array_sort(F.collect_list(F.struct("start", "rank", "kind", "end", "removed"))).alias("found")
    return spans.groupBy("h").agg(*counts, listed)


def digest(docs: DataFrame, support: int = 1, disclosure: float = 0.8) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, n_term, n_removed, base_sha256, spans, removed), one row per
    document; removed lists the term spans that go, the other ones are generalised."""
    texts, spans = all_spans(docs, support, disclosure)
    grouped = _by_text(spans)
    found = F.coalesce("found", F.array().cast("array<struct<start: bigint, rank: int, kind: string, end: bigint, removed: boolean>>"))
    base = F.filter(found, lambda s: s["kind"] != "term")
    gone = F.filter(found, lambda s: s["removed"])
    return (
        texts.select("doc_id", "h")
        .join(grouped, "h", "left")
        .select(
            "doc_id",
            *(F.coalesce(f"n_{k}", F.lit(0)).cast("long").alias(f"n_{k}") for k in KINDS),
            F.sha2(_joined(base), 256).alias("base_sha256"),
            _joined(found).alias("spans"),
            F.coalesce(F.size(gone), F.lit(0)).cast("long").alias("n_removed"),
            _joined(gone).alias("removed"),
        )
    )


def sanitise(docs: DataFrame, support: int = 1, disclosure: float = 0.8) -> DataFrame:
    """(doc_id, text): base spans become [email] and so on, telling terms [term], or nothing where they
    tell everything. Spans that begin inside one before are covered by it."""
    texts, spans = all_spans(docs, support, disclosure)
    grouped = _by_text(spans).select("h", "found")
    empty = F.struct(F.lit("").alias("out"), F.lit(0).cast("long").alias("at"))

    def step(acc, s):
        mark = F.when(s["removed"], F.lit("")).otherwise(F.concat(F.lit("["), s["kind"], F.lit("]")))
        gap = F.substring(F.col("text"), (acc["at"] + 1).cast("int"), (s["start"] - acc["at"]).cast("int"))
        taken = F.struct(F.concat(acc["out"], gap, mark).alias("out"), s["end"].alias("at"))
        return F.when(s["start"] >= acc["at"], taken).otherwise(acc)

    walked = F.aggregate(F.col("found"), empty, step)
    rest = F.expr("substring(text, int(walked.at + 1))")
    return (
        texts.join(grouped, "h", "left")
        .withColumn("walked", F.when(F.col("found").isNotNull(), walked))
        .select("doc_id", F.when(F.col("found").isNull(), F.col("text")).otherwise(F.concat(F.col("walked.out"), rest)).alias("text"))
    )
