"""Secrets in texts: long tokens and assigned values as candidates, a random forest to drop the false ones.

Candidates are runs of at least 16 characters of the alphabets that keys are written in, and values of at least
eight characters behind an assignment sign. The forest judges length, character classes and transitions,
dictionary coverage, the path (the column that says where a text is from), and the words and signs beside. It
is trained from labelled findings: a table of (token, before, after, path, label). Where none is given,
`planted_findings` makes one: secrets of known kinds and look-alikes (digests, numbers, identifiers, words of
the corpus), each set at random into contexts that both labels share, so that what makes the label is no
feature. Counts of words and transitions are of all documents. All of it is DataFrame functions and Spark ML
on DataFrames.

Cases: null and empty texts have no candidates; a null path is empty; rows that repeat doc_id, text and path
are reported once; rows that repeat a doc_id with another text or path are reported each; without findings of
both labels every candidate is kept, with a null score; other columns are ignored, whatever their names;
an empty table gives an empty result.
"""

from __future__ import annotations

import json
import math
import random
import string

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skylattice.llm.common import drop_stage, fresh, stage

#: A candidate: a whole run, so that it is found once; or a value behind an assignment sign.
TOKEN = r"(?<![A-Za-z0-9+/_\-])[A-Za-z0-9+/_\-]{16,}+={0,2}+|(?<=[=:]\x20?[\"'`]?)[^\s\"'`,;<>()\[\]{}|=:]{8,}+"
#: Words of the dictionary.
WORD = r"(?<!\p{L})\p{L}{4,24}+(?!\p{L})"
#: Pieces of a token that words are looked up in.
PIECE = r"\p{Lu}?\p{Ll}++|\p{Lu}++"
#: The share of all documents that a word of the dictionary is in, at least.
COMMON = 1e-4
# Words beside secrets, words beside look-alikes, and signs of where a text is from.
KEYWORDS = ("token", "secret", "password", "passwd", "pwd", "key", "api_key", "apikey", "access_key", "auth", "bearer", "credential")
HARMLESS = ("commit", "sha", "checksum", "digest", "hash", "md5", "id", "uuid", "order", "invoice", "number", "phone", "card", "version", "class", "file")
SETTINGS = r"(?i)(\.env|\.ini|\.cfg|\.conf|\.pem|\.properties|\.ya?ml|\.json|config|settings|secret|credential)"
PROSE = r"(?i)(\.md|\.txt|\.html?|\.rst|readme|docs?/|wiki|news|blog)"
#: Character classes of transitions: 26 letters of either case, other letters, digits, and the rest.
CLASSES = 29


def candidates(docs: DataFrame, path: str | None = "source") -> DataFrame:
    """(doc_id, h, start, end, token, before, after, path): every candidate, with the text beside it up to the
    candidates (or the ends) around it: before ends at it, and holds its last words; after begins behind it."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    where = F.coalesce(F.col(path).cast("string"), F.lit("")) if path and path in docs.columns else F.lit("")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), where.alias("path"))
    tokens = F.regexp_extract_all("text", F.lit(TOKEN), F.lit(0))
    found = rows.select("doc_id", "path", "text", tokens.alias("tokens")).filter(F.size("tokens") > 0)
    found = found.select("doc_id", "path", F.xxhash64("text").alias("h"), "tokens", F.split("text", TOKEN, -1).alias("gaps"))
    # Backwards, the last words are found at once, however long the gap; both ends stop at the words they need.
    before = lambda g: F.reverse(F.regexp_extract(F.reverse(g), r"^[^\p{L}_]*+[\p{L}_]*+[^\p{L}_]?", 0))
    after = lambda g: F.regexp_extract(g, r"^[^\p{L}_]*+[\p{L}_]*+", 0)
    ends = F.transform("gaps", lambda g: F.struct(F.length(g).alias("gap"), before(g).alias("before"), after(g).alias("after")))
    found = found.select("doc_id", "path", "h", "tokens", ends.alias("gaps"))
    one = found.select("doc_id", "path", "h", "gaps", F.posexplode("tokens").alias("pos", "token"))
    one = one.select(
        "doc_id", "path", "h", "pos", "token",
        F.get("gaps", F.col("pos"))["gap"].alias("gap"),
        F.get("gaps", F.col("pos"))["before"].alias("before"),
        F.get("gaps", F.col("pos") + 1)["after"].alias("after"),
    ).distinct()
    upto = Window.partitionBy("doc_id", "h", "path").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = one.withColumn("end", F.sum(F.col("gap") + F.length("token")).over(upto))
    return placed.select("doc_id", "h", (F.col("end") - F.length("token")).alias("start"), "end", "token", "before", "after", "path")


def dictionary(docs: DataFrame, common: float = COMMON) -> DataFrame:
    """(word, n): words that are in the given share of all documents at least, and in two."""
    words = F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(F.col("text").cast("string"), F.lit(""))), F.lit(WORD), F.lit(0)))
    counts = docs.select(F.explode(words).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    total = docs.agg(F.greatest(F.lit(2), F.count("*") * common).alias("least"))
    return counts.join(F.broadcast(total), F.expr("n >= least")).select("word", "n")  # one row


def _class(c: Column) -> Column:
    letter = F.instr(F.lit(string.ascii_lowercase), F.lower(c))
    other = F.when(c.rlike(r"^\p{L}"), 26).when(c.rlike("^[0-9]"), 27).otherwise(28)
    return F.when(letter > 0, letter - 1).otherwise(other)


def _transitions(text: Column) -> Column:
    """Numbers of the pairs of classes of neighbouring characters."""
    kinds = F.transform(F.split(text, ""), _class)
    return F.zip_with(F.slice(kinds, 1, F.greatest(F.size(kinds) - 1, F.lit(0))), F.slice(kinds, 2, F.greatest(F.size(kinds) - 1, F.lit(0))), lambda a, b: a * CLASSES + b)


def transitions(words: DataFrame) -> list[float]:
    """Log probabilities of the next character's class in the dictionary's words: CLASSES ** 2 numbers."""
    found = words.filter("length(word) > 1").select("n", F.explode(_transitions(F.col("word"))).alias("t")).groupBy("t").agg(F.sum("n").alias("n")).collect()
    counts = {r["t"]: float(r["n"]) for r in found}
    out = []
    for a in range(CLASSES):
        row = [counts.get(a * CLASSES + b, 0.0) for b in range(CLASSES)]
        total = sum(row)
        out += [round(math.log((x + 0.01 * total + 0.1) / (1.29 * total + 2.9)), 4) for x in row]
    return out


def coverage(tokens: DataFrame, words: DataFrame) -> DataFrame:
    """tokens(token): (token, covered), the share of its characters in the longest word of the dictionary at the
    start and at the end of each of its pieces."""
    pieces = tokens.select("token").distinct().select("token", F.explode(F.regexp_extract_all("token", F.lit(PIECE), F.lit(0))).alias("raw"))
    pieces = pieces.select("token", F.lower("raw").alias("piece")).filter("length(piece) >= 4")
    kinds = pieces.select("piece").distinct()
    cut = kinds.select("piece", F.explode(F.expr("sequence(4, least(24, length(piece)))")).alias("k"))
    parts = cut.select("piece", "k", F.explode(F.array(F.struct(F.lit(True).alias("first"), F.expr("left(piece, k)").alias("word")), F.struct(F.lit(False).alias("first"), F.expr("right(piece, k)").alias("word")))).alias("p"))
    hits = parts.select("piece", "k", "p.first", "p.word").join(words.select("word"), "word")
    ends = hits.groupBy("piece").agg(F.coalesce(F.max(F.when(F.col("first"), F.col("k"))), F.lit(0)).alias("a"), F.coalesce(F.max(F.when(~F.col("first"), F.col("k"))), F.lit(0)).alias("b"))
    ends = ends.select("piece", F.least(F.length("piece"), F.col("a") + F.col("b")).alias("letters"))
    return pieces.join(ends, "piece").groupBy("token").agg(F.sum("letters").alias("letters")).select("token", (F.col("letters") / F.length("token")).alias("covered"))


def features(found: DataFrame, words: DataFrame, steps: list[float]) -> tuple[DataFrame, list[str]]:
    """Feature columns for rows (token, before, after, path)."""
    n = F.length("token").cast("double")
    share = lambda pattern: F.regexp_count("token", F.lit(pattern)) / n
    before = F.lower(F.regexp_extract("before", r"([\p{L}_]+)[^\p{L}_]*$", 1))
    after = F.lower(F.regexp_extract("after", r"^[^\p{L}_]*([\p{L}_]+)", 1))
    table = F.from_json(F.lit(json.dumps(steps)), "array<double>")
    likely = F.aggregate(_transitions(F.col("token")), F.lit(0.0).cast("double"), lambda a, t: a + F.get(table, t.cast("int")))
    columns = {
        "f_length": F.log1p(n),
        "f_digits": share("[0-9]"),
        "f_upper": share("[A-Z]"),
        "f_hex": share("[0-9a-fA-F]"),
        "f_signs": share(r"[+/=_\-]"),
        "f_other": share(r"[^A-Za-z0-9+/=_\-]"),
        "f_letter_digit": share("[A-Za-z](?=[0-9])"),
        "f_digit_letter": share("[0-9](?=[A-Za-z])"),
        "f_case": share("[a-z](?=[A-Z])"),
        "f_likely": likely / F.greatest(n - 1, F.lit(1.0)),
        "f_kinds": F.size(F.array_distinct(F.split("token", ""))) / n,
        "f_vowels": share("[aeiouAEIOU]"),
        "f_dashes": F.regexp_like("token", F.lit(r"^[0-9a-fA-F]{8}-([0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}$")).cast("double"),
        "f_quoted": F.regexp_like("before", F.lit(r"[\"'`]$")).cast("double"),
        "f_assigned": F.regexp_like("before", F.lit(r"[=:]\s*[\"'`]?$")).cast("double"),
        "f_keyword": before.isin(*KEYWORDS).cast("double"),
        "f_harmless": before.isin(*HARMLESS).cast("double"),
        "f_followed": (after != "").cast("double"),
        "f_settings": F.regexp_like("path", F.lit(SETTINGS)).cast("double"),
        "f_prose": F.regexp_like("path", F.lit(PROSE)).cast("double"),
    }
    made = found.select("*", *(F.coalesce(c.cast("double"), F.lit(0.0)).alias(k) for k, c in columns.items()))
    made = made.join(coverage(found, words).withColumnRenamed("covered", "f_covered"), "token", "left").fillna(0.0, ["f_covered"])
    return made, [*columns, "f_covered"]


#: Kinds of planted secrets and look-alikes.
SECRET_KINDS = ("hex", "base64", "prefixed", "cloud", "password", "signed")
HARMLESS_KINDS = ("digest", "uuid", "number", "identifier", "word", "phrase", "date")


def _planted(r: random.Random, kind: str, words: list[str]) -> str:
    alnum, hexa = string.ascii_letters + string.digits, "0123456789abcdef"
    draw = lambda letters, n: "".join(r.choices(letters, k=n))
    if kind in ("hex", "digest"):
        text = draw(hexa, r.choice((32, 40, 64)))
        return text.upper() if r.random() < 0.2 else text
    if kind == "base64":
        return draw(alnum + "+/", r.choice((24, 32, 43, 64))) + r.choice(("", "=", "=="))
    if kind == "prefixed":
        return r.choice(("sk_live_", "ghp_", "glpat-", "xoxb-", "pk_test_")) + draw(alnum, r.randint(20, 36))
    if kind == "cloud":
        return r.choice(("AKIA", "ASIA", "AIza")) + draw(string.ascii_uppercase + string.digits, r.randint(16, 32))
    if kind == "password":
        return draw(alnum + "!@#$%^&*?", r.randint(8, 15))
    if kind == "signed":
        return "eyJ" + draw(alnum + "_-", r.randint(30, 90))
    if kind == "uuid":
        text = draw(hexa, 32)
        return "-".join((text[:8], text[8:12], text[12:16], text[16:20], text[20:]))
    if kind == "number":
        return draw(string.digits, r.randint(16, 20))
    if kind == "identifier":
        parts = r.choices(words, k=r.randint(3, 4))
        return "_".join(parts) if r.random() < 0.5 else parts[0] + "".join(p.capitalize() for p in parts[1:])
    if kind == "word":
        text = ""
        while len(text) < 16:
            text += r.choice(words)
        return text.capitalize() if r.random() < 0.2 else text
    if kind == "phrase":
        return "-".join(r.choices(words, k=r.randint(4, 6)))
    return f"{r.randint(1990, 2030)}-{r.randint(10, 12)}-{r.randint(10, 28)}T{r.randint(10, 23)}-{r.randint(10, 59)}-{r.randint(10, 59)}"


def planted_findings(spark: SparkSession, words: list[str], n: int = 6000, seed: int = 11) -> DataFrame:
    """(token, before, after, path, label, kind): n findings, half of them secrets. A digest and a hexadecimal
    key look alike, so only where they stand can tell them apart; every kind stands in every kind of place, with
    other odds."""
    r = random.Random(seed)
    words = words or ["alpha", "because", "common", "during", "every", "forward"]
    paths = ("app/.env", "config/settings.yml", "deploy/values.json", "README.md", "docs/guide.html", "news.txt", "src/main.py", "")
    rows = []
    for i in range(n):
        secret = i % 2 == 0
        kind = r.choice(SECRET_KINDS if secret else HARMLESS_KINDS)
        word = r.choice(words)
        odds = (0.75, 0.05) if secret else (0.12, 0.35 if kind in ("digest", "uuid", "number", "date") else 0.05)
        x = r.random()
        beside = r.choice(KEYWORDS) if x < odds[0] else r.choice(HARMLESS) if x < sum(odds) else word
        assigned = kind == "password" or r.random() < (0.75 if secret else 0.3)
        quote = r.choice(("", "'", '"'))
        before = f" {beside}{r.choice((' = ', '=', ': '))}{quote}" if assigned else f" {beside}{r.choice((' ', ', ', ' (', '. '))}"
        after = (quote if assigned else "") + r.choice(("", "\n", f" {r.choice(words)}"))
        path = r.choice(paths[:4] if secret and r.random() < 0.4 else paths)
        rows.append((_planted(r, kind, words), before, after, path, float(secret), kind))
    return spark.createDataFrame(rows, "token string, before string, after string, path string, label double, kind string")


def some_words(words: DataFrame, n: int = 400) -> list[str]:
    """Words of the dictionary to make look-alikes of: a bounded sample, the first by a hash."""
    return [r["word"] for r in words.orderBy(F.xxhash64("word"), "word").limit(n).collect()]


def train(findings: DataFrame, words: DataFrame, steps: list[float], trees: int = 30, depth: int = 8):
    """The forest, or None without findings of both labels."""
    rows, names = features(findings.filter("label in (0, 1)").select("token", "before", "after", "path", F.col("label").cast("double").alias("label")), words, steps)
    rows = stage(VectorAssembler(inputCols=names, outputCol="_features").transform(rows).select("_features", "label"), "secret-findings")
    if rows.select("label").distinct().count() < 2:
        drop_stage(rows)
        return None
    # Rows in a fixed order, so that the trees are the same in every run.
    rows = rows.coalesce(1).sortWithinPartitions("label", F.xxhash64(vector_to_array("_features")))
    forest = RandomForestClassifier(featuresCol="_features", labelCol="label", numTrees=trees, maxDepth=depth, seed=7, maxMemoryInMB=64)
    return forest.fit(rows)


def judged(found: DataFrame, model, words: DataFrame, steps: list[float]) -> DataFrame:
    """found with a column score."""
    rows, names = features(found, words, steps)
    made = model.transform(VectorAssembler(inputCols=names, outputCol="_features").transform(rows))
    return made.select(*found.columns, F.get(vector_to_array("probability"), F.lit(1)).alias("score"))


def scan(docs: DataFrame, findings: DataFrame | None = None, path: str | None = "source", threshold: float = 0.5) -> DataFrame:
    """(doc_id, start, end, token, score, secret): all candidates of all documents, judged."""
    found = stage(candidates(docs, path), "secret-candidates")
    words = stage(dictionary(docs), "secret-words")
    steps = transitions(words)
    model = train(planted_findings(docs.sparkSession, some_words(words)) if findings is None else findings, words, steps)
    if model is None:
        return found.select("doc_id", "start", "end", "token", F.lit(None).cast("double").alias("score"), F.lit(True).alias("secret"))
    return judged(found, model, words, steps).select("doc_id", "start", "end", "token", "score", (F.col("score") >= threshold).alias("secret"))


def redact(docs: DataFrame, found: DataFrame) -> DataFrame:
    """docs with secrets of scan() replaced by [secret] in text, and all columns; for tables whose doc_ids don't
    repeat."""
    key, listed, walked = fresh(docs.columns, "id", "spans", "walked")
    spans = found.filter("secret").groupBy(F.col("doc_id").alias(key)).agg(F.array_sort(F.collect_set(F.struct("start", "end"))).alias(listed))
    joined = docs.join(spans, F.col("doc_id").cast("long") == F.col(key), "left")
    empty = F.struct(F.lit("").alias("out"), F.lit(0).cast("long").alias("at"))

    def step(acc, s):
        gap = F.substring(F.col("text"), (acc["at"] + 1).cast("int"), (s["start"] - acc["at"]).cast("int"))
        return F.struct(F.concat(acc["out"], gap, F.lit("[secret]")).alias("out"), s["end"].cast("long").alias("at"))

    joined = joined.withColumn(walked, F.when(F.col(listed).isNotNull(), F.aggregate(listed, empty, step)))
    rest = F.expr(f"substring(text, int({walked}.at + 1))")
    text = F.when(F.col(listed).isNull(), F.col("text")).otherwise(F.concat(F.col(f"{walked}.out"), rest))
    return joined.select(*(text.alias("text") if c == "text" else F.col(f"`{c}`") for c in docs.columns))
