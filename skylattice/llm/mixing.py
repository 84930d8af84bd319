"""Mixing documents to target weights of domains, with soft membership.

A classifier trained on a labelled table gives every document posteriors p over the domains. Rates
r >= 0 (how often a document is to be read) are then fitted by projected-gradient least squares: expected
domain totals t_d = sum of r n p_d, n being the document's tokens, are to match T_d = weight_d * sum of n.
The squares are taken relative to the mass s_d = sum of n p_d: with that scaling the step 1 is the
largest safe one, since p sums to one, and convergence doesn't depend on how rare a domain is. A step is

    r <- max(0, r - sum over d of p_d (t_d - T_d) / s_d),

so a document's rate follows from its posteriors and the short list of past residuals; only one sum for
each domain comes to the driver in a step, and nothing but the posteriors is stored.

The classifier is naive Bayes over hashed words, its counts taken from a bounded sample of labelled
documents (see `fit`) and shrunk to the words of all domains. All of it is DataFrame functions.

Cases: a null or empty text has no tokens, the prior as posteriors, and a rate like others; domains with
no mass are left out of the squares, as no rate can reach them, and targets above MOST times a domain's mass are lowered; without any labelled document all
domains are equally likely; labels that contradict each other for one doc_id are left out; repeated rows
get a rate each, the same; other columns stay where documents are returned, whatever their names; an empty table
gives an empty result. Targets that can't be met are warned about, with what is left.
"""

from __future__ import annotations

import json
import math
import warnings

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skylattice.llm.common import fresh, stage

#: How many times its mass a domain may be read: a target beyond that would be met by documents that hardly belong
#: to it, at the cost of those that do belong to others.
MOST = 4.0
#: Hash buckets of the words.
BUCKETS = 1 << 13


def _words(text: Column) -> Column:
    """Words between white space, and empty ones, which don't count."""
    return F.split(F.translate(text, "\t\n\x0b\x0c\r", "     "), " ")


def _bucket(word: Column) -> Column:
    return F.pmod(F.xxhash64(word), F.lit(BUCKETS)).cast("int")


def fit(docs: DataFrame, labelled: DataFrame, domains: list[str], sample: int = 6000) -> dict:
    """Log priors and log likelihoods of word buckets for each domain. At most `sample` labelled documents of
    each domain are read, the first by a hash of doc_id; priors are counts of the whole labelled table. What
    comes to the driver are len(domains) * BUCKETS counts at most."""
    clean = (
        labelled.filter(F.col("domain").isin(domains) & F.col("doc_id").isNotNull())
        .groupBy(F.col("doc_id").cast("long").alias("doc_id"))
        .agg(F.min("domain").alias("domain"), F.max("domain").alias("other"))
        .filter("domain = other")
        .select("doc_id", "domain")
    )
    sizes = {r["domain"]: r["n"] for r in clean.groupBy("domain").agg(F.count("*").alias("n")).collect()}
    total = sum(sizes.values())
    chosen = None
    for d in domains:
        part = clean.filter(F.col("domain") == d).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
        chosen = part if chosen is None else chosen.unionByName(part)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    words = texts.join(F.broadcast(chosen), "doc_id").select("domain", F.explode(_words(F.col("text"))).alias("w"))
    counted = words.filter("w <> ''").groupBy("domain", _bucket(F.col("w")).alias("b")).agg(F.count("*").alias("n")).collect()
    counts = {d: [0.0] * BUCKETS for d in domains}
    for r in counted:
        counts[r["domain"]][r["b"]] = float(r["n"])
    masses = {d: sum(counts[d]) for d in domains}
    shared = [1.0 / BUCKETS + sum(counts[d][b] / masses[d] for d in domains if masses[d]) for b in range(BUCKETS)]
    scale = sum(shared)
    shared = [x / scale for x in shared]
    like = []
    for d in domains:
        weight = 0.02 * masses[d] + 1000.0  # pseudo-counts, as many as make a domain's rare words carry nothing
        like.append([round(math.log((counts[d][b] + weight * shared[b]) / ((masses[d] + weight) * shared[b])), 5) for b in range(BUCKETS)])
    prior = [math.log((sizes.get(d, 0) + 1) / (total + len(domains))) for d in domains]
    return {"prior": prior, "like": like}


def posteriors(docs: DataFrame, model: dict, domains: list[str]) -> DataFrame:
    """(doc_id, h, copies, n_tokens, p): h stands for the text, copies counts the rows that repeat both, p is an
    array in the order of domains."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    table = [F.from_json(F.lit(json.dumps(x)), "array<double>") for x in model["like"]]
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("h"), text.alias("text")).select("doc_id", "h", F.posexplode(_words(F.col("text"))).alias("at", "w"))
    hashed = keyed.select("doc_id", "h", (F.col("at") == 0).cast("long").alias("head"), (F.col("w") != "").cast("long").alias("one"), _bucket(F.col("w")).alias("b"))
    sums = [F.sum(F.when(F.col("one") == 1, F.get(t, F.col("b"))).otherwise(0.0)).alias(f"l{i}") for i, t in enumerate(table)]
    summed = hashed.groupBy("doc_id", "h").agg(F.sum("head").alias("copies"), F.sum("one").alias("n"), *sums)
    summed = summed.withColumn("n_tokens", F.expr("n div copies"))
    logits = [F.lit(p) + F.col(f"l{i}") / F.col("copies") for i, p in enumerate(model["prior"])]
    top = F.greatest(*logits) if len(logits) > 1 else logits[0]
    scored = summed.select("doc_id", "h", "copies", "n_tokens", F.array(*logits).alias("z"), top.alias("top"))
    parts = scored.select("doc_id", "h", "copies", "n_tokens", F.transform("z", lambda z: F.exp(F.greatest(z - F.col("top"), F.lit(-60.0)))).alias("x"))
    return parts.select(
        "doc_id", "h", "copies", "n_tokens", F.transform("x", lambda x: x / F.aggregate("x", F.lit(0.0).cast("double"), lambda a, b: a + b)).alias("p")
    )


def rate_of(steps: list[list[float]]) -> Column:
    """A document's rate after the given steps, from its posteriors p."""
    if not steps:
        return F.lit(1.0)
    listed = F.from_json(F.lit(json.dumps(steps)), "array<array<double>>")
    dot = lambda e: sum((F.get(F.col("p"), F.lit(i)) * F.get(e, F.lit(i)) for i in range(1, len(steps[0]))), F.get(F.col("p"), F.lit(0)) * F.get(e, F.lit(0)))
    return F.aggregate(listed, F.lit(1.0).cast("double"), lambda r, e: F.greatest(F.lit(0.0), r - dot(e)))


def reachable(weights: list[float], masses: list[float], total: float, most: float) -> list[float]:
    """Totals to aim at: the weights' shares of all tokens, but of no domain more than `most` times its mass; what such
    a domain can't take goes to the others by their weights."""
    scale = sum(weights)
    out = [w / scale * total for w in weights]
    open_ones = set(range(len(weights)))
    while over := [k for k in open_ones if out[k] > most * masses[k]]:
        for k in over:
            out[k] = most * masses[k]
            open_ones.discard(k)
        rest, scale = total - sum(out[k] for k in range(len(out)) if k not in open_ones), sum(weights[k] for k in open_ones)
        for k in open_ones:
            out[k] = rest * weights[k] / scale if scale else 0.0
    return out


def solve(members: DataFrame, weights: list[float], rounds: int = 40, close: float = 1e-4, most: float = MOST) -> tuple[list[list[float]], float]:
    """The steps that fit rates for members(copies, n_tokens, p), residuals relative to each domain's mass; and what
    is left between totals and targets, as a share of all tokens. Domains without mass count in it."""
    each = range(len(weights))
    tokens = F.col("copies") * F.col("n_tokens")
    mass = members.agg(F.sum(tokens).alias("n"), *(F.sum(tokens * F.get("p", F.lit(i))).alias(f"s{i}") for i in each)).first()
    total = float(mass["n"] or 0)
    if total == 0:
        return [], 0.0
    masses = [float(mass[f"s{i}"]) for i in each]
    share = reachable(weights, masses, total, most)
    reached, steps = list(masses), []
    for _ in range(rounds):
        if sum(abs(t - want) for t, want, s in zip(reached, share, masses) if s > 1e-9 * total) <= close * total:
            break
        steps.append([(t - want) / s if s > 1e-9 * total else 0.0 for t, want, s in zip(reached, share, masses)])
        rated = members.select(tokens.alias("tokens"), "p", rate_of(steps).alias("rate"))
        row = rated.agg(*(F.sum(F.col("rate") * F.col("tokens") * F.get("p", F.lit(i))).alias(f"t{i}") for i in each)).first()
        reached = [float(row[f"t{i}"]) for i in each]
    return steps, sum(abs(t - w / sum(weights) * total) for t, w in zip(reached, weights)) / total


def _members(docs: DataFrame, labelled: DataFrame, targets: dict[str, float], sample: int, rounds: int) -> DataFrame:
    domains = sorted(targets)
    members = stage(posteriors(docs, fit(docs, labelled, domains, sample), domains), "mix-members")
    steps, gap = solve(members, [targets[d] for d in domains], rounds)
    if gap > 1e-3:
        warnings.warn(f"mixing: totals miss the targets by {gap:.4f} of all tokens after {len(steps)} steps", stacklevel=3)
    return members.withColumn("rate", rate_of(steps))


def rates(docs: DataFrame, labelled: DataFrame, targets: dict[str, float], sample: int = 6000, rounds: int = 40) -> DataFrame:
    """labelled(doc_id, domain), targets: weights of domains. (doc_id, n_tokens, p, rate), one row per document.
    Warns if the targets can't be met."""
    found = _members(docs, labelled, targets, sample, rounds)
    return found.select("doc_id", "n_tokens", "p", "rate", F.explode(F.expr("sequence(1L, copies)")).alias("copy")).drop("copy")


def mix(docs: DataFrame, labelled: DataFrame, targets: dict[str, float], sample: int = 6000, rounds: int = 40) -> DataFrame:
    """docs with a column rate added, in place of one of that name; documents with rate zero go."""
    key, h, rate = fresh(docs.columns, "id", "h", "rate")
    found = _members(docs, labelled, targets, sample, rounds).filter("rate > 0")
    found = found.select(F.col("doc_id").alias(key), F.col("h").alias(h), F.col("rate").alias(rate))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    joined = docs.join(found.hint("shuffle_hash"), F.col("doc_id").cast("long").eqNullSafe(F.col(key)) & (F.xxhash64(text) == F.col(h)))
    return joined.select(*(F.col(f"`{c}`") for c in docs.columns if c != "rate"), F.col(rate).alias("rate"))


def quality_domains(labels: DataFrame) -> DataFrame:
    """(doc_id, domain): junk, toxic or clean, from labels(doc_id, quality, toxic)."""
    kind = F.when(F.col("quality") == 0, "junk").when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 1, "clean")
    return labels.select("doc_id", kind.alias("domain"))


#: Target weights of the production query and the pipeline.
TARGETS = {"clean": 0.90, "junk": 0.06, "toxic": 0.04}
