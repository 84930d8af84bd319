"""Near-duplicates by the Jaccard similarity of word shingles: pairs at or above a limit count.

SimHash comes first: each set of shingles has a fingerprint of 64 bits, and the pigeonhole blocks of simhash.py find
those within DISTANCE bits. At a similarity of 0.8 some ten bits differ and eighteen may, though, and blocks that such
pairs surely share (three bits) would hold everything, so it finds the closest pairs only. The rest are found by a
fingerprint of min-hashes, ROWS to a block: two sets of similarity t agree on a block with probability t**ROWS, and
share one of BLOCKS with 1 - (1 - t**ROWS)**BLOCKS, which is 0.99997 at 0.8 and 0.998 at 0.72. Pairs of either kind are
verified exactly, by their sets. Before that, their sizes and a bitmap of parities (it differs in as many bits as the
sets differ in shingles, at most) rule pairs out. Equal sets are reduced to one first. Each set is compared with the
first of its SimHash, this one along SimHash links, and each with one leader of its buckets of min-hashes. Where a
bucket then still holds several components, its sets meet in tiles: each pair of tiles is a group of bounded size that
yields a forest of its links, never its pairs.

Cases: a null text counts as empty; texts without words are equal; texts of fewer words than a shingle are
one shingle; rows that repeat a doc_id have one component; a row without doc_id stays and links nothing;
other columns stay, whatever their names; an empty table gives an empty result. Shingles are 64-bit hashes.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skylattice.llm.common import drop_stage, fresh, release_shuffles, stage
from skylattice.llm.graph import components
from skylattice.llm.simhash import fingerprint_links, of_hashes

#: Bits of the parity bitmap, in longs of 64.
LONGS = 4
#: Sets of a bucket that one group pairs with another part of it.
TILE = 256
#: Bits in which fingerprints of a SimHash link may differ.
DISTANCE = 3
#: Blocks of a fingerprint, and min-hashes of a block.
BLOCKS, ROWS = 20, 4
#: Shingles that are min-hashed at once.
CHUNK = 1 << 13


def shingles(text: bytes, words: int) -> np.ndarray:
    """The distinct hashes of the text's shingles, sorted, as signed longs."""
    import xxhash

    found = text.lower().split()
    if not found:
        return np.zeros(0, dtype=np.int64)
    joined = b" ".join(found)
    if len(found) <= words:
        return np.array([xxhash.xxh64_intdigest(joined, 42)], dtype=np.uint64).astype(np.int64)
    lengths = np.fromiter(map(len, found), dtype=np.int64, count=len(found))
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths)[: len(found) - words + 1].tolist()
    digest = xxhash.xxh64_digest
    raw = b"".join([digest(joined[a:b], 42) for a, b in zip(starts, ends[words - 1 :].tolist())])
    return np.unique(np.frombuffer(raw, dtype=">i8").astype(np.int64))


def _identity(found: np.ndarray) -> int:
    import xxhash

    return int(np.uint64(xxhash.xxh64_intdigest(found.tobytes(), 7)).astype(np.int64))


def _factors() -> tuple[np.ndarray, np.ndarray]:
    random = np.random.default_rng(20250117)
    masks, factors = random.integers(0, 1 << 63, size=(2, BLOCKS * ROWS), dtype=np.uint64)
    return masks[:, None], (2 * factors + 1)[:, None]


_MASKS, _FACTORS = _factors()


def blocks(found: np.ndarray) -> np.ndarray:
    """A name for each block of the set's fingerprint; none for the empty set."""
    if not len(found):
        return np.zeros(0, dtype=np.int64)
    values = found.astype(np.uint64)
    least = np.full(BLOCKS * ROWS, np.iinfo(np.uint64).max, dtype=np.uint64)
    for at in range(0, len(values), CHUNK):
        least = np.minimum(least, ((values[None, at : at + CHUNK] ^ _MASKS) * _FACTORS).min(axis=1))
    parts = least.reshape(BLOCKS, ROWS)
    names = np.arange(1, BLOCKS + 1, dtype=np.uint64)
    for i in range(ROWS):
        names = (names ^ parts[:, i]) * np.uint64(0x9E3779B97F4A7C15)
        names ^= names >> np.uint64(29)
    return names.astype(np.int64)


def parities(found: np.ndarray) -> np.ndarray:
    odd = np.bincount(found & (64 * LONGS - 1), minlength=64 * LONGS) & 1
    return np.packbits(odd.astype(np.uint8)).view(">i8").astype(np.int64)


def _lists(rows: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, rows)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(rows) if rows else [], pa.int64()))


def sets(docs: DataFrame, words: int) -> DataFrame:
    """(id, shingles) of docs(text), id standing for the set."""

    def batches(it):
        for batch in it:
            found = [shingles(t.as_py() or b"", words) for t in batch.column(0).cast(pa.large_binary())]
            ids = pa.array([_identity(x) for x in found], pa.int64())
            yield pa.RecordBatch.from_arrays([ids, _lists(found)], names=["id", "shingles"])

    return docs.select(F.col("text").cast("string")).mapInArrow(batches, "id long, shingles array<long>")


def sketches(docs: DataFrame, words: int) -> DataFrame:
    """(doc_id, id, n, map, blocks, fp) of each document; fp is the SimHash of its set as a signed long."""

    def batches(it):
        for batch in it:
            found = [shingles(t.as_py() or b"", words) for t in batch.column(1).cast(pa.large_binary())]
            columns = [
                batch.column(0),
                pa.array([_identity(x) for x in found], pa.int64()),
                pa.array([len(x) for x in found], pa.int32()),
                _lists([parities(x) for x in found]),
                _lists([blocks(x) for x in found]),
                pa.array(np.array([of_hashes(x) for x in found], dtype=np.uint64).astype(np.int64)),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "id", "n", "map", "blocks", "fp"])

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).filter("doc_id is not null")
    return rows.mapInArrow(batches, "doc_id long, id long, n int, map array<long>, blocks array<long>, fp long")


def _differing(a: str, b: str) -> str:
    return "(" + " + ".join(f"bit_count({a}[{i}] ^ {b}[{i}])" for i in range(LONGS)) + ")"


def _plausible(a: tuple[str, str], b: tuple[str, str], t: float) -> Column:
    """Whether sets of (size, bitmap) may be similar enough."""
    (n, m), (k, o) = a, b
    sizes = f"least({n}, {k}) >= {t} * greatest({n}, {k}) - 1e-9"
    return F.expr(f"{sizes} and {_differing(m, o)} <= ({n} + {k}) * {(1 - t) / (1 + t)!r} + 1e-9")


def similar(pairs: DataFrame, docs: DataFrame, firsts: DataFrame, words: int, t: float) -> DataFrame:
    """pairs(u, v) of set ids: those of similarity t or more. firsts(id, first_doc): where a set's text is."""
    ids = pairs.select(F.col("u").alias("id")).union(pairs.select("v")).distinct()
    needed = stage(ids.join(firsts, "id"), "similar-needed")
    texts = docs.join(needed.select("first_doc").distinct(), docs["doc_id"].cast("long") == F.col("first_doc"), "left_semi")
    held = stage(sets(texts, words).join(needed.select("id"), "id", "left_semi").dropDuplicates(["id"]), "similar-sets")
    side = lambda x, s: held.select(F.col("id").alias(x), F.col("shingles").alias(s))
    both = F.size(F.array_intersect("a", "b"))
    found = pairs.join(side("u", "a"), "u").join(side("v", "b"), "v").filter(both / (F.size("a") + F.size("b") - both) >= t)
    out = stage(found.select("u", "v"), "similar-links")
    drop_stage(needed)
    drop_stage(held)
    release_shuffles(docs.sparkSession)
    return out


def common(sets_: list[np.ndarray], columns: int = 1 << 13) -> np.ndarray:
    """How many shingles each two of the sets share: products of a 0/1 matrix, some columns at a time, without the
    shingles that only one set has."""
    sizes = np.array([len(x) for x in sets_], dtype=np.int64)
    owner = np.repeat(np.arange(len(sets_)), sizes)
    _, which, times = np.unique(np.concatenate(sets_) if len(sets_) else np.empty(0), return_inverse=True, return_counts=True)
    shared = times[which] > 1
    number = np.cumsum(times > 1) - 1
    owner, which = owner[shared], number[which[shared]]
    order = np.argsort(which, kind="stable")
    owner, which = owner[order], which[order]
    out = np.zeros((len(sets_), len(sets_)), dtype=np.int64)
    for low in range(0, int(which[-1]) + 1 if len(which) else 0, columns):
        begin, end = np.searchsorted(which, [low, low + columns])
        part = np.zeros((len(sets_), columns), dtype=np.float32)
        part[owner[begin:end], which[begin:end] - low] = 1.0
        out += (part @ part.T).astype(np.int64)
    return out


def forest(pdf: pd.DataFrame, t: float) -> pd.DataFrame:
    """Edges (u, v) that join what similar pairs of different components g, and different tiles if the group has two,
    join; fewer than the group's members."""
    ids, g, own = (pdf[c].to_numpy() for c in ("id", "g", "own"))
    sets_ = [np.asarray(x, dtype=np.int64) for x in pdf["shingles"]]
    sizes = np.array([len(x) for x in sets_])
    both = common(sets_)
    near = both >= t * (sizes[:, None] + sizes[None, :] - both) - 1e-9
    near &= g[:, None] != g[None, :]
    if pdf["p"].iat[0] != pdf["q"].iat[0]:
        near &= own[:, None] != own[None, :]
    parent = {x: x for x in g.tolist()}

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    edges = []
    for i, j in zip(*np.nonzero(np.triu(near))):
        a, b = root(g[i]), root(g[j])
        if a != b:
            parent[b] = a
            edges.append((ids[i], ids[j]))
    return pd.DataFrame(edges, columns=["u", "v"], dtype="int64")


def simhash_pairs(kinds: DataFrame, t: float) -> DataFrame:
    """kinds(id, n, map, fp): pairs (id, leader) that SimHash links and that may be similar enough: each set with the
    first of its fingerprint, and the first ones of linked fingerprints."""
    firsts = stage(kinds.groupBy("fp").agg(F.min("id").alias("first")), "similar-fps")
    edges = fingerprint_links(firsts.select("fp"), DISTANCE)
    end = lambda x, name: firsts.select(F.col("fp").alias(x), F.col("first").alias(name))
    across = edges.join(end("u", "id"), "u").join(end("v", "leader"), "v").select("id", "leader")
    within = kinds.select("id", "fp").join(firsts, "fp").filter("id <> first").select("id", F.col("first").alias("leader"))
    facts = kinds.select("id", "n", "map")
    led = across.union(within).join(facts, "id")
    led = led.join(facts.select(F.col("id").alias("leader"), F.col("n").alias("k"), F.col("map").alias("o")), "leader").filter(_plausible(("n", "map"), ("k", "o"), t))
    out = stage(led.select("id", "leader"), "similar-simhash")
    for x in (firsts, edges):
        drop_stage(x)
    return out


def links(kinds: DataFrame, docs: DataFrame, words: int, t: float) -> DataFrame:
    """kinds(id, n, map, blocks, fp, first_doc): edges (u, v) whose components are those of all similar pairs."""
    printed = simhash_pairs(kinds, t)
    keyed = kinds.select("id", F.explode("blocks").alias("x"))
    sizes = keyed.groupBy("x").agg(F.count("*").alias("c"), F.min_by("id", F.struct(F.xxhash64("x", "id"), "id")).alias("leader")).filter("c > 1")
    shared = stage(keyed.join(sizes, "x"), "similar-shared")
    release_shuffles(docs.sparkSession)
    firsts, facts = kinds.select("id", "first_doc"), kinds.select("id", "n", "map")

    led = shared.filter("id <> leader").select("id", "leader").distinct().join(facts, "id")
    led = led.join(facts.select(F.col("id").alias("leader"), F.col("n").alias("k"), F.col("map").alias("o")), "leader").filter(_plausible(("n", "map"), ("k", "o"), t))
    best = led.groupBy("id").agg(F.min_by("leader", F.struct(F.expr(_differing("map", "o")), "leader")).alias("v"))
    best = best.union(printed)
    first_pairs = stage(best.select(F.least("id", "v").alias("u"), F.greatest("id", "v").alias("v")).distinct(), "similar-led")
    near = similar(first_pairs, docs, firsts, words, t)

    known = components(near).withColumnRenamed("node", "id")
    tagged = stage(shared.select("x", "id", "c").join(known, "id", "left").select("x", "id", "c", F.coalesce("component", "id").alias("g")), "similar-tagged")
    mixed = tagged.groupBy("x").agg(F.min("g").alias("g0"), F.max("g").alias("g1")).filter("g0 <> g1").select("x")
    rows = stage(tagged.join(mixed, "x", "left_semi"), "similar-mixed")
    needed = rows.select("id").distinct().join(firsts, "id")
    texts = docs.join(needed.select("first_doc").distinct(), docs["doc_id"].cast("long") == F.col("first_doc"), "left_semi")
    held = stage(sets(texts, words).dropDuplicates(["id"]), "similar-sets")
    tiles = F.ceil(F.col("c") / TILE).cast("int")
    rows = rows.select("x", "id", "g", F.pmod(F.xxhash64("id"), tiles).cast("int").alias("own"), tiles.alias("tiles"))
    # Each pair of tiles is a group of its own, so none grows with its bucket.
    dealt = rows.withColumn("other", F.explode(F.expr("sequence(0, tiles - 1)"))).select(
        "x", "id", "g", "own", F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q")
    )
    grouped = dealt.join(held, "id").groupBy("x", "p", "q")
    more = stage(grouped.applyInPandas(lambda pdf: forest(pdf, t), "u long, v long").distinct(), "similar-forest")
    for x in (printed, shared, first_pairs, tagged, rows, held):
        drop_stage(x)
    release_shuffles(docs.sparkSession)
    return near.union(more)


def near_duplicates(docs: DataFrame, shingle_words: int = 5, similarity: float = 0.8) -> DataFrame:
    """(doc_id, component_id): the smallest doc_id reachable over pairs of at least that similarity."""
    prints = stage(sketches(docs, shingle_words), "similar-prints")
    facts = [F.first(c).alias(c) for c in ("n", "map", "blocks", "fp")]
    kinds = stage(prints.groupBy("id").agg(F.min("doc_id").alias("first_doc"), *facts), "similar-kinds")
    release_shuffles(docs.sparkSession)
    # Rows that repeat a doc_id have one component.
    ids = prints.select("doc_id", "id")
    repeats = ids.groupBy("doc_id").agg(F.min("id").alias("u"), F.max("id").alias("v")).filter("u <> v").select("doc_id", "u")
    same = ids.join(repeats, "doc_id").select("u", F.col("id").alias("v"))
    joined = components(links(kinds, docs, shingle_words, similarity).union(same)).withColumnRenamed("node", "id")
    grouped = kinds.select("id", "first_doc").join(joined, "id", "left").select("id", "first_doc", F.coalesce("component", "id").alias("component"))
    least = grouped.groupBy("component").agg(F.min("first_doc").alias("component_id"))
    out = stage(ids.join(grouped.join(least, "component").select("id", "component_id"), "id").select("doc_id", "component_id"), "similar-classes")
    for x in (prints, kinds):
        drop_stage(x)
    release_shuffles(docs.sparkSession)
    return out


def drop_near_duplicates(docs: DataFrame, shingle_words: int = 5, similarity: float = 0.8) -> DataFrame:
    """The documents without all but the first (smallest doc_id) of each group; columns stay. Of rows that
    repeat the first doc_id, all stay."""
    (name,) = fresh(docs.columns, "gone")
    found = near_duplicates(docs, shingle_words, similarity)
    gone = found.filter("doc_id <> component_id").select(F.col("doc_id").alias(name)).distinct()
    return docs.join(gone, F.col("doc_id").cast("long") == F.col(name), "left_anti")
