"""Removal of repeated byte strings by distributed prefix doubling over a sparse suffix array.

Plain prefix doubling ranks every position; its pairs alone would be some twenty times the text. So the
positions that are sorted are a synchronised sample: of each string of the threshold's length the
leftmost smallest hashed 32-gram (its minimiser). Equal strings have their minimiser at the same place,
so nothing is lost. Each sampled position stands for the run of strings that share it, and its rank is
refined at growing reach, here by names (hashes) that Spark groups:

    32 bytes (the minimiser itself) -> 89 bytes (the core that twelve neighbouring strings have in common)
    -> 100 bytes (the strings themselves).

Whatever is unique at one reach cannot repeat at a longer one and is dropped. Runs that are equal as a
whole are settled at once, without being opened. What is left after the last step is exact: a string
that also starts earlier, by (doc_id, start), is removed.

Cases: a null text is empty; texts shorter than the threshold lose nothing, and matches never cross
documents; rows that repeat a doc_id are documents of their own, in the order of their texts (the
text's hash), and a null doc_id comes first; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skylattice.llm.common import drop_stage, release_shuffles, stage

#: Bytes of the first rank.
GRAM = 32
#: Offsets that share one core at the second reach.
STEP = 12
#: Bytes of a text that are scanned at once; also bounds the packed position below.
CHUNK = 1 << 22


def _mixed() -> np.ndarray:
    values = np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    values ^= values >> np.uint64(29)
    return values * np.uint64(0xBF58476D1CE4E5B9)


_BYTE_HASH = _mixed()


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """Hashes of all GRAM-byte strings, by doubling the reach five times."""
    h = _BYTE_HASH[data]
    reach = 1
    while reach < GRAM:
        factor = np.uint64(0x9E3779B97F4A7C15 + 2 * reach)
        h = h[:-reach] * factor + h[reach:]
        reach *= 2
    h ^= h >> np.uint64(31)
    return h * np.uint64(0x94D049BB133111EB)


def anchors(data: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(position, low, high): sampled positions q of data and the starts low..high of the strings of
    the given length whose minimiser is at q."""
    n = len(data) - length + 1
    if n <= 0:
        empty = np.empty(0, dtype=np.int64)
        return empty, empty, empty
    grams = gram_hashes(data)
    packed = (grams & ~np.uint64((1 << 24) - 1)) | np.arange(len(grams), dtype=np.uint64)
    window, reach = length - GRAM + 1, 1
    while 2 * reach <= window:
        packed = np.minimum(packed[:-reach], packed[reach:])
        reach *= 2
    if reach < window:
        packed = np.minimum(packed[: len(packed) - (window - reach)], packed[window - reach :])
    q = (packed & np.uint64((1 << 24) - 1)).astype(np.int64)
    turns = np.flatnonzero(np.diff(q)) + 1
    low = np.concatenate([[0], turns])
    return q[low], low, np.concatenate([turns - 1, [n - 1]])


def text_anchors(text: bytes, length: int):
    """anchors() of a whole text in chunks that overlap by a string."""
    data = np.frombuffer(text, dtype=np.uint8)
    for at in range(0, max(1, len(data) - length + 1), CHUNK):
        q, low, high = anchors(data[at : at + CHUNK + length - 1], length)
        if len(q):
            yield q + at, low + at, high + at


def _packed(texts: pa.Array):
    return (v.as_py() or b"" for v in texts.cast(pa.large_binary()))


def _ranks(docs: DataFrame, length: int) -> DataFrame:
    """(key, h, q, low, high) for every sampled position."""

    def batches(it):
        from xxhash import xxh3_64_intdigest as digest

        for batch in it:
            keys, hashes, qs, lows, highs = [], [], [], [], []
            for key, text in zip(batch.column(0).to_pylist(), _packed(batch.column(1))):
                for q, low, high in text_anchors(text, length):
                    keys.append(np.full(len(q), key, dtype=np.int64))
                    hashes.append(np.fromiter((digest(text[i : i + GRAM]) for i in q.tolist()), dtype=np.uint64, count=len(q)))
                    qs.append(q)
                    lows.append(q - high)
                    highs.append(q - low)
            if keys:
                columns = [np.concatenate(x) for x in (keys, hashes, qs)]
                ends = [np.concatenate(x).astype(np.int16) for x in (lows, highs)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(columns[0]), pa.array(columns[1].astype(np.int64)), pa.array(columns[2]), pa.array(ends[0]), pa.array(ends[1])],
                    names=["key", "h", "q", "near", "far"],
                )

    return docs.select("key", "text").mapInArrow(batches, "key long, h long, q long, near short, far short")


def _at_places(docs: DataFrame, places: DataFrame, rows_of, schema: str, kinds: list) -> DataFrame:
    """Join each text with its places (key, q, near, far, ...) and yield rows_of(text, *place) for
    each. A group holds the places of one text, so it grows with that text only."""
    columns = [c for c in places.columns if c != "key"]
    grouped = places.groupBy("key").agg(F.collect_list(F.struct(*columns)).alias("at"))
    joined = docs.select("key", "text").join(grouped.hint("shuffle_hash"), "key").select("key", "text", "at")
    names = [x.split()[0] for x in schema.split(",")]

    def batches(it):
        for batch in it:
            rows = []
            for key, text, at in zip(batch.column(0).to_pylist(), _packed(batch.column(1)), batch.column(2)):
                for place in zip(*(f.to_pylist() for f in at.values.flatten())):
                    rows.extend((key, *r) for r in rows_of(text, *place))
                    if len(rows) >= 50000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)
                        rows = []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

    return joined.mapInArrow(batches, schema)


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def _run(text: bytes, q: int, near: int, far: int, h: int, length: int):
    """A run's name: the hash of all its bytes and of its place."""
    from xxhash import xxh3_64_intdigest as digest

    yield q, near, far, h, _signed(digest(text[q - far : q - near + length], near << 16 | far))


def _cores(text: bytes, q: int, near: int, far: int, length: int):
    """The run cut at multiples of STEP: the name of the bytes that the strings of a part share, and
    the name of all bytes of the part."""
    from xxhash import xxh3_64_intdigest as digest

    for j in range(near // STEP, far // STEP + 1):
        low, high = max(near, j * STEP), min(far, j * STEP + STEP - 1)
        core = text[q - j * STEP : q - j * STEP + length - STEP + 1]
        part = text[q - high : q - low + length]
        yield q, low, high, _signed(digest(core, j)), _signed(digest(part, low << 16 | high))


def _strings(text: bytes, q: int, near: int, far: int, length: int):
    from xxhash import xxh3_128_digest as digest

    for start in range(q - far, q - near + 1):
        yield start, digest(text[start : start + length])


def _settled(rows: DataFrame, fine: str, coarse: str, length: int, name: str) -> tuple[DataFrame, DataFrame]:
    """rows(key, q, near, far, coarse, fine). Runs with one fine name are equal: all but the first go,
    (key, lo, hi). Coarse names with several fine names are opened: the first of each, (key, q, near, far)."""
    first = F.min(F.struct("key", "q", "near", "far")).alias("first")
    kinds = stage(rows.groupBy(coarse, fine).agg(first, F.count("*").alias("n")), f"sa-{name}-kinds")
    repeated = kinds.filter("n > 1").select(coarse, fine, F.col("first.key").alias("f_key"), F.col("first.q").alias("f_q"))
    equal = (
        rows.join(repeated, [coarse, fine])
        .filter("key <> f_key or q <> f_q")
        .select("key", (F.col("q") - F.col("far")).alias("lo"), (F.col("q") - F.col("near") + length).alias("hi"))
    )
    equal = stage(equal, f"sa-{name}-equal")
    mixed = kinds.groupBy(coarse).agg(F.count("*").alias("kinds")).filter("kinds > 1").select(coarse)
    opened = stage(kinds.join(mixed, coarse, "left_semi").select("first.*"), f"sa-{name}-opened")
    drop_stage(kinds)
    return equal, opened


def repeated_runs(docs: DataFrame, length: int = 100) -> DataFrame:
    """docs(key, text): (key, lo, hi), byte ranges, overlapping, whose union is what also starts earlier."""
    if length < GRAM + STEP:
        raise ValueError(f"strings of {GRAM + STEP} bytes at least")
    spark = docs.sparkSession
    place = [pa.int64(), pa.int64(), pa.int16(), pa.int16()]
    ranked = stage(_ranks(docs, length), "sa-ranks")
    again = ranked.groupBy("h").agg(F.count("*").alias("n")).filter("n > 1").select("h")
    places = stage(ranked.join(again.hint("shuffle_hash"), "h", "left_semi").select("key", "q", "near", "far", "h"), "sa-places")
    drop_stage(ranked)
    release_shuffles(spark)

    runs = _at_places(docs, places, lambda *x: _run(*x, length), "key long, q long, near short, far short, h long, s long", [*place, pa.int64(), pa.int64()])
    runs = stage(runs, "sa-named")
    drop_stage(places)
    release_shuffles(spark)
    equal, opened = _settled(runs, "s", "h", length, "run")
    drop_stage(runs)
    release_shuffles(spark)

    cores = _at_places(docs, opened, lambda *x: _cores(*x, length), "key long, q long, near short, far short, c long, w long", [*place, pa.int64(), pa.int64()])
    cores = stage(cores, "sa-cores")
    drop_stage(opened)
    release_shuffles(spark)
    equal_cores, opened = _settled(cores, "w", "c", length, "core")
    drop_stage(cores)
    release_shuffles(spark)

    strings = _at_places(docs, opened, lambda *x: _strings(*x, length), "key long, lo long, t binary", [pa.int64(), pa.int64(), pa.binary()])
    strings = stage(strings, "sa-strings")
    drop_stage(opened)
    release_shuffles(spark)
    earliest = strings.groupBy("t").agg(F.min(F.struct("key", "lo")).alias("first"), F.count("*").alias("n")).filter("n > 1")
    single = (
        strings.join(earliest.select("t", "first"), "t")
        .filter("struct(key, lo) <> first")
        .select("key", "lo", (F.col("lo") + length).alias("hi"))
    )
    out = stage(equal.unionByName(equal_cores).unionByName(single), "sa-runs")
    for x in (strings, equal, equal_cores):
        drop_stage(x)
    release_shuffles(spark)
    return out


def merged(lows: np.ndarray, highs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Disjoint maximal ranges of the union; ranges that touch are one."""
    order = np.argsort(lows, kind="stable")
    lows, highs = lows[order], np.maximum.accumulate(highs[order])
    new = np.concatenate([[True], lows[1:] > highs[:-1]])
    last = np.concatenate([np.flatnonzero(new)[1:] - 1, [len(lows) - 1]])
    return lows[new], highs[last]


def _keyed(docs: DataFrame) -> DataFrame:
    """(doc_id, key, text): key is a number of its own for each row, in the order of doc_id. Where
    doc_ids are null or repeat, rows are dealt out by range and numbered in that order."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    odd = rows.groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1 or doc_id is null").limit(1)
    if not odd.take(1):
        return rows.select("doc_id", F.col("doc_id").alias("key"), "text")
    by = ["doc_id", F.xxhash64("text"), "text"]
    return stage(rows.repartitionByRange(*by).sortWithinPartitions(*by).select("doc_id", F.monotonically_increasing_id().alias("key"), "text"), "sa-keys")


def cut(docs: DataFrame, length: int = 100) -> DataFrame:
    """docs(doc_id long, text): (doc_id, n_bytes, n_removed, n_spans, kept binary, spans array of
    lo and hi, end exclusive)."""
    rows = _keyed(docs)
    runs = repeated_runs(rows, length)
    packed = runs.groupBy("key").agg(F.collect_list(F.struct("lo", "hi")).alias("runs"))
    joined = rows.join(packed.hint("shuffle_hash"), "key", "left")
    kind = "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary, spans array<struct<lo: long, hi: long>>"
    pair = pa.list_(pa.struct([("lo", pa.int64()), ("hi", pa.int64())]))

    def batches(it):
        for batch in it:
            out = [[] for _ in range(6)]
            for key, text, runs in zip(batch.column(0).to_pylist(), _packed(batch.column(1)), batch.column(2)):
                if runs.is_valid and len(runs):
                    lows, highs = merged(*(runs.values.field(i).to_numpy() for i in (0, 1)))
                    edges = np.concatenate([[0], np.stack([lows, highs], axis=1).ravel(), [len(text)]]).tolist()
                    kept = b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2]))
                    spans = [{"lo": a, "hi": b} for a, b in zip(lows.tolist(), highs.tolist())]
                else:
                    kept, spans = text, []
                for column, value in zip(out, (key, len(text), len(text) - len(kept), len(spans), kept, spans)):
                    column.append(value)
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pair)
            names = ("doc_id", "n_bytes", "n_removed", "n_spans", "kept", "spans")
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], names=list(names))

    return joined.select("doc_id", "text", "runs").mapInArrow(batches, kind)


def digest(docs: DataFrame, length: int = 100) -> DataFrame:
    """cut() with the SHA-256 of the bytes that stay instead of the bytes."""
    return cut(docs, length).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"), "spans")

