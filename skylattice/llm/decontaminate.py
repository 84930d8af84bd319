"""Benchmark decontamination: CGK embedding, bit-sampling LSH over item-sized windows, exact verification.

Texts and items are compared as lower-case words joined by single blanks, in UTF-8 bytes. An item of m
bytes is found in a text if some part of the text is within floor(rate * m) edits of it (and always
fewer than the item has whole 8-byte segments). Three steps:

1. Windows. An occurrence leaves at least (segments - edits) of the item's disjoint 8-byte segments
   whole, within `edits` of one alignment; windows of the item's size are taken at the alignments
   where so many meet, and where so many of its overlapping 8-byte strings are left as the edits must
   leave. This loses nothing. (To embed the windows at all places costs far more than there is; see README.)
2. A CGK random walk embeds windows and items of that size so that edit distance becomes Hamming
   distance. Bit sampling: WALKS x BANDS samples of SAMPLED coordinates each; a window and an item are
   candidates if any sample agrees. One coordinate agrees with probability s, so a pair is found with
   1 - (1 - s**SAMPLED)**(WALKS * BANDS): 0.98 at s = 0.5, which covers 10 % of edits; equal pairs always.
3. Candidates are verified by a bit-parallel approximate match of the whole item in the text around.

Items too short for that (below `shortest` bytes) would occur by chance within some edits; they are found where
they stand word by word.

The benchmark is taken in blocks of BLOCK_BYTES, each a pass over the texts. What is broadcast are a block's
texts; an executor indexes them once, and makes the sketch of an item when a window first asks for it, so what
it holds is bounded however large the benchmark grows. The bits of the walk are hashes of (step, byte).

Cases: null and empty texts and items hold nothing; items without a word are left out;
repeated items are found each; rows that repeat a doc_id are merged in the
result and judged each by its own text when filtering; other columns stay, whatever their names; empty tables
find nothing.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skylattice.llm.common import drop_stage, stage

WALKS, BANDS, SAMPLED = 8, 8, 4
SEGMENT = 8
#: Bytes of items that one pass holds.
BLOCK_BYTES = 8 << 20
#: Sketches of items that a worker keeps, and steps of the walk whose bits it keeps.
KEPT_SKETCHES, KEPT_STEPS = 20_000, 1 << 14
#: Bytes of a text that are scanned at once.
CHUNK = 2 << 20
_BITS = 20

_NOT_WORD = re.compile(r"[\W_]+")


def normalise(text: str) -> bytes:
    return _NOT_WORD.sub(" ", text.lower()).strip().encode("utf-8", "replace")


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)


_WALK_SEEDS = _mixed(np.arange(1, WALKS + 1, dtype=np.uint64))[:, None]


class Items:
    """The items of one block: segments for the windows, sketches for the candidates. Only the texts travel."""

    def __init__(self, rows: list[tuple[int, bytes]], rate: float, shortest: int = 40):
        self.rows, self.rate, self.shortest = rows, rate, shortest

    def __getstate__(self):
        return self.rows, self.rate, self.shortest

    def __setstate__(self, state):
        self.rows, self.rate, self.shortest = state

    def indexed(self) -> Items:
        if hasattr(self, "texts"):
            return self
        long = [x for x in self.rows if len(x[1]) >= max(self.shortest, 2 * SEGMENT)]
        self.ids = np.array([i for i, _ in long], dtype=np.int64)
        self.short: dict[bytes, list[int]] = {}
        for i, t in self.rows:
            if len(t) < max(self.shortest, 2 * SEGMENT):
                self.short.setdefault(t, []).append(i)
        self.words = self._automaton() if self.short else None
        sizes = np.array([len(t) for _, t in long], dtype=np.int64)
        whole = sizes // SEGMENT
        self.edits = np.minimum((sizes * self.rate).astype(np.int64), whole - 1)
        self.need = np.maximum(1, whole - self.edits)
        self.longest = int(sizes.max()) if len(long) else 0
        if long:
            grams, item, offset = [], [], []
            for k, (_, t) in enumerate(long):
                n = len(t) // SEGMENT
                grams.append(np.frombuffer(t, dtype="<u8", count=n))
                item.append(np.full(n, k))
                offset.append(np.arange(n) * SEGMENT)
            grams, item, offset = np.concatenate(grams), np.concatenate(item), np.concatenate(offset)
            order = np.argsort(grams, kind="stable")
            self.item, self.offset = item[order], offset[order]
            self.grams, self.first, self.times = np.unique(grams[order], return_index=True, return_counts=True)
            self.bitmap = np.zeros(1 << _BITS, dtype=bool)
            self.bitmap[_slot(self.grams)] = True
        self.overlapping: dict[int, np.ndarray] = {}
        self.seen = np.zeros(1 << 16, dtype=bool)
        self.places = np.random.default_rng(20240607).random((WALKS, BANDS, SAMPLED))
        self.sketches: dict[int, set] = {}
        self.steps: dict[int, np.ndarray] = {}
        self.texts = [t for _, t in long]
        return self

    def _automaton(self):
        import ahocorasick

        words = ahocorasick.Automaton()
        for t in self.short:
            words.add_word(f" {t.decode('utf-8', 'replace')} ", t)
        words.make_automaton()
        return words

    def word_by_word(self, text: bytes) -> set[int]:
        """Ids of the short items in a text, between blanks."""
        if not self.words or not text:
            return set()
        return {i for _, t in self.words.iter(f" {text.decode('utf-8', 'replace')} ") for i in self.short[t]}

    def step(self, j: int) -> np.ndarray:
        """(walks, 256): whether a walk moves on from a byte at step j."""
        found = self.steps.get(j)
        if found is None:
            found = (_mixed(_WALK_SEEDS + np.uint64(256 * j) + np.arange(256, dtype=np.uint64)[None, :]) >> np.uint64(63)).astype(np.int64)
            if j < KEPT_STEPS:
                self.steps[j] = found
        return found

    def sketch(self, k: int) -> set:
        found = self.sketches.get(k)
        if found is None:
            if len(self.sketches) >= KEPT_SKETCHES:
                self.sketches.clear()
            found = self.sketches[k] = set(self.keys([self.texts[k]], len(self.texts[k]))[0])
        return found

    def embed(self, windows: list[bytes], size: int) -> np.ndarray:
        """CGK: (walks, windows, 3 * size). The walk copies the byte under its pointer, and a random
        bit of (step, byte) says whether the pointer moves on."""
        padded = np.zeros((len(windows), size + 1), dtype=np.uint8)
        for i, w in enumerate(windows):
            padded[i, : len(w)] = np.frombuffer(w, dtype=np.uint8)
        rows = np.arange(len(windows))[None, :]
        at = np.zeros((WALKS, len(windows)), dtype=np.int64)
        walks = np.arange(WALKS)[:, None]
        out = np.empty((3 * size, WALKS, len(windows)), dtype=np.uint8)
        for j in range(3 * size):
            seen = padded[rows, at]
            out[j] = seen
            at = np.minimum(at + self.step(j)[walks, seen], size)
        return out.transpose(1, 2, 0)

    def keys(self, windows: list[bytes], size: int) -> list[list[tuple]]:
        embedded = self.embed(windows, size)
        out: list[list[tuple]] = [[] for _ in windows]
        for w in range(WALKS):
            for b in range(BANDS):
                sampled = np.ascontiguousarray(embedded[w][:, (self.places[w, b] * 3 * size).astype(np.int64)])
                for i, key in enumerate(sampled.view(f"V{SAMPLED}").ravel()):
                    out[i].append((w, b, key.tobytes()))
        return out

    def windows(self, grams: np.ndarray, slots: np.ndarray) -> list[tuple[int, int, int]]:
        """(item, start, place of a segment), from the 8-byte strings at all places of a text: alignments where enough of an item's segments meet."""
        at = np.flatnonzero(self.bitmap[slots])
        if not len(at):
            return []
        place = np.minimum(np.searchsorted(self.grams, grams[at]), len(self.grams) - 1)
        same = self.grams[place] == grams[at]
        place, at = place[same], at[same]
        if not len(place):
            return []
        times = self.times[place]
        each = np.repeat(self.first[place], times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
        at = np.repeat(at, times)
        item, start = self.item[each], at - self.offset[each]
        width = 2 * self.edits[item] + 1
        bucket = (start + self.longest) // width
        order = np.lexsort((bucket, item))
        item, start, bucket, at = item[order], start[order], bucket[order], at[order]
        new = np.concatenate([[True], (np.diff(item) != 0) | (np.diff(bucket) != 0)])
        group = np.cumsum(new) - 1
        count, heads = np.bincount(group), np.flatnonzero(new)
        beside, before = np.zeros(len(count), dtype=np.int64), np.zeros(len(count), dtype=np.int64)
        follows = (np.diff(item[heads]) == 0) & (np.diff(bucket[heads]) == 1)
        beside[:-1][follows] = count[1:][follows]
        before[1:][follows] = count[:-1][follows]
        enough = np.maximum(count + beside, count + before) >= self.need[item[heads]]
        kept = enough[group]
        return sorted(set(zip(item[kept].tolist(), start[kept].tolist(), at[kept].tolist())))

    def alike(self, k: int, slots: np.ndarray) -> bool:
        """Whether a part of a text has as many of the item's overlapping 8-byte strings as its edits must
        leave; by hashes, so that a few more may pass."""
        least = len(self.texts[k]) - SEGMENT + 1 - SEGMENT * int(self.edits[k])
        if least <= 0:
            return True
        if k not in self.overlapping:
            if len(self.overlapping) >= 10_000:
                self.overlapping.clear()
            self.overlapping[k] = _slot(_overlapping(self.texts[k])) >> (_BITS - 16)
        part = slots >> (_BITS - 16)
        self.seen[part] = True
        count = int(np.count_nonzero(self.seen[self.overlapping[k]]))
        self.seen[part] = False
        return count >= least

    def found(self, texts: list[bytes]) -> list[dict[int, int]]:
        """For each text the items in it, with the edits of their best match. The texts are scanned
        joined, with more bytes between them than any item may have edits."""
        out: list[dict[int, int]] = [{} for _ in texts]
        if not self.texts:
            return out
        gap = b"\n" * (int(self.edits.max()) + SEGMENT + 1)
        begins = np.cumsum([0, *(len(t) + len(gap) for t in texts[:-1])])
        by_size: dict[int, dict[tuple[int, int], set[int]]] = {}
        judged: dict[tuple[int, int, int], bool] = {}
        grams = _overlapping(gap.join(texts))
        slots = _slot(grams)
        for k, start, at in self.windows(grams, slots):
            owner = int(np.searchsorted(begins, at, side="right")) - 1
            start = max(start - int(begins[owner]), 0)
            cell = (k, owner, start // (int(self.edits[k]) + 1))
            if cell not in judged:
                low, high = self.around(k, cell[2])
                low, high = int(begins[owner]) + low, int(begins[owner]) + min(high, len(texts[owner]))
                judged[cell] = self.alike(k, slots[low : max(low, high - SEGMENT + 1)])
            if judged[cell]:
                by_size.setdefault(len(self.texts[k]), {}).setdefault((owner, start), set()).add(k)
        tried: set[tuple[int, int, int]] = set()
        for size, places in by_size.items():
            wanted, most = sorted(places), max(1, min(256, (1 << 22) // size))
            for i in range(0, len(wanted), most):
                some = wanted[i : i + most]
                for (owner, start), keys in zip(some, self.keys([texts[o][s : s + size] for o, s in some], size)):
                    for k in sorted(k for k in places[owner, start] if not self.sketch(k).isdisjoint(keys)):
                        cell = (k, owner, start // (int(self.edits[k]) + 1))
                        if out[owner].get(k) == 0 or cell in tried:
                            continue
                        tried.add(cell)
                        low, high = self.around(k, cell[2])
                        least = matched(self.texts[k], texts[owner][low:high], int(self.edits[k]))
                        if least <= self.edits[k]:
                            out[owner][k] = min(least, out[owner].get(k, least))
        return out

    def around(self, k: int, cell: int) -> tuple[int, int]:
        """The part of a text that holds every match of the item whose window starts in the cell."""
        most = int(self.edits[k])
        return max(0, cell * (most + 1) - 2 * most), (cell + 1) * (most + 1) + len(self.texts[k]) + 2 * most


def _overlapping(text: bytes) -> np.ndarray:
    if len(text) < SEGMENT:
        return np.empty(0, dtype="<u8")
    views = np.lib.stride_tricks.sliding_window_view(np.frombuffer(text, dtype=np.uint8), SEGMENT)
    return np.ascontiguousarray(views).view("<u8").ravel()


def _slot(grams: np.ndarray) -> np.ndarray:
    return ((grams * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - _BITS)).astype(np.int32)


def matched(pattern: bytes, text: bytes, most: int) -> int:
    """The least edits between the pattern and any part of the text (bit-parallel, one word as long as
    the pattern)."""
    m = len(pattern)
    if text.find(pattern) >= 0:
        return 0
    masks: dict[int, int] = {}
    for i, c in enumerate(pattern):
        masks[c] = masks.get(c, 0) | 1 << i
    full, top = (1 << m) - 1, 1 << (m - 1)
    plus, minus, score, best = full, 0, m, m
    for c in text:
        eq = masks.get(c, 0)
        xv = eq | minus
        xh = (((eq & plus) + plus) ^ plus) | eq
        ph = minus | ~(xh | plus) & full
        mh = plus & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        ph = ph << 1 & full
        mh = mh << 1 & full
        plus = mh | ~(xv | ph) & full
        minus = ph & xv
        best = min(best, score)
    return best


def scan(texts: list[str | None], items: Items) -> list[dict[int, int]]:
    """For each text the ids of the items in it, with the edits of their best match. Long texts are scanned in
    chunks of some CHUNK bytes that overlap by the longest item with its edits."""
    items.indexed()
    out: list[dict[int, int]] = [{} for _ in texts]
    overlap = 3 * items.longest
    held: list[tuple[int, bytes]] = []
    size = 0

    def flush() -> None:
        for (i, _), found in zip(held, items.found([t for _, t in held])):
            for k, n in found.items():
                key = int(items.ids[k])
                out[i][key] = min(n, out[i].get(key, n))
        held.clear()

    for i, text in enumerate(texts):
        whole = normalise(text) if text else b""
        out[i].update(dict.fromkeys(items.word_by_word(whole), 0))
        for at in range(0, max(1, len(whole) - overlap), CHUNK):
            part = whole[at : at + CHUNK + overlap]
            if not part:
                continue
            if held and size + len(part) > CHUNK:
                flush()
                size = 0
            held.append((i, part))
            size += len(part)
    if held:
        flush()
    return out


def blocks(benchmark: DataFrame, rate: float, shortest: int):
    """The benchmark's items in blocks of BLOCK_BYTES at most (one longer item makes a block). Rows
    reach the driver one partition at a time, and leave it with their block."""
    held, size = [], 0
    for row in benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("string")).toLocalIterator():
        text = normalise(row[1] or "")
        if row[0] is None or not text:
            continue
        if held and size + len(text) > BLOCK_BYTES:
            yield Items(held, rate, shortest)
            held, size = [], 0
        held.append((row[0], text))
        size += len(text)
    if held:
        yield Items(held, rate, shortest)


def _each_block(benchmark: DataFrame, rate: float, shortest: int):
    """(block, is it the last?)"""
    held = None
    for items in blocks(benchmark, rate, shortest):
        if held is not None:
            yield held, False
        held = items
    if held is not None:
        yield held, True


def contaminated(docs: DataFrame, benchmark: DataFrame, rate: float = 0.1, shortest: int = 40) -> DataFrame:
    """(doc_id, item_id, edits): the items found in each document."""
    spark = docs.sparkSession
    wanted = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    schema = "doc_id long, item_id long, edits long"
    out = spark.createDataFrame([], schema)
    for items, last in _each_block(benchmark, rate, shortest):
        shared = spark.sparkContext.broadcast(items)  # of BLOCK_BYTES at most

        def batches(it, shared=shared):
            for batch in it:
                rows = []
                for doc_id, found in zip(batch.column(0).to_pylist(), scan(batch.column(1).to_pylist(), shared.value)):
                    rows += [(doc_id, i, n) for i, n in found.items()]
                columns = list(zip(*rows)) or [(), (), ()]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["doc_id", "item_id", "edits"])

        found = wanted.mapInArrow(batches, schema)
        if not last:  # a pass of its own, so that no task holds two blocks
            found = stage(found, "contaminated")
            shared.destroy()
        out = out.union(found)
    return out.groupBy("doc_id", "item_id").agg(F.min("edits").alias("edits"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, rate: float = 0.1, shortest: int = 40) -> DataFrame:
    """The documents that hold no item, with all columns. Each row is judged by its own text."""
    at, names = docs.columns.index("text"), docs.columns
    made = None
    for items, last in _each_block(benchmark, rate, shortest):
        shared = docs.sparkSession.sparkContext.broadcast(items)  # of BLOCK_BYTES at most

        def batches(it, shared=shared):
            for batch in it:
                clean = pa.array([not found for found in scan(batch.column(at).to_pylist(), shared.value)], pa.bool_())
                yield batch.filter(clean).rename_columns(names)

        docs = docs.mapInArrow(batches, docs.schema)
        if not last:
            docs = stage(docs, "clean")
            shared.destroy()
            if made is not None:
                drop_stage(made)
            made = docs
    return docs
