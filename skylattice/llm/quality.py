"""Quality of documents by a linear-chain conditional random field over their lines.

Every line is good or bad. Its features describe its own characters and words and those of the lines
beside it; two weights reward neighbours of one kind. Forward-backward marginals of the lines, weighted
by line length, make the document's score. Training takes a bounded sample of labelled documents (see
`Sample`), whose label counts for each of their lines; labels, lang, source and doc_id are no features.

Cases: a null or empty text is scored as one empty line; without labels of both kinds every score is
0.5; labels that are null, or contradict each other for one doc_id, are left out; repeated rows are
scored each, and of rows that repeat a labelled doc_id one trains (that with the least text); other columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of text handled at once.
CHUNK = 4 << 20

_CLASSES = (
    ("upper", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
    ("lower", b"abcdefghijklmnopqrstuvwxyz"),
    ("digit", b"0123456789"),
    ("blank", b" \t\r\x0b\x0c"),
    ("stop", b".,;:?'\"-()"),
    ("shout", b"!"),
    ("sign", b"#$%&*@^~<>=+_\\/{}[]`"),
    ("bar", b"|"),
)
#: Features of a line itself.
N_OWN = len(_CLASSES) + 8


@dataclass(frozen=True)
class Sample:
    """Bounds of the training sample: documents of each label, and lines of one document (longer
    documents are not taken for training; all are scored)."""

    documents: int = 2500
    lines: int = 200
    rounds: int = 150


def line_features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of all lines of the texts, the lines' lengths, and the first line's index of each text
    (and the number of lines at the end)."""
    joined = b"\n".join(texts)
    data = np.frombuffer(joined, dtype=np.uint8)
    breaks = np.flatnonzero(data == 10)
    starts = np.concatenate([[0], breaks + 1]).astype(np.int64)
    ends = np.concatenate([breaks, [len(data)]]).astype(np.int64)
    lengths = ends - starts
    per_text = np.array([t.count(b"\n") + 1 for t in texts], dtype=np.int64)
    offsets = np.concatenate([[0], np.cumsum(per_text)])
    safe = np.maximum(lengths, 1).astype(np.float64)
    columns = []
    for _, members in _CLASSES:
        lookup = np.zeros(256, dtype=np.int32)
        lookup[list(members)] = 1
        sums = np.concatenate([[0], np.cumsum(lookup[data], dtype=np.int64)])
        columns.append((sums[ends] - sums[starts]) / safe)
    lines = joined.split(b"\n")
    words = np.empty((len(lines), 4))
    seen: set[bytes] = set()
    following = 1
    for i, line in enumerate(lines):
        if i == offsets[following]:
            seen = set()
            following += 1
        parts = line.split()
        n = len(parts)
        repeats = sum(map(bytes.__eq__, parts, parts[1:])) if n > 1 else 0
        words[i] = n, len(set(parts)) / n if n else 1.0, repeats / n if n else 0.0, line in seen and n > 0
        seen.add(line)
    n_words = words[:, 0]
    columns += [
        np.log1p(lengths) / 8,
        np.log1p(n_words) / 6,
        np.minimum(lengths / np.maximum(n_words, 1), 30) / 10,
        words[:, 1],
        words[:, 2],
        words[:, 3],
        (lengths == 0).astype(np.float64),
        np.sqrt(columns[6]),
    ]
    return np.stack(columns, axis=1), lengths, offsets


def with_neighbours(own: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Own features, those of the lines before and after in the same text, marks of the edges, and one."""
    n = len(own)
    first, last = np.zeros(n, dtype=bool), np.zeros(n, dtype=bool)
    first[offsets[:-1]] = True
    last[offsets[1:] - 1] = True
    before, after = np.roll(own, 1, axis=0), np.roll(own, -1, axis=0)
    before[first] = 0
    after[last] = 0
    return np.concatenate([own, before, after, first[:, None], last[:, None], np.ones((n, 1))], axis=1)


def _pass(r: np.ndarray, stay: np.ndarray) -> np.ndarray:
    """The log ratio good : bad that a line with log ratio r sends to its neighbour."""
    return np.logaddexp(r + stay[0], 0) - np.logaddexp(r, stay[1])


def marginals(theta: np.ndarray, offsets: np.ndarray, stay: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Forward-backward over all texts at once: each line's probability of being good, and the forward
    and backward log ratios. Step t handles the texts that have a line t."""
    counts = np.diff(offsets)
    order = np.argsort(-counts, kind="stable")
    starts, sizes = offsets[:-1][order], counts[order]
    forward, backward = theta.copy(), np.zeros_like(theta)
    longest = int(sizes[0]) if len(sizes) else 0
    live = np.searchsorted(-sizes, -np.arange(longest), side="left")  # texts with more than t lines
    for t in range(1, longest):
        at = starts[: live[t]] + t
        forward[at] += _pass(forward[at - 1], stay)
    for t in range(longest - 1, 0, -1):
        at = starts[: live[t]] + t
        backward[at - 1] = _pass(theta[at] + backward[at], stay)
    return 1 / (1 + np.exp(-np.clip(forward + backward, -60, 60))), forward, backward


def train(own: np.ndarray, offsets: np.ndarray, labels: np.ndarray, rounds: int = 150) -> dict:
    """Weights by maximum conditional likelihood (Adam steps); every text counts alike, and both labels
    together have equal weight."""
    mean, scale = own.mean(axis=0), own.std(axis=0) + 1e-6
    x = with_neighbours((own - mean) / scale, offsets)
    counts = np.diff(offsets)
    share = np.where(labels == 1, 0.5 / max(1, (labels == 1).sum()), 0.5 / max(1, (labels == 0).sum()))
    line_share, line_label = np.repeat(share / counts, counts), np.repeat(labels, counts).astype(np.float64)
    inner = np.ones(len(own), dtype=bool)
    inner[offsets[1:] - 1] = False  # lines that have a next line
    at = np.flatnonzero(inner)
    weights, stay = np.zeros(x.shape[1]), np.array([0.5, 0.5])
    m, v = np.zeros(len(weights) + 2), np.zeros(len(weights) + 2)
    for k in range(1, rounds + 1):
        theta = x @ weights
        p, forward, backward = marginals(theta, offsets, stay)
        gradient = x.T @ (line_share * (line_label - p)) - 1e-4 * weights
        after = theta[at + 1] + backward[at + 1]
        both = np.stack([forward[at] + after + stay[0], np.zeros(len(at)) + stay[1], forward[at], after])
        both -= np.logaddexp.reduce(both, axis=0)
        good, bad = np.exp(both[0]), np.exp(both[1])
        s = line_share[at]
        slope = np.array([(s * (line_label[at] - good)).sum(), (s * ((1 - line_label[at]) - bad)).sum()]) - 5e-2 * stay
        g = np.concatenate([gradient, slope])
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        step = 0.1 * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.99**k)) + 1e-8)
        weights, stay = weights + step[:-2], np.clip(stay + step[-2:], 0, 3)
    return {"mean": mean, "scale": scale, "weights": weights, "stay": stay}


def score_texts(texts: list[bytes], model: dict) -> np.ndarray:
    """Length-weighted marginals of the texts' lines."""
    own, lengths, offsets = line_features(texts)
    theta = with_neighbours((own - model["mean"]) / model["scale"], offsets) @ model["weights"]
    p, _, _ = marginals(np.clip(theta, -30, 30), offsets, model["stay"])
    weight = np.maximum(lengths, 1).astype(np.float64)
    return np.add.reduceat(p * weight, offsets[:-1]) / np.add.reduceat(weight, offsets[:-1])


def _in_chunks(column: pa.Array):
    """Lists of the column's texts as bytes, some CHUNK bytes each, or one longer text."""
    held, size = [], 0
    for value in column.cast(pa.large_binary()):
        text = value.as_py() or b""
        if held and size + len(text) > CHUNK:
            yield held
            held, size = [], 0
        held.append(text)
        size += len(text)
    if held:
        yield held


def training_rows(docs: DataFrame, labels: DataFrame, sample: Sample) -> DataFrame:
    """The bounded training sample: (doc_id, label, text), the first documents of each label by a hash
    of doc_id, among labels whose crc32(doc_id) mod 5 is not 0."""
    clean = (
        labels.filter("doc_id is not null and quality in (0, 1)")
        .groupBy(F.col("doc_id").cast("long").alias("doc_id"))
        .agg(F.min("quality").alias("label"), F.max("quality").alias("other"))
        .filter("label = other and crc32(cast(doc_id as string)) % 5 <> 0")
        .select("doc_id", "label")
    )
    short = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    bound = sample.documents
    parts = [clean.filter(F.col("label") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound) for k in (0, 1)]
    chosen = parts[0].unionByName(parts[1])  # 2 * bound rows at most
    # Of rows that repeat a doc_id one counts, so that the rows are as few as the labels.
    return short.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text"))


def fit(docs: DataFrame, labels: DataFrame, sample: Sample = Sample()) -> dict | None:
    """The model from the bounded sample; None without labels of both kinds. Only the features of the
    sample's lines (16 numbers a line) come to the driver."""
    most = sample.lines

    def batches(it):
        for batch in it:
            texts = [v.as_py() or b"" for v in batch.column(1).cast(pa.large_binary())]
            kept = [(i, t) for i, t in enumerate(texts) if t.count(b"\n") < most]
            for i, t in kept:
                own, _, _ = line_features([t])
                row = {"label": [batch.column(0)[i].as_py()], "h": [hash_of(t)], "own": [own.astype(np.float32).ravel()]}
                yield pa.RecordBatch.from_pydict(row, schema=pa.schema([("label", pa.int32()), ("h", pa.int64()), ("own", pa.list_(pa.float32()))]))

    rows = (
        training_rows(docs, labels, sample)
        .select(F.col("label").cast("int").alias("label"), "text")
        .mapInArrow(batches, "label int, h long, own array<float>")
        .orderBy("h", "label")
        .toPandas()
    )
    if rows["label"].nunique() < 2:
        return None
    parts = [np.asarray(x, dtype=np.float64).reshape(-1, N_OWN) for x in rows["own"]]
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in parts])]).astype(np.int64)
    return train(np.concatenate(parts), offsets, rows["label"].to_numpy(), sample.rounds)


def hash_of(text: bytes) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(text) >> 1


def score(docs: DataFrame, labels: DataFrame, sample: Sample = Sample()) -> DataFrame:
    """(doc_id, score): the quality of every whole text."""
    model = fit(docs, labels, sample)
    wanted = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    if model is None:
        return wanted.select("doc_id", F.lit(0.5).cast("double").alias("score"))

    def batches(it):
        for batch in it:
            found = [score_texts(texts, model) for texts in _in_chunks(batch.column(1))]
            scores = np.concatenate(found) if found else np.empty(0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], names=["doc_id", "score"])

    return wanted.mapInArrow(batches, "doc_id long, score double")


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, sample: Sample = Sample()) -> DataFrame:
    """The documents that score at least the threshold, with all their columns. The score is computed
    beside the row, so nothing is joined and repeated doc_ids are judged each by its own text."""
    model = fit(docs, labels, sample)
    if model is None:
        return docs
    at = docs.columns.index("text")
    names = docs.columns

    def batches(it):
        for batch in it:
            found = [score_texts(texts, model) for texts in _in_chunks(batch.column(at))]
            good = (np.concatenate(found) if found else np.empty(0)) >= threshold
            yield batch.filter(pa.array(good)).rename_columns(names)

    return docs.mapInArrow(batches, docs.schema)
