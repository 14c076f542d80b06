"""Document quality by supervised subword embeddings.

A text is the average of learned vectors of its words, word pairs and byte n-grams, hashed to a fixed
number of rows; a softmax over two classes follows. Both layers are trained by stochastic gradient
descent in numpy. As the layer after the average is linear, scoring needs one number per hashed row.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.words import split_words, utf8, windows

#: Labelled rows of each class that the model is fitted on, at most. Fitting needs one machine.
FIT_ROWS = 1_500
#: Longer texts are scored, but the model is not fitted on them.
FIT_BYTES = 50_000
ROWS_BITS, WIDTH = 17, 8
EPOCHS, STEPS, BATCH, RATE = 6, 1_200, 16, 60.0
#: Different shares of one text that two bytes tell apart.
PLACES = 2**16
GRAMS = (3, 4)
#: Bytes of text that are scored at a time; a longer text is scored alone.
CHUNK = 500_000
#: Rows that are scored before they are handed on.
SCORED = 1_000
#: Equal words up to this many words apart, and n-grams of kinds of bytes (upper, lower, digit, space, other, beyond ASCII).
GAPS, KINDS_WIDTH = 4, 5
_KIND = np.array([3 if chr(b) in " \t\n\x0b\f\r" else 2 if chr(b) in "0123456789" else 0 if "A" <= chr(b) <= "Z" else 1 if "a" <= chr(b) <= "z" else 4 if b < 128 else 5 for b in range(256)], np.uint8)
_FACTORS = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F, 0x165667B1], np.uint32)


def sample(docs: DataFrame, labels: DataFrame, per_class: int) -> tuple[list[tuple[str, int]], dict[int, int]]:
    """At most ``per_class`` labelled texts of each class, by a hash of the id, and the size of each class.

    An id with several texts or labels gives each label one text. Labels without a text of at most FIT_BYTES
    are left out before any are taken, so the driver gets ``2 * per_class * FIT_BYTES`` at most.
    """
    labels = labels.filter("label IN (0, 1) AND doc_id IS NOT NULL").select("doc_id", F.col("label").cast("int").alias("label")).distinct()
    sizes = {int(r[0]): int(r[1]) for r in labels.groupBy("label").count().collect()}
    short = docs.filter(F.coalesce(F.octet_length("text"), F.lit(0)) <= FIT_BYTES).select("doc_id").distinct()
    labels = labels.join(short, "doc_id")
    chosen = None
    for label in (0, 1):
        part = labels.filter(F.col("label") == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class)
        chosen = part if chosen is None else chosen.unionAll(part)
    found = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").filter(F.coalesce(F.octet_length("text"), F.lit(0)) <= FIT_BYTES)
    rows = found.groupBy("doc_id", "label").agg(F.min_by("text", F.xxhash64("text")).alias("text")).collect()
    rows.sort(key=lambda r: (r["doc_id"], r["label"]))
    return [(r["text"] or "", r["label"]) for r in rows], sizes


def grams(data: np.ndarray, n: int) -> np.ndarray:
    """The hashed row of each run of n bytes."""
    if len(data) < n:
        return np.zeros(0, np.int64)
    h = np.full(len(data) - n + 1, n, np.uint32)
    for j in range(n):
        h = (h ^ data[j : len(data) - n + 1 + j]) * _FACTORS[j]
    return ((h ^ (h >> np.uint32(15))) * _FACTORS[4] >> np.uint32(32 - ROWS_BITS)).astype(np.int64)


def _rows(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - ROWS_BITS)).astype(np.int64)


def groups(data: np.ndarray, offsets: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, int]]:
    """(hashed rows, ends of the texts, width) of words, word pairs, gaps between equal words, and n-grams of bytes and of their kinds."""
    words = split_words(data, offsets, fold=False)
    h, first = words.hash, words.first
    within = np.arange(len(h)) - np.repeat(first[:-1], np.diff(first))
    gap = np.zeros(len(h), np.int64)
    for k in range(GAPS, 0, -1):
        same = np.flatnonzero(h[k:] == h[:-k]) + k
        gap[same[within[same] >= k]] = k
    out = [(_rows(h), first, 1), (_rows(windows(h, 2)), first, 2), (gap, first, 1)]
    out += [(grams(data, n), offsets, n) for n in GRAMS]
    return [*out, (grams(_KIND[data], KINDS_WIDTH), offsets, KINDS_WIDTH)]


@dataclass
class Model:
    """Score = sigmoid(``bias`` + the mean of ``weight`` over a text's rows, averaged over the groups of rows)."""

    weight: np.ndarray
    bias: float

    def score(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Scores of all texts of a column; an empty text gets the bias alone."""
        total = np.zeros(len(offsets) - 1)
        at = 0
        while at < len(offsets) - 1:
            to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + CHUNK, "right")) - 1)
            part, ends = data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
            parts = groups(part, ends)
            for rows, edge, n in parts:
                sums = np.concatenate([[0.0], np.cumsum(self.weight[rows], dtype=np.float64)])
                stop = np.maximum(edge[1:] - n + 1, edge[:-1])
                some = sums[np.minimum(stop, len(rows))] - sums[np.minimum(edge[:-1], len(rows))]
                total[at:to] += some / np.maximum(stop - edge[:-1], 1) / len(parts)
            at = to
        return 1 / (1 + np.exp(-np.clip(total + self.bias, -50, 50)))


class Bags:
    """The hashed rows of each text with their shares of it, in four bytes for a row, as all texts are held while fitting.

    A bag's rows are sorted, so it keeps their lower 16 bits and how many are below 2**16, and for each share its place
    among the bag's different shares; a bag with too many of them keeps its shares as they are. All bags are in three
    buffers, which leave no gaps when they grow.
    """

    def __init__(self, texts: list[str]):
        rows, places, shares = bytearray(), bytearray(), bytearray()
        self.ends, self.known, self.low, self.plain = [0], [0], [], {}
        for text in texts:
            data = np.frombuffer(text.encode(), np.uint8)
            parts = groups(data, np.array([0, len(data)]))
            own, where = np.unique(np.concatenate([r for r, _, _ in parts]), return_inverse=True)
            share = np.concatenate([np.full(len(r), 1 / max(len(r), 1) / len(parts)) for r, _, _ in parts])
            share = np.bincount(where, share, len(own)).astype(np.float32)
            different, place = np.unique(share, return_inverse=True)
            if len(different) > PLACES:
                self.plain[len(self.low)], different, place = share, different[:0], np.zeros(len(own), np.int64)
            rows += (own & 0xFFFF).astype(np.uint16).tobytes()
            places += place.astype(np.uint16).tobytes()
            shares += different.tobytes()
            self.ends.append(self.ends[-1] + len(own))
            self.known.append(self.known[-1] + len(different))
            self.low.append(int(np.searchsorted(own, 2**16)))
        self.rows, self.places, self.shares = np.frombuffer(rows, np.uint16), np.frombuffer(places, np.uint16), np.frombuffer(shares, np.float32)

    def __len__(self) -> int:
        return len(self.low)

    def get(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        """(rows, shares) of text i."""
        own = self.rows[self.ends[i] : self.ends[i + 1]].astype(np.int64)
        own[self.low[i] :] += 2**16
        if i in self.plain:
            return own, self.plain[i]
        return own, self.shares[self.known[i] : self.known[i + 1]][self.places[self.ends[i] : self.ends[i + 1]]]


def fit(rows: list[tuple[str, int]], sizes: dict[int, int], seed: int = 7) -> Model:
    """Trains on (text, label) rows; ``sizes`` of the classes set the prior of the scores."""
    present = {y for _, y in rows}
    if len(present) < 2:  # nothing to tell apart
        return Model(np.zeros(2**ROWS_BITS), 4.0 if present == {1} else -4.0 if present == {0} else 0.0)
    bags, labels = Bags([text for text, _ in rows]), [y for _, y in rows]
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / WIDTH, 1 / WIDTH, (2**ROWS_BITS, WIDTH)).astype(np.float32)
    layer, bias = np.zeros((WIDTH, 2), np.float32), np.zeros(2, np.float32)
    part = {y: labels.count(y) for y in (0, 1)}
    epochs = max(EPOCHS, -(-STEPS * BATCH // len(bags)))
    steps, step = epochs * -(-len(bags) // BATCH), 0
    for _ in range(epochs):
        order = rng.permutation(len(bags))
        for at in range(0, len(order), BATCH):
            batch = [(*bags.get(i), labels[i]) for i in order[at : at + BATCH]]
            rate, step = RATE * (1 - step / steps), step + 1
            hidden = np.stack([w @ vectors[f] for f, w, _ in batch])
            logits = hidden @ layer + bias
            p = np.exp(logits - logits.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            for i, (_, _, y) in enumerate(batch):
                p[i, y] -= 1
                p[i] *= len(bags) / (2 * part[y])
            p /= len(batch)
            back = p @ layer.T
            layer -= rate / 60 * (hidden.T @ p)
            bias -= rate / 60 * p.sum(0)
            for (f, w, _), g in zip(batch, back, strict=True):
                vectors[f] -= rate * w[:, None] * g
    prior = np.log(max(sizes.get(1, 1), 1) / max(sizes.get(0, 1), 1))
    return Model((vectors @ (layer[:, 1] - layer[:, 0])).astype(np.float32), float(bias[1] - bias[0] + prior))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``docs(text, ...)`` with ``score``; a column of that name is replaced, others pass through."""
    rest = [c for c in docs.columns if c.lower() != "score"]
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, SCORED):  # small batches go back, as both sides hold them in memory
                part = batch.slice(at, SCORED)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(shared.value.score(*utf8(part.column("text"))))], [*rest, "score"])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*rest).schema), "score double"])
    return docs.select(*rest).mapInArrow(run, schema)


def score_quality(docs: DataFrame, labels: DataFrame, per_class: int = FIT_ROWS) -> DataFrame:
    """``(doc_id, text, score)`` for each row of ``docs``, learned from ``labels(doc_id, label)``.

    score, 0 to 1, is higher the likelier label 1 is. Only the text is an input. The model is fitted
    on at most ``per_class`` labelled documents of each class, none longer than FIT_BYTES. Null texts count
    as empty and get the score of the prior; labels that are null or neither 0 nor 1 are left out; without labels of both
    classes all scores are alike. Repeated rows are scored alike; an empty table stays empty.
    """
    return score(docs.select("doc_id", "text"), fit(*sample(docs, labels, per_class)))
