"""Periodic runs of words in every text, found by string synchronising sets.

A run is a stretch whose words repeat with a smallest period, at least twice, and that no neighbouring
word extends. For every scale t = 1, 2, 4, ... the runs of periods 3t to 6t - 1 are looked for:

1. A position is chosen if, of the windows of t words that start in the next t + 1 positions, the first
   or the last has the least hash. Windows inside stretches of period t / 3 or less take no part. Whether a
   position is chosen depends on the next 2t words (its context) alone, so equal contexts are chosen alike,
   and wherever no position is chosen over t words, all is of one period of t / 3 or less.
2. Chosen positions with equal contexts 3t to 6t - 1 apart propose their distance as a period. Equal
   contexts are more than t / 3 apart, so each position has a fixed number of partners at most.
3. A run without such a pair holds its two copies in two touching stretches of one small period p, found
   at smaller scales (and directly for 1 and 2); their phases leave one period modulo p.

Proposals are extended over equal words to both sides by comparing windows of 1,024, 256, ..., 1 words.
The texts of a slice are laid out one after the other, longest first, each followed by a word of its own;
so a scale looks at a prefix of the layout, and no run leaves its text.
"""

from __future__ import annotations

import secrets

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from barloom.llm.words import join_words, mix, slices, split_words, utf8

#: Bytes of text that are laid out at a time; a longer text is alone.
SLICE_BYTES = 1_000_000
#: Sizes of the windows that extensions compare.
STEPS = (1, 4, 16, 64, 256, 1024)
_NONE = np.uint64(2**64 - 1)
RESULT = "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"


def joined_windows(fingerprint: np.ndarray, size: int) -> np.ndarray:
    """Fingerprints of the windows of 2 * size words from those of size words."""
    with np.errstate(over="ignore"):
        return mix(fingerprint[:-size] * np.uint64(0x9E3779B97F4A7C15) + fingerprint[size:])


def _tables(words: np.ndarray, longest: int) -> list[tuple[int, np.ndarray]]:
    """(size, fingerprints of the windows of that size) for the STEPS that a text can hold."""
    out, size, fingerprint = [(1, words)], 1, words
    while size * 2 <= min(longest, STEPS[-1]) and len(fingerprint) > size:
        fingerprint = joined_windows(fingerprint, size)
        size *= 2
        if size in STEPS:
            out.append((size, fingerprint))
    return out


def _forward(tables: list, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """How many words from i and from j on are equal, for each pair i < j."""
    i, j = i.copy(), j.copy()
    start = i.copy()
    for size, fingerprint in reversed(tables):
        live = np.arange(len(i))
        while len(live):
            live = live[j[live] < len(fingerprint)]
            live = live[fingerprint[i[live]] == fingerprint[j[live]]]
            i[live] += size
            j[live] += size
    return i - start


def _backward(tables: list, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """How many words before i and before j are equal, for each pair i < j."""
    i, j = i.copy(), j.copy()
    start = i.copy()
    for size, fingerprint in reversed(tables):
        live = np.arange(len(i))
        while len(live):
            live = live[i[live] >= size]
            live = live[fingerprint[i[live] - size] == fingerprint[j[live] - size]]
            i[live] -= size
            j[live] -= size
    return start - i


class Runs:
    """The runs found so far: ``start``, ``end`` and smallest ``period``."""

    def __init__(self):
        self.start = self.end = self.period = np.zeros(0, np.int64)

    def add(self, start: np.ndarray, end: np.ndarray, period: np.ndarray) -> None:
        """A stretch that is there twice stays with its smallest period."""
        start, end, period = (np.concatenate(x) for x in ((self.start, start), (self.end, end), (self.period, period)))
        order = np.lexsort((period, end, start))
        start, end, period = start[order], end[order], period[order]
        new = np.ones(len(start), bool)
        new[1:] = (start[1:] != start[:-1]) | (end[1:] != end[:-1])
        self.start, self.end, self.period = start[new], end[new], period[new]

    def extend(self, tables: list, at: np.ndarray, period: np.ndarray) -> None:
        """Add the runs of these periods around these positions, if there are any."""
        end = at + _forward(tables, at, at + period)
        start = at - _backward(tables, at, at + period)
        run = end - start >= period
        self.add(start[run], (end + period)[run], period[run])

    def select(self, longest_period: int, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        ok = (self.period <= longest_period) & (self.end - self.start >= length)
        return self.start[ok], self.end[ok], self.period[ok]


def _direct(words: np.ndarray, period: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The stretches of one small period, word by word."""
    same = np.concatenate([[False], words[:-period] == words[period:], [False]]).astype(np.int8)
    turn = np.flatnonzero(np.diff(same))
    start, end = turn[::2], turn[1::2]
    long = end - start >= period
    return start[long], end[long] + period, np.full(int(long.sum()), period, np.int64)


def chosen(fingerprint: np.ndarray, t: int, periodic: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Positions whose next t + 1 windows of t words have their least hash first or last; see the module's text.

    periodic: starts and ends of the stretches of period t / 3 or less, whose windows take no part.
    """
    n = len(fingerprint)
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, periodic[0], 1)
    np.add.at(edge, periodic[1] - t + 1, -1)
    ids = np.where(np.cumsum(edge[:-1]) > 0, _NONE, fingerprint)
    least, width = ids, 1
    while width < t:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    least = np.minimum(least[:-1], least[1:])
    m = len(least)
    return np.flatnonzero((least != _NONE) & ((least == ids[:m]) | (least == ids[t : t + m])))


def _pairs(at: np.ndarray, context: np.ndarray, t: int) -> tuple[np.ndarray, np.ndarray]:
    """(position, period) from chosen positions with equal contexts 3t to 6t - 1 apart."""
    order = np.argsort(context, kind="stable")
    at, context = at[order], context[order]
    found, lag = [], 1
    while lag < len(at):
        gap = at[lag:] - at[:-lag]
        near = (context[lag:] == context[:-lag]) & (gap < 6 * t)
        if not near.any():
            break
        far = near & (gap >= 3 * t)
        found.append((at[:-lag][far], gap[far]))
        lag += 1
    if not found:
        return at[:0], at[:0]
    at, period = (np.concatenate(x) for x in zip(*found, strict=True))
    order = np.lexsort((at, period))
    at, period = at[order], period[order]
    # Contexts that touch are parts of one stretch.
    first = np.ones(len(at), bool)
    first[1:] = (period[1:] != period[:-1]) | (at[1:] - at[:-1] > 2 * t)
    return at[first], period[first]


def _between(tables: list, regions: tuple[np.ndarray, np.ndarray, np.ndarray], t: int) -> tuple[np.ndarray, np.ndarray]:
    """(position, period) from touching stretches of one small period, for periods 3t to 6t - 1."""
    start, end, period = regions
    order = np.lexsort((start, period))
    start, end, period = start[order], end[order], period[order]
    found = []
    for k in np.flatnonzero((period[1:] == period[:-1]) & (start[1:] <= end[:-1])):
        s1, e1, s2, e2, p = int(start[k]), int(end[k]), int(start[k + 1]), int(end[k + 1]), int(period[k])
        shift = s2 + np.arange(p)
        phase = shift[_forward(tables, np.full(p, e1 - p), shift) >= p] - (e1 - p)
        if not len(phase):
            continue
        most = min(6 * t - 1, e1 - s1, e2 - s2, (e2 - s1) // 2)
        periods = np.arange(3 * t + (int(phase[0]) - 3 * t) % p, most + 1, p)
        found.append((np.maximum(s1, s2 - periods), periods))
    if not found:
        return start[:0], start[:0]
    at, periods = (np.concatenate(x) for x in zip(*found, strict=True))
    return at.astype(np.int64), periods.astype(np.int64)


def find_runs(words: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(start, end, period)`` of every run of at least two periods in texts of hashed words.

    Words of text i are first[i]:first[i+1]; starts and ends count the words of all texts. Sorted by start
    and period.
    """
    size = np.diff(first)
    order = np.argsort(-size, kind="stable")
    size = size[order]
    base = np.concatenate([[0], np.cumsum(size + 1)])  # of each text in the layout
    shift = first[:-1][order] - base[:-1]  # of each text from the layout to the words
    x = mix(np.arange(base[-1], dtype=np.uint64) + np.uint64(secrets.randbits(63)))
    inner = np.ones(len(x), bool)
    inner[base[1:] - 1] = False
    x[inner] = words[np.flatnonzero(inner) + np.repeat(shift, size)]

    runs, longest = Runs(), int(size[0]) if len(size) else 0
    for period in (1, 2):
        if len(x) > period:
            runs.add(*_direct(x, period))
    tables = _tables(x, longest)
    t, fingerprint = 1, x
    while 6 * t <= longest:
        n = int(base[np.searchsorted(-size, -6 * t, "right")])  # the texts of 6t words and more
        fingerprint = fingerprint[: n - t + 1]
        context = joined_windows(fingerprint, t)
        small = runs.select(t // 3, t)
        small = tuple(v[small[1] <= n] for v in small)
        at = chosen(fingerprint, t, small[:2])
        proposed = _pairs(at, context[at], t)
        regions = tuple(v[small[1] - small[0] >= 3 * t - 1] for v in small)
        beside = _between(tables, regions, t)
        runs.extend(tables, np.concatenate([proposed[0], beside[0]]), np.concatenate([proposed[1], beside[1]]))
        t, fingerprint = 2 * t, context
    moved = shift[np.searchsorted(base, runs.start, "right") - 1]
    start, end = runs.start + moved, runs.end + moved
    order = np.lexsort((runs.period, start))
    return start[order], end[order], runs.period[order]


def _collapse(batch: pa.RecordBatch, min_length: int) -> pa.RecordBatch:
    data, offsets = utf8(batch.column("text"))
    words = split_words(data, offsets, fold=False, key=secrets.randbits(63))
    start, end, period = find_runs(words.hash, words.first)
    long = end - start >= np.maximum(min_length, 2 * period)
    start, end, period = start[long], end[long], period[long]
    edge = np.zeros(len(words.hash) + 1, np.int64)
    np.add.at(edge, start + period, 1)
    np.add.at(edge, end, -1)
    kept, ends = join_words(data, words, np.cumsum(edge[:-1]) <= 0)
    bounds = np.searchsorted(start, words.first)
    inner = start - np.repeat(words.first[:-1], np.diff(bounds))
    fields = [pa.array(v, pa.int64()) for v in (inner, end - start, period)]
    listed = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.StructArray.from_arrays(fields, ["start", "length", "period"]))
    text = pa.Array.from_buffers(pa.string(), batch.num_rows, [None, pa.py_buffer(ends.astype(np.int32).tobytes()), pa.py_buffer(kept.tobytes())])
    return pa.record_batch({"doc_id": batch.column("doc_id"), "n_words": pa.array(np.diff(words.first), pa.int64()), "runs": listed, "collapsed": text})


def periodic_runs(docs: DataFrame, min_length: int = 12) -> DataFrame:
    """``(doc_id, n_words, runs, collapsed)`` for each row of ``docs(doc_id, text)``.

    Words are ``[^\\x20\\x09-\\x0D]+``, numbered from 0, and compared by 64 bits with a key of the task. runs:
    every stretch of at least ``min_length`` words and two smallest periods that no neighbouring word extends,
    by start and then period, as (start, length, period). collapsed: the words that no run holds after its
    first period, joined by one space. Null and empty texts have no words, no runs and an empty collapsed
    text. Rows are judged one by one, so null and repeated ids and repeated rows are no matter. Other columns
    are not read; an empty table gives an empty result. A task holds one slice of about 1 MB of text at a
    time; a longer text is worked on alone, in about 150 bytes a word.
    """
    if min_length < 2:
        raise ValueError("min_length must be at least 2")

    def work(batches):
        for batch in batches:
            for part in slices(batch, "text", SLICE_BYTES):
                yield _collapse(part, min_length)

    return docs.select("doc_id", "text").mapInArrow(work, RESULT)
