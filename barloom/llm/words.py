"""Vectorised word splitting and hashing of UTF-8 columns, for use inside Arrow tasks.

All functions work on the byte buffer of a whole column, so no Python object is made for a word.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Bytes that are hashed at a time; a text is never split, so one longer text is hashed alone.
CHUNK = 1_000_000
#: Longer words are hashed one by one.
LONG_WORD = 256
_STEP = np.uint64(0xD6E8FEB86659FD93)
#: The key of hashes that must be alike in every run, as those of features.
FIXED = 0x9E3779B97F4A7C15
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the entropy of 64-bit values over all bits."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def slices(batch: pa.RecordBatch, column: str, size: int) -> Iterator[pa.RecordBatch]:
    """Slices of a batch that hold ``size`` bytes of a column, or one row."""
    sizes = np.cumsum([0, *(len(x.as_buffer()) if x.is_valid else 0 for x in batch.column(column))])
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(sizes, sizes[at] + size, "right")) - 1)
        yield batch.slice(at, to - at)
        at = to


def word_hashes(data: np.ndarray, begin: np.ndarray, end: np.ndarray, key: int) -> np.ndarray:
    """64 bits for the bytes of each word, taken in blocks of 8, each mixed in before the next.

    Different words have equal bits with a chance of 2**-64 whatever they are, if ``key`` is drawn at
    random. Words of up to 8 bytes and one length never do.
    """
    size, odd = end - begin, np.uint64((key * 2 + 1) % 2**64)
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    block_at = np.ndarray(len(data) + 1, "<u8", padded, strides=(1,))
    with np.errstate(over="ignore"):
        out = mix(size.astype(np.uint64) * _STEP + np.uint64(key % 2**64))
        rows, at = np.arange(len(size)), 0
        while len(rows):
            spare = np.maximum(0, 8 - (size[rows] - at)) * 8
            block = block_at[begin[rows] + at] << spare.astype(np.uint64)
            out[rows] = mix((out[rows] ^ block) * odd)
            at += 8
            rows = rows[(size[rows] > at) & (size[rows] <= LONG_WORD)]
    secret = (key % 2**64).to_bytes(8, "little")
    for i in np.flatnonzero(size > LONG_WORD):
        out[i] = int.from_bytes(hashlib.blake2b(data[begin[i] : end[i]].tobytes(), digest_size=8, key=secret).digest(), "little")
    return out


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary column and the ends of its values; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None and column.buffers()[2].size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


@dataclass
class Words:
    """``begin``, ``end``: byte offsets of each word; ``hash``: 64 bits of its content; words of text i are first[i]:first[i+1]."""

    begin: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    first: np.ndarray


def split_words(data: np.ndarray, offsets: np.ndarray, fold: bool, key: int = FIXED) -> Words:
    """Words ``[^\\x20\\x09-\\x0D]+`` of every text. fold: A-Z and a-z hash alike."""
    begins, ends, hashes, per_text = [], [], [], []
    n, at = len(offsets) - 1, 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + CHUNK, "right")) - 1)
        base = offsets[at]
        part, bounds = data[base : offsets[to]], offsets[at : to + 1] - base
        space = _SPACE[part]
        before, after = np.ones(len(part), bool), np.ones(len(part), bool)
        before[1:], after[:-1] = space[:-1], space[1:]
        before[bounds[:-1][bounds[:-1] < len(part)]] = True
        after[bounds[1:][bounds[1:] > 0] - 1] = True
        b, e = np.flatnonzero(~space & before), np.flatnonzero(~space & after) + 1
        hashes.append(word_hashes(_LOWER[part] if fold else part, b, e, key))
        begins.append(b + base)
        ends.append(e + base)
        per_text.append(np.diff(np.searchsorted(b, bounds)))
        at = to
    join = lambda xs, kind: np.concatenate(xs) if xs else np.zeros(0, kind)
    first = np.zeros(n + 1, np.int64)
    np.cumsum(join(per_text, np.int64), out=first[1:])
    return Words(join(begins, np.int64), join(ends, np.int64), join(hashes, np.uint64), first)


def join_words(data: np.ndarray, words: Words, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The kept words of each text joined by one space: bytes and the ends of the texts."""
    size, n = words.end - words.begin, len(words.first) - 1
    letters = np.zeros(len(data) + 1, np.int8)
    letters[words.begin] += 1
    np.add.at(letters, words.end, -1)
    solid = data[np.cumsum(letters[:-1]).astype(bool)]
    last = np.full(n, -1)
    last[np.repeat(np.arange(n), np.diff(words.first))[keep]] = np.flatnonzero(keep)
    gap = np.ones(len(size), np.int64)
    gap[last[last >= 0]] = 0
    ends = np.concatenate([[0], np.cumsum(np.where(keep, size + gap, 0))])
    out = np.full(int(ends[-1]), 32, np.uint8)
    word = np.repeat(np.arange(len(size)), size)
    within = np.arange(len(solid)) - np.repeat(np.cumsum(size) - size, size)
    chosen = keep[word]
    out[(ends[word] + within)[chosen]] = solid[chosen]
    return out, ends[words.first]


def windows(hashes: np.ndarray, k: int, step: int = int(_STEP)) -> np.ndarray:
    """A 64-bit hash of each k consecutive word hashes (windows over the edge of a text are there too)."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        out = np.zeros(n, np.uint64)
        for j in range(k):
            out = out * np.uint64(step) + hashes[j : j + n]
        return mix(out)


def inside(first: np.ndarray, k: int, n: int) -> np.ndarray:
    """Which of the n windows of k words lie within one text."""
    ok = np.ones(max(n, 0), bool)
    for edge in first[1:-1]:
        ok[max(0, edge - k + 1) : edge] = False
    return ok


def shingle_sets(words: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingles of each text, sorted within it, and the ends of the sets. A text of fewer than k words is one shingle."""
    win, out, sizes = windows(words.hash, k), [], np.zeros(len(words.first) - 1, np.int64)
    for i, (a, b) in enumerate(zip(words.first[:-1], words.first[1:], strict=True)):
        if b - a >= k:
            own = np.sort(win[a : b - k + 1])
            own = own[np.concatenate([[True], own[1:] != own[:-1]])]
        elif b > a:
            own = mix(windows(words.hash[a:b], int(b - a)) + np.uint64(b - a))
        else:
            continue
        out.append(own)
        sizes[i] = len(own)
    ends = np.zeros(len(sizes) + 1, np.int64)
    np.cumsum(sizes, out=ends[1:])
    return (np.concatenate(out) if out else np.zeros(0, np.uint64)), ends
