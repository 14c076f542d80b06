"""Removal of repeated passages: exact substring deduplication by fixed-block anchors.

Non-overlapping blocks of ``span // 2`` words at fixed offsets of every text are the reference index;
every rolling window of the same width probes it. Any run of ``span`` equal words holds a whole block
of the text it is compared with, so a passage that occurs twice is always hit. Hits are extended to
both sides to the windows of ``span`` words that they may belong to; those windows alone are then
compared (by 96 bits from two hashes of every word, keyed anew in each run), each against its first occurrence, which is
told by doc_id and position, as rows of one doc_id may lie in several units. Adjoining
repeated windows make up maximal exact repeats, and the words these cover are removed.

Both lookups run as in ``exchange``: each unit of texts sends every distinct hash once, whatever the
number of copies, and pairs of occurrences are never made.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from barloom.llm.exchange import ANSWER, SENT, UNIT_BYTES, Layout, answered, answers, by_part, deal, distinct, gathered, pack, repeated, squeeze, swell
from barloom.llm.words import Words, inside, join_words, slices, split_words, utf8, windows, word_hashes

FIRST = "part int, unit int, n int, hashes binary, rest binary"
_OTHER = 0xA0761D6478BD642F
RESULT = "doc_id long, n_words long, n_removed long, kept string, repeats array<struct<start:long,end:long>>"


class Unit:
    """The texts of a unit with their windows."""

    def __init__(self, table: pa.Table, span: int, layout: Layout):
        self.data, self.offsets = utf8(table.column("text"))
        self.words: Words = split_words(self.data, self.offsets, fold=False, key=layout.key)
        self.span, self.layout, self.block = span, layout, span // 2
        ids = table.column("doc_id")
        self.known = ids.is_valid().to_numpy()
        self.ids = ids.fill_null(0).to_numpy()
        self.text_of = np.repeat(np.arange(len(self.ids)), np.diff(self.words.first))

    def probes(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The hashes of all rolling blocks, which of them lie within one text, and which are reference blocks."""
        hashes = windows(self.words.hash, self.block)
        whole = inside(self.words.first, self.block, len(hashes))
        whole &= self.known[self.text_of[: len(hashes)]]
        at = np.arange(len(hashes)) - self.words.first[self.text_of[: len(hashes)]]
        return hashes, whole, whole & (at % self.block == 0)

    def asked(self) -> tuple[np.ndarray, np.ndarray]:
        """Distinct probe hashes; for each a byte: 1 or 2 for one or more occurrences, and 4 if one is a reference block."""
        hashes, whole, fixed = self.probes()
        keys, times = distinct(hashes[whole], self.layout)
        blocks, _ = distinct(hashes[fixed], self.layout)
        flags = np.minimum(times, 2)
        flags[np.searchsorted(keys, blocks)] += 4
        return keys, flags

    def candidates(self, table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Windows of span words that hold a hit: where they start, their hashes (64 and 32 bits), and the order by hash."""
        hashes, whole, _ = self.probes()
        keys, _ = distinct(hashes[whole], self.layout)
        hit = np.zeros(len(hashes) + 1, np.int64)
        hit[:-1][whole] = answered(table, 0, len(keys))[np.searchsorted(keys, hashes[whole] >> np.uint64(32 - self.layout.bits))]
        sums = np.concatenate([[0], np.cumsum(hit)])
        long = windows(self.words.hash, self.span)
        ok = inside(self.words.first, self.span, len(long)) & self.known[self.text_of[: len(long)]]
        reach = self.span - self.block + 1
        at = np.arange(len(long))
        at = at[ok & (sums[at + reach] > sums[at])]
        check = windows(self._second_hashes(at), self.span, _OTHER)[at] >> np.uint64(32)
        order = np.lexsort((at - self.words.first[self.text_of[at]], self.ids[self.text_of[at]], check, long[at]))
        return at, long[at], check.astype(np.uint32), order

    def _second_hashes(self, at: np.ndarray) -> np.ndarray:
        """Hashes of the words of the windows at ``at`` by another key, 0 for other words."""
        w = self.words
        edge = np.zeros(len(w.hash) + 1, np.int64)
        edge[at] += 1
        edge[at + self.span] -= 1
        held = np.flatnonzero(np.cumsum(edge[:-1]))
        out = np.zeros(len(w.hash), np.uint64)
        out[held] = word_hashes(self.data, w.begin[held], w.end[held], self.layout.key ^ _OTHER)
        return out

    def firsts(self, at, long, check, order) -> tuple[np.ndarray, np.ndarray]:
        """Positions in ``order`` where a new window content starts; the group of each."""
        a, b = long[order], check[order]
        new = np.ones(len(order), bool)
        new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
        return np.flatnonzero(new), np.cumsum(new) - 1


def _send_firsts(unit: Unit, number: int, table: pa.Table) -> pa.Table:
    at, long, check, order = unit.candidates(table)
    heads, _ = unit.firsts(at, long, check, order)
    rows = order[heads]
    text = unit.text_of[at[rows]]
    keys, rest, ids, inner = long[rows], check[rows], unit.ids[text].astype("<i8"), (at[rows] - unit.words.first[text]).astype("<i4")
    out: dict[str, list] = {"part": [], "unit": [], "n": [], "hashes": [], "rest": []}
    for p, a, b in by_part(keys >> np.uint64(32 - unit.layout.bits), unit.layout):
        planes = np.concatenate([ids[a:b].view(np.uint8).reshape(-1, 8), inner[a:b].view(np.uint8).reshape(-1, 4)], axis=1)
        for k, v in (("part", p), ("unit", number), ("n", b - a), ("hashes", keys[a:b].tobytes() + rest[a:b].tobytes()), ("rest", squeeze(*planes.T))):
            out[k].append(v)
    kinds = {"part": pa.int32(), "unit": pa.int32(), "n": pa.int32(), "hashes": pa.binary(), "rest": pa.binary()}
    return pa.table({k: pa.array(v, kinds[k]) for k, v in out.items()})


def _earliest(table: pa.Table) -> pa.Table:
    """For each window content that a unit has: whether its first one there is the first of all (1) or not (0)."""
    units, sizes = table.column("unit").to_pylist(), table.column("n").to_pylist()
    keys, check, ids, inner = [], [], [], []
    for n, packed, rest in zip(sizes, table.column("hashes").to_pylist(), table.column("rest").to_pylist(), strict=True):
        keys.append(np.frombuffer(packed, np.uint64, n))
        check.append(np.frombuffer(packed, np.uint32, n, 8 * n))
        planes = swell(rest, 12 * n).reshape(12, n)
        ids.append(np.ascontiguousarray(planes[:8].T).reshape(-1).view("<i8"))
        inner.append(np.ascontiguousarray(planes[8:].T).reshape(-1).view("<i4"))
    keys, check, ids, inner = (np.concatenate(x) for x in (keys, check, ids, inner))
    order = np.lexsort((inner, ids, check, keys))
    new = np.ones(len(order), bool)
    new[1:] = (keys[order][1:] != keys[order][:-1]) | (check[order][1:] != check[order][:-1])
    out = np.zeros(len(order), np.uint8)
    head = order[new][np.cumsum(new) - 1]
    out[order] = (ids[order] == ids[head]) & (inner[order] == inner[head])
    ends = np.cumsum([0, *sizes])
    n = len(units)
    return pa.table({"unit": pa.array(units, pa.int32()), "part": pa.array([table.column("part")[0].as_py()] * n, pa.int32()), "kind": pa.array([1] * n, pa.int32()), "n": pa.array(sizes, pa.int32()), "answer": pa.array([squeeze(out[a:b]) for a, b in zip(ends[:-1], ends[1:], strict=True)], pa.binary())})


def _cut(unit: Unit, table: pa.Table, ids) -> pa.Table:
    at, long, check, order = unit.candidates(table)
    heads, group = unit.firsts(at, long, check, order)
    holds = answered(table, 1, len(heads)).astype(bool)
    text, start = unit.text_of[at[order]], at[order]
    # The head of a group is its first occurrence in this unit; rows that share a doc_id share positions.
    head = order[heads][group]
    inner = at - unit.words.first[unit.text_of[at]]
    same = (unit.ids[text] == unit.ids[unit.text_of[at[head]]]) & (inner[order] == inner[head])
    repeated = start[~(holds[group] & same)]
    edge = np.zeros(len(unit.words.hash) + 1, np.int64)
    np.add.at(edge, repeated, 1)
    np.add.at(edge, repeated + unit.span, -1)
    return _result(unit, np.cumsum(edge[:-1]) > 0, ids)


def _result(unit: Unit, gone: np.ndarray, ids) -> pa.Table:
    n = np.diff(unit.words.first)
    removed = np.diff(np.concatenate([[0], np.cumsum(gone)])[unit.words.first])
    kept, ends = join_words(unit.data, unit.words, ~gone)
    spans = []
    for a, b in zip(unit.words.first[:-1], unit.words.first[1:], strict=True):
        flags = np.concatenate([[False], gone[a:b], [False]]).astype(np.int8)
        turn = np.flatnonzero(np.diff(flags))
        spans.append([{"start": int(x), "end": int(y)} for x, y in zip(turn[::2], turn[1::2], strict=True)])
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    return pa.table({"doc_id": ids, "n_words": pa.array(n, pa.int64()), "n_removed": pa.array(removed, pa.int64()), "kept": pa.Array.from_buffers(pa.string(), len(n), [None, pa.py_buffer(ends.astype(np.int32).tobytes()), pa.py_buffer(kept.tobytes())]), "repeats": pa.array(spans, kind)})


def remove_repeats(docs: DataFrame, span: int = 20) -> DataFrame:
    """``(doc_id, n_words, n_removed, kept, repeats)`` for each row of ``docs(doc_id, text)``.

    A window is ``span`` consecutive words ``[^\\x20\\x09-\\x0D]+`` of one text. Every word goes that a
    window covers whose words also start earlier: in a smaller doc_id, or before in the same document.
    kept: the other words joined by one space; repeats: the removed maximal runs as word positions, end
    exclusive. Null and empty texts have no words and an empty ``kept``. Rows that share a doc_id are
    versions of one document: equal words at equal positions are no repeat of each other. Rows with a
    null doc_id neither lose words nor count as earlier. Other columns of ``docs`` are not read; an
    empty table gives an empty result.
    """
    if span < 2:
        raise ValueError("span must be at least 2")
    rows, many = gathered(docs.filter("doc_id is not null"))
    dealt, layout = deal(rows, "text", "times")

    def alone(batches):  # rows that lose nothing and count for nothing; any number of them make no unit large
        for batch in batches:
            for part in slices(batch, "text", UNIT_BYTES):
                unit = Unit(pa.Table.from_batches([part]), span, layout)
                yield from _result(unit, np.zeros(len(unit.words.hash), bool), part.column("doc_id")).to_batches()

    unknown = docs.filter("doc_id is null").select("doc_id", "text").mapInArrow(alone, RESULT)

    def probe(table: pa.Table) -> pa.Table:
        return pack(table.column("unit")[0].as_py(), *Unit(table, span, layout).asked(), layout)

    def found_twice(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
        return ((np.add.reduceat(values & 3, starts) > 1) & (np.bitwise_or.reduceat(values, starts) >= 4)).astype(np.uint8)

    def send(left: pa.Table, right: pa.Table) -> pa.Table:
        return _send_firsts(Unit(left, span, layout), left.column("unit")[0].as_py(), right)

    def cut(left: pa.Table, right: pa.Table) -> pa.Table:
        return _cut(Unit(left, span, layout), right, left.column("doc_id")).append_column("times", left.column("times"))

    hits = answers(0, dealt.groupBy("unit").applyInArrow(probe, SENT), found_twice)
    sent = dealt.groupBy("unit").cogroup(hits.groupBy("unit")).applyInArrow(send, FIRST)
    first = sent.groupBy("part").applyInArrow(_earliest, ANSWER)
    found = dealt.groupBy("unit").cogroup(hits.unionAll(first).groupBy("unit")).applyInArrow(cut, f"{RESULT}, times long")
    return repeated(found, many).unionAll(unknown)
