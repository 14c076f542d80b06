"""Counting of 64-bit hashes over the whole corpus, with the answers brought back to the texts.

Texts are dealt to *units* of a few megabytes by a hash of id and text, so that no id that many rows share
makes a unit large. Rows equal in both are one row with their number (``gathered``) and are
made again at the end (``repeated``). Hashes are dealt to *parts* by their leading bits. A
unit sends each part that it has hashes for one packed row; the part adds up what all units sent and
answers in the same order. So rows are at most the distinct hashes of all units, however many units
and parts there are. A hash that occurs a million times in a unit is sent
once, so frequent hashes make no part large, and no table of all hashes is ever broadcast.
"""

from __future__ import annotations

import secrets
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import HOT_KEYS, HOT_ROWS, cut, shuffle_partitions

UNIT_BYTES, PART_BYTES = 4_000_000, 12_000_000
_ZSTD = pa.Codec("zstd", 1)
SENT = "part int, unit int, n int, low binary, high binary"
ANSWER = "unit int, part int, kind int, n int, answer binary"
MANY = 255
#: Fewer bytes are not compressed.
SMALL = 64
#: Copies of a row that one task makes.
COPIES = 100_000


@dataclass(frozen=True)
class Layout:
    """Numbers of units and (as bits) of parts, and the key of the word hashes, drawn anew for each run."""

    units: int
    bits: int
    key: int

    def part(self, hashes: np.ndarray) -> np.ndarray:
        return (hashes >> np.uint64(64 - self.bits)).astype(np.int64)

    def rest(self, hashes: np.ndarray) -> np.ndarray:
        """The 32 bits after the part's."""
        return (hashes >> np.uint64(32 - self.bits)).astype(np.uint32)


def gathered(docs: DataFrame, text: str = "text") -> tuple[DataFrame, bool]:
    """(doc_id, text, times), and whether any row stands for several.

    Rows that are equal in id and text and many become one. They are found by a 64-bit hash of both,
    of which at most HOT_KEYS are broadcast, and told by id and text themselves; each task that reads some sends one.
    """
    rows = docs.select("doc_id", F.col(text).alias("text"))
    same = F.xxhash64("doc_id", "text").alias("_same")
    sizes = rows.groupBy(same).agg(F.count("*").alias("n"))
    limit = max(HOT_ROWS, rows.count() // HOT_KEYS)
    hot = cut(sizes.filter(F.col("n") >= limit).select("_same"))
    if not hot.limit(1).count():
        return rows.withColumn("times", F.lit(1).cast("long")), False
    tagged, one = rows.withColumn("_same", same), F.lit(1).cast("long").alias("times")
    others = tagged.join(F.broadcast(hot), "_same", "left_anti").select("doc_id", "text", one)
    return others.unionAll(tagged.join(F.broadcast(hot), "_same").groupBy("doc_id", "text").agg(F.count("*").alias("times"))), True


def repeated(rows: DataFrame, many: bool) -> DataFrame:
    """Each row as often as ``times`` says, without it; the copies of one row are made by as many tasks as they need."""
    names = [c for c in rows.columns if c != "times"]
    if not many:
        return rows.select(*names)
    dealt = rows.filter("times > 1").withColumn("_share", F.explode(F.sequence(F.lit(0), F.floor((F.col("times") - 1) / COPIES))))
    copies = F.sequence(F.lit(1), F.least(F.lit(COPIES), F.col("times") - F.col("_share") * COPIES))
    return rows.filter("times = 1").select(*names).unionAll(dealt.repartition("doc_id", "_share").withColumn("_copy", F.explode(copies)).select(*names))


def deal(docs: DataFrame, text: str = "text", *more: str) -> tuple[DataFrame, Layout]:
    """(unit, doc_id, text, *more) and the layout; their numbers follow the bytes of text."""
    total = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    dealt = shuffle_partitions(docs.sparkSession)
    layout = Layout(max(2 * dealt, -(-total // UNIT_BYTES)), max(4, int(max(dealt // 2, total // PART_BYTES) - 1).bit_length()), secrets.randbits(63))
    unit = F.pmod(F.xxhash64("doc_id", text), F.lit(layout.units)).cast("int").alias("unit")
    return docs.select(unit, "doc_id", F.col(text).alias("text"), *more), layout


def squeeze(*planes: np.ndarray) -> bytes:
    raw = b"".join(np.ascontiguousarray(x).tobytes() for x in planes)
    return raw if len(raw) < SMALL else _ZSTD.compress(raw, asbytes=True)


def swell(packed: bytes, size: int) -> np.ndarray:
    return np.frombuffer(packed if size < SMALL else _ZSTD.decompress(packed, size, asbytes=True), np.uint8)


def distinct(hashes: np.ndarray, layout: Layout) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys (part and rest in one number) and how often each occurs."""
    keys = np.sort(hashes >> np.uint64(32 - layout.bits))
    if not len(keys):
        return keys, np.zeros(0, np.int64)
    at = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[at], np.diff(np.append(at, len(keys)))


def by_part(keys: np.ndarray, layout: Layout) -> list[tuple[int, int, int]]:
    """(part, from, to) for the parts that sorted keys fall into."""
    if not len(keys):
        return []
    part = (keys >> np.uint64(32)).astype(np.int64)
    edges = np.concatenate([[0], np.flatnonzero(part[1:] != part[:-1]) + 1, [len(keys)]])
    return list(zip(part[edges[:-1]].tolist(), edges[:-1].tolist(), edges[1:].tolist(), strict=True))


def pack(unit: int, keys: np.ndarray, values: np.ndarray, layout: Layout) -> pa.RecordBatch:
    """The rows that a unit sends: distinct keys as packed differences, and a byte for each."""
    rows: dict[str, list] = {"part": [], "unit": [], "n": [], "low": [], "high": []}
    for p, a, b in by_part(keys, layout):
        rest = (keys[a:b] & np.uint64(0xFFFFFFFF)).astype(np.uint32)
        planes = np.diff(rest, prepend=np.uint32(0)).astype("<u4").view(np.uint8).reshape(-1, 4)
        for k, v in (("part", p), ("unit", unit), ("n", b - a), ("low", np.ascontiguousarray(planes[:, :2]).tobytes()), ("high", squeeze(planes[:, 2], planes[:, 3], values[a:b].astype(np.uint8)))):
            rows[k].append(v)
    kinds = {"part": pa.int32(), "unit": pa.int32(), "n": pa.int32(), "low": pa.binary(), "high": pa.binary()}
    return pa.table({k: pa.array(v, kinds[k]) for k, v in rows.items()})


def unpack(n: int, low: bytes, high: bytes) -> tuple[np.ndarray, np.ndarray]:
    planes = np.empty((n, 4), np.uint8)
    planes[:, :2] = np.frombuffer(low, np.uint8).reshape(-1, 2)
    rest = swell(high, 3 * n)
    planes[:, 2], planes[:, 3] = rest[:n], rest[n : 2 * n]
    return np.cumsum(planes.reshape(-1).view("<u4"), dtype=np.uint32), rest[2 * n :]


def answers(kind: int, sent: DataFrame, combine) -> DataFrame:
    """combine(values, starts) -> one byte for each group of equal keys; every unit gets its keys' bytes back."""

    def answer(table: pa.Table) -> pa.Table:
        units, sizes = table.column("unit").to_pylist(), table.column("n").to_pylist()
        got = [unpack(n, low, high) for n, low, high in zip(sizes, table.column("low").to_pylist(), table.column("high").to_pylist(), strict=True)]
        keys, values = np.concatenate([x[0] for x in got]), np.concatenate([x[1] for x in got])
        tagged = (keys.astype(np.uint64) << np.uint64(32)) | np.arange(len(keys), dtype=np.uint64)
        tagged.sort()
        order, key = (tagged & np.uint64(0xFFFFFFFF)).astype(np.int64), tagged >> np.uint64(32)
        starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        out = np.empty(len(keys), np.uint8)
        out[order] = np.repeat(combine(values[order].astype(np.int64), starts), np.diff(np.append(starts, len(keys))))
        ends = np.cumsum([0, *sizes])
        packed = [squeeze(out[a:b]) for a, b in zip(ends[:-1], ends[1:], strict=True)]
        part = table.column("part")[0].as_py()
        return pa.table({"unit": pa.array(units, pa.int32()), "part": pa.array([part] * len(units), pa.int32()), "kind": pa.array([kind] * len(units), pa.int32()), "n": pa.array(sizes, pa.int32()), "answer": pa.array(packed, pa.binary())})

    return sent.groupBy("part").applyInArrow(answer, ANSWER)


def answered(table: pa.Table, kind: int, size: int) -> np.ndarray:
    """The bytes for a unit's sorted distinct keys, from its answers."""
    rows = [x for x in table.to_pylist() if x["kind"] == kind]
    rows.sort(key=lambda x: x["part"])
    out = np.concatenate([np.zeros(0, np.uint8), *(swell(x["answer"], x["n"]) for x in rows)])
    if len(out) != size:
        raise RuntimeError(f"a unit asked for {size} hashes and got {len(out)} answers")
    return out
