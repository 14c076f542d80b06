"""How filters overlap: what each removes at each place of each order, from sorted posting lists.

Rows are dealt into ranges of a part's ids and sorted. Every range keeps, for each filter, the sorted
numbers of its rows that fail, and the same for each mark (such as a label). What a filter removes after a
set of others is the difference of its list from the union of theirs; unions grow list by list, and both
are found by galloping through the longer list. Only sizes leave a range, and they are summed by part.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.llm.common import attach, cut

#: Consecutive keys that are looked up together, within the stretch that galloping has found for them.
STRIDE = 64
LISTS = "part string, n long, ids array<long>, failing array<array<int>>, marked array<array<int>>"
SPACES = "[\\x20\\x09-\\x0D]+"


def text_filters(docs: DataFrame) -> DataFrame:
    """``docs(doc_id, text, lang)`` as ``(doc_id, part, A, B, C, D, digest)``; true means that the filter fails.

    A: under 200 words; B: fewer distinct words than half of the words; C: over 3 capitals A-Z in 100 code
    points; D: holds any of ``#$%&*|``. Words are ``[^\\x20\\x09-\\x0D]+``, case-sensitive. A null text is
    empty (only A fails), a null lang the part ''. digest is the SHA-256 of the text.
    """
    text = F.coalesce("text", F.lit(""))
    words = F.array_remove(F.split(text, SPACES), "")
    rows = docs.select("doc_id", F.coalesce("lang", F.lit("")).alias("part"), text.alias("text"), words.alias("words"))
    capitals = F.length("text") - F.length(F.regexp_replace("text", "[A-Z]+", ""))
    return rows.select(
        "doc_id", "part",
        (F.size("words") < 200).alias("A"),
        (100 * F.size(F.array_distinct("words")) < 50 * F.size("words")).alias("B"),
        (100 * capitals > 3 * F.length("text")).alias("C"),
        F.col("text").rlike("[#$%&*|]").alias("D"),
        F.unhex(F.sha2("text", 256)).alias("digest"),
    )


def first_copies(rows: DataFrame, name: str) -> DataFrame:
    """``rows(doc_id, digest, ...)`` with the flag ``name``: a smaller doc_id has the same digest.

    Rows with a null doc_id are never flagged and count for no other. Digests with many rows are broadcast.
    """
    seen = rows.groupBy("digest").agg(F.min("doc_id").alias("_first"), F.count("*").alias("_n")).filter("_n > 1")
    repeated = cut(seen)
    total = repeated.agg(F.sum("_n")).first()[0] or 0
    joined = attach(rows, repeated, ["digest"], "_n", total, how="left")
    return joined.withColumn(name, F.coalesce(F.col("doc_id") > F.col("_first"), F.lit(False))).drop("_first")


def gallop(keys: np.ndarray, into: np.ndarray) -> np.ndarray:
    """The place of each of the sorted keys in a sorted list, found by doubling steps from the place before."""
    out, at = np.empty(len(keys), np.int64), 0
    for i in range(0, len(keys), STRIDE):
        some = keys[i : i + STRIDE]
        at = _ahead(into, at, some[0])
        to = _ahead(into, at, some[-1])
        out[i : i + STRIDE] = at + np.searchsorted(into[at:to], some)
        at = to
    return out


def _ahead(into: np.ndarray, at: int, key: int) -> int:
    step = 1
    while at + step <= len(into) and into[at + step - 1] < key:
        at += step
        step *= 2
    return at + int(np.searchsorted(into[at : at + step], key))


def split(keys: np.ndarray, into: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The keys that a list doesn't hold, and their places in it; both are sorted and without repeats."""
    at = gallop(keys, into)
    new = at == len(into)
    new[~new] = into[at[~new]] != keys[~new]
    return keys[new], at[new]


def common(keys: np.ndarray, into: np.ndarray) -> int:
    """How many keys a list holds."""
    if len(keys) > len(into):
        keys, into = into, keys
    return len(keys) - len(split(keys, into)[0])


def sizes(failing: list[np.ndarray], marked: list[np.ndarray]) -> Iterator[tuple[int, int, int, int, list[int]]]:
    """(filter, set of filters before, rows that all of them remove, rows that the filter removes, those of each mark)."""
    unions = [np.zeros(0, np.int64)]
    for before in range(1, 2 ** len(failing)):
        last = before.bit_length() - 1
        rest = unions[before - (1 << last)]
        keys, at = split(failing[last], rest)
        unions.append(np.insert(rest, at, keys))
    for before, union in enumerate(unions):
        for f, ids in enumerate(failing):
            if not before >> f & 1:
                removed = split(ids, union)[0]
                yield f, before, len(union) + len(removed), len(removed), [common(removed, m) for m in marked]


def posting_lists(rows: DataFrame, filters: list[str], marks: list[str]) -> DataFrame:
    """``(part, n, ids, failing, marked)``: one row for each range of ids of a part.

    ``rows(doc_id, part, row, ...)`` has a boolean column for each filter and mark, and ``row``, a number
    that no two rows share. ids are the doc_ids of a range in order, null first; ``failing[f]`` and
    ``marked[m]`` are the sorted places in it of the rows that fail filter f or bear mark m. A range is part of
    an Arrow batch, so neither a frequent part nor a frequent doc_id makes one large.
    """
    flags = lambda names: F.array(*(F.coalesce(F.col(c), F.lit(False)) for c in names))
    bits = lambda names: F.aggregate(flags(names), F.lit(0), lambda a, x: a * 2 + x.cast("int")) if names else F.lit(0)
    packed = rows.select("part", F.col("doc_id").cast("long").alias("doc_id"), "row", bits(filters[::-1]).alias("fails"), bits(marks[::-1]).alias("marks"))
    keys = ["part", "doc_id", "row"]
    dealt = packed.repartitionByRange(*keys).sortWithinPartitions(*keys)
    nested = pa.list_(pa.list_(pa.int32()))

    def work(batches):
        for batch in batches:
            parts = batch.column("part").to_pylist()
            edges = [0, *(i for i in range(1, len(parts)) if parts[i] != parts[i - 1]), len(parts)] if parts else []
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                own = batch.slice(a, b - a)
                fails, marked = (own.column(c).to_numpy(zero_copy_only=False) for c in ("fails", "marks"))
                lists = lambda v, k: pa.array([[np.flatnonzero(v >> i & 1).astype(np.int32) for i in range(k)]], nested)
                ids = own.column("doc_id")
                whole = pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids)
                yield pa.record_batch({"part": pa.array([parts[a]], pa.string()), "n": pa.array([b - a], pa.int64()), "ids": whole, "failing": lists(fails, len(filters)), "marked": lists(marked, len(marks))})

    return dealt.mapInArrow(work, LISTS)


def _summed(lists: DataFrame, filters: list[str], marks: list[str]) -> DataFrame:
    """``(part, filter, before, n, failing, gone, removed, marked)`` summed over the ranges of each part."""
    kinds = pa.schema([("part", pa.string()), ("filter", pa.int32()), ("before", pa.int32()), *((c, pa.int64()) for c in ("n", "failing", "gone", "removed")), ("marked", pa.list_(pa.int64()))])
    schema = "part string, filter int, before int, n long, failing long, gone long, removed long, marked array<long>"

    def work(batches):
        for batch in batches:
            for row in batch.to_pylist():
                failing, marked = ([np.asarray(x, np.int64) for x in row[c]] for c in ("failing", "marked"))
                found = [(row["part"], f, before, row["n"], len(failing[f]), gone, removed, own) for f, before, gone, removed, own in sizes(failing, marked)]
                yield pa.record_batch([pa.array(x, kind) for x, kind in zip(zip(*found, strict=True), kinds.types, strict=True)], kinds)

    ranges = lists.select("part", "n", "failing", "marked").mapInArrow(work, schema)
    total = [F.sum(c).alias(c) for c in ("n", "failing", "gone", "removed")]
    own = F.array(*(F.sum(F.get("marked", F.lit(i))) for i in range(len(marks)))) if marks else F.array().cast("array<long>")
    return ranges.groupBy("part", "filter", "before").agg(*total, own.alias("marked"))


def audit(lists: DataFrame, filters: list[str], marks: list[str]) -> DataFrame:
    """``(part, filter_order, step, kept, removed, redundant, unique_fails, <mark>_lost ..., shapley)`` from posting lists.

    One row for each part, order of all filters (their names joined) and step, zeros included. kept: rows that
    no filter up to this step fails; removed: those that this step's filter removes; redundant: those that fail
    it and were removed before; unique_fails: those that fail no other filter; ``<mark>_lost``: removed rows
    that bear the mark; shapley: its removed rows summed over all orders. At most seven filters.
    """
    k = len(filters)
    if not 1 <= k <= 7:
        raise ValueError("from one to seven filters")
    after = F.bit_count("before").cast("int")
    weight = F.element_at(F.array(*(F.lit(factorial(i) * factorial(k - 1 - i)) for i in range(k))), after + 1)
    own = Window.partitionBy("part", "filter")  # 2 ** (k - 1) rows each
    alone = after == k - 1
    table = _summed(lists, filters, marks).select(
        "part", "filter", "before",
        (F.col("n") - F.col("gone")).alias("kept"),
        "removed",
        (F.col("failing") - F.col("removed")).alias("redundant"),
        F.sum(F.when(alone, F.col("removed")).otherwise(0)).over(own).alias("unique_fails"),
        *(F.get("marked", F.lit(i)).alias(f"{m}_lost") for i, m in enumerate(marks)),
        F.sum(F.col("removed") * weight).over(own).alias("shapley"),
    )
    orders = [("".join(filters[f] for f in order), step + 1, f, sum(1 << g for g in order[:step])) for order in permutations(range(k)) for step, f in enumerate(order)]
    steps = lists.sparkSession.createDataFrame(orders, "filter_order string, step int, filter int, before int")
    return table.join(F.broadcast(steps), ["filter", "before"]).drop("filter", "before").select("part", "filter_order", "step", *(c for c in table.columns if c not in ("part", "filter", "before")))


def marked_by(labels: DataFrame, marks: dict[str, Column]) -> DataFrame:
    """One row for each doc_id of ``labels``: a mark holds if any of its rows has it."""
    return labels.filter("doc_id is not null").groupBy("doc_id").agg(*(F.max(F.coalesce(c, F.lit(False))).alias(m) for m, c in marks.items()))


def audit_texts(docs: DataFrame, labels: DataFrame, marks: dict[str, Column]) -> DataFrame:
    """The audit of the filters A to D of ``text_filters`` and E (the text of a smaller doc_id) over whole texts.

    ``labels(doc_id, ...)`` gives the marks. Every row of ``docs`` counts, also repeated ones and those
    without doc_id, which have no marks. Other columns are not read; an empty table gives no rows.
    """
    rows = text_filters(docs).withColumn("row", F.monotonically_increasing_id())
    known = marked_by(labels, marks).withColumnRenamed("doc_id", "_id")
    rows = cut(rows.join(known, F.col("doc_id") == F.col("_id"), "left").drop("_id"))
    filters = ["A", "B", "C", "D", "E"]
    return audit(posting_lists(first_copies(rows, "E"), filters, list(marks)), filters, list(marks))
