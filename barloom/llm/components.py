"""Connected components of a large graph: union-find in partitions, then pointer jumping.

Every edge lies with its larger end. A pass joins what meets in a partition and hangs each vertex on
the smallest that it met, so afterwards a vertex has at most one smaller neighbour per partition and
hubs are no hot keys. Passes repeat until every vertex has one parent and every parent is a root;
where parents have parents, edges that skip one level are added (hot parents are broadcast).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import attach, cut

#: Rows that a task of a graph step takes, and the fewest tasks.
TASK_ROWS, LEAST_TASKS = 25_000, 12
#: Keys that a task of ``meetings`` holds at a time, and rows that it hands on at a time.
TASK_KEYS, SENT = 500_000, 50_000


class Forest:
    """Union-find over any hashable vertices; the root is the smallest vertex of its tree."""

    def __init__(self):
        self.parent: dict = {}

    def find(self, x):
        parent = self.parent
        root = x
        while (up := parent.setdefault(root, root)) != root:
            root = up
        while parent[x] != root:
            parent[x], x = root, parent[x]
        return root

    def union(self, x, y) -> None:
        x, y = self.find(x), self.find(y)
        if x != y:
            self.parent[max(x, y)] = min(x, y)


def few(df: DataFrame, rows: int) -> DataFrame:
    """``df`` in partitions worth a Python worker, if ``rows`` is about what it has; never more than it has now."""
    return df.coalesce(max(LEAST_TASKS, rows // TASK_ROWS))


def _pass(edges: DataFrame, rows: int) -> DataFrame:
    def run(batches):
        forest = Forest()
        for batch in batches:
            for u, v in zip(batch.column("u").to_pylist(), batch.column("v").to_pylist(), strict=True):
                forest.union(u, v)
        pairs = [(x, r) for x in forest.parent if (r := forest.find(x)) != x]
        u, v = np.array(pairs, np.int64).reshape(-1, 2).T
        yield pa.RecordBatch.from_pydict({"u": pa.array(u), "v": pa.array(v)})

    return few(edges.repartition("u"), rows).mapInArrow(run, "u long, v long")


def components(edges: DataFrame, rows: int) -> DataFrame:
    """``edges(a, b)`` of bigint vertices, undirected -> ``(node, component)``, component being the smallest vertex reached.

    Loops and repeated edges are ignored, as are edges with a null end. Vertices without an edge to
    another vertex do not appear; an empty table gives an empty result. ``rows``, about how many edges
    there are, only sets how many tasks work on them.
    """
    start = edges.filter("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    now = cut(_pass(start, rows))
    while True:
        ends = now.select(F.col("u").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionAll(now.select(F.col("v").alias("x"), F.lit(0).alias("up"), F.lit(1).alias("down")))
        ends = ends.groupBy("x").agg(F.sum("up").alias("up"), F.sum("down").alias("down"))
        split, deep, size = ends.agg(F.count_if(F.col("up") > 1), F.count_if((F.col("up") > 0) & (F.col("down") > 0)), F.sum("up")).first()
        if not split and not deep:
            break
        if deep:
            parents = now.groupBy("v").agg(F.count("*").alias("n"))
            up = now.groupBy("u").agg(F.min("v").alias("w"))
            deeper = cut(parents.join(up, F.col("v") == F.col("u")).select("v", "w", "n"))
            jumps = attach(now, deeper, ["v"], "n", size).select("u", F.col("w").alias("v"))
            now = now.unionAll(jumps)
        now = cut(_pass(now, rows))
    return ends.filter("up = 0").select(F.col("x").alias("node"), F.col("x").alias("component")).unionAll(now.select(F.col("u").alias("node"), F.col("v").alias("component")))


def meetings(rows: DataFrame, size: int) -> DataFrame:
    """Edges (a, b) that connect all nodes of ``rows(node, keys)`` which share a key; node bigint, keys an array of bigint.

    Each partition first connects its own nodes, and sends one node for each key, so a key that very
    many nodes share costs each partition one row, and no pairs of nodes are made. ``size``, about how
    many keys there are, only sets how many tasks work on them; a task holds 16 bytes for each key.
    """

    def run(batches):
        nodes, keys = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for batch in batches:
            held = batch.column("keys")
            own = batch.column("node").to_numpy()
            ends = held.offsets.to_numpy() if len(held) else np.zeros(1, np.int32)
            keys.append(held.values.to_numpy()[ends[0] : ends[-1]])
            nodes.append(np.repeat(own, np.diff(ends)))
        key = np.concatenate(keys)
        names, node = np.unique(np.concatenate(nodes), return_inverse=True)
        del nodes, keys
        order = np.argsort(key, kind="stable")
        node, key = node[order], key[order]
        first = np.ones(len(key), bool)
        first[1:] = key[1:] != key[:-1]
        low, high = np.minimum(node[1:], node[:-1]), np.maximum(node[1:], node[:-1])
        pairs = np.unique((low * len(names) + high)[~first[1:] & (low != high)])
        forest = Forest()
        for x, y in zip((pairs // len(names)).tolist(), (pairs % len(names)).tolist(), strict=True):
            forest.union(x, y)
        root = np.arange(len(names))
        for x in forest.parent:
            root[x] = forest.find(x)
        joined = np.flatnonzero(root != np.arange(len(names)))
        if len(joined):
            yield pa.RecordBatch.from_pydict({"key": pa.nulls(len(joined), pa.int64()), "a": pa.array(names[joined]), "b": pa.array(names[root[joined]])})
        key, node = key[first], names[root[node[first]]]
        for i in range(0, len(key), SENT):
            part = slice(i, i + SENT)
            yield pa.RecordBatch.from_pydict({"key": pa.array(key[part]), "a": pa.array(node[part]), "b": pa.nulls(len(key[part]), pa.int64())})

    met = cut(rows.filter("keys IS NOT NULL").coalesce(max(LEAST_TASKS, size // TASK_KEYS)).mapInArrow(run, "key long, a long, b long"))
    across = met.filter("key IS NOT NULL").groupBy("key").agg(F.collect_set("a").alias("a")).filter(F.size("a") > 1)
    across = across.select(F.explode("a").alias("a"), F.array_min("a").alias("b")).filter("a != b")
    return met.filter("key IS NULL").select("a", "b").unionAll(across)
