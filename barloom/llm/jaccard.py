"""Near-duplicate documents: an exact n-gram Jaccard join by signature trees.

1. Every text becomes its set of distinct shingles (64-bit hashes of k words, keyed anew in each run).
2. All shingles of the corpus are counted (``exchange``). A text with a partner at similarity t shares
   at least ``t`` of its own shingles with it, so texts with too many shingles of their own leave here.
3. Equal sets form classes, of which one representative goes on.
4. Prefix filter: ordered from rare to frequent, two sets with similarity t share one of their first
   ``n - ceil(t n) + 1`` shingles. Sharing one puts representatives into one family; no pairs are made.
5. Each family is joined by signature trees (``Tree`` for classes alone, ``Pairs`` with links): nodes
   hold the OR of their members' token bitmaps and the range of sizes; two nodes are opened together only
   while the largest overlap that their bitmaps and sizes allow can reach the threshold. Pairs that a tree
   cannot rule out are verified on the sets. For classes alone, members already connected are not
   compared again.
6. For classes alone, a family too large for a task is dealt in blocks: first every block against one
   pivot block, then only what is not in the family's largest component against everything. So a large
   group of copies costs about twice its size.
7. With links, every pair of leaves that the trees cannot rule out is verified and counted;
   a family too large for a task meets as pairs of blocks. That is of order n squared for n different
   sets that are near each other, but no row is made for a pair.
"""

from __future__ import annotations

import hashlib
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import attach, cut
from barloom.llm.components import components, few, meetings
from barloom.llm.exchange import MANY, SENT, UNIT_BYTES, Layout, answered, answers, deal, distinct, gathered, pack, repeated
from barloom.llm.words import Words, shingle_sets, slices, split_words, utf8

#: Sets in a block of a family, and set bytes that a task joins.
BLOCK, TASK_BYTES = 40, 4_000_000
FANOUT = 4
#: With links: sets in a block of a family, set bytes in it, and sets below a node.
PAIR_BLOCK, PAIR_BYTES, NODE = 1_500, 4_000_000, 16
#: Nodes below a node of a tree of pairs, and pairs of nodes whose bitmaps are compared at once.
SPAN, PAIRS_AT_ONCE = 4, 256


def needed(t: Fraction, a, b):
    """The least overlap at which sets of sizes a and b reach similarity t."""
    return -((-t.numerator * (a + b)) // (t.numerator + t.denominator))


class Tree:
    """Sets in a signature tree: level 0 holds the sets, each further level a node for FANOUT nodes below."""

    def __init__(self, sets: list[np.ndarray]):
        self.sets = sets
        sizes = np.array([len(s) for s in sets])
        bits = max(256, 1 << int(4 * sizes.max() - 1).bit_length()) if len(sets) else 256
        flags = np.zeros((len(sets), min(bits, 65_536)), bool)
        for i, s in enumerate(sets):
            flags[i, (s % np.uint64(flags.shape[1])).astype(np.int64)] = True
        #: Shingles of a set that fall on a bit which another of its shingles has.
        excess = sizes - flags.sum(1)
        level = np.packbits(flags, axis=1).view(np.uint64)
        self.levels = [(level, sizes, sizes, excess)]
        while len(self.levels[-1][0]) > 1:
            maps, low, high, more = self.levels[-1]
            at = np.arange(0, len(maps), FANOUT)
            self.levels.append((np.bitwise_or.reduceat(maps, at), np.minimum.reduceat(low, at), np.maximum.reduceat(high, at), np.maximum.reduceat(more, at)))

    def links(self, t: Fraction, comp: np.ndarray) -> np.ndarray:
        """Joins the tree with itself; comp holds known components and gets the new ones."""
        top = len(self.levels) - 1
        stack = [(top, 0, 0)] if len(self.sets) > 1 else []
        while stack:
            level, a, b = stack.pop()
            maps, low, high, more = self.levels[level]
            if a != b:
                most = min(int(np.bitwise_count(maps[a] & maps[b]).sum()) + min(more[a], more[b]), high[a], high[b])
                if most < needed(t, int(low[a]), int(low[b])) or t * int(low[a]) > int(high[b]) or t * int(low[b]) > int(high[a]):
                    continue
            if level == 0:
                if comp[a] != comp[b] and self.alike(t, a, b):
                    comp[comp == max(comp[a], comp[b])] = min(comp[a], comp[b])
                continue
            span = FANOUT**level
            if a == b and len(set(comp[a * span : (a + 1) * span].tolist())) == 1:
                continue
            if a != b and len({*comp[a * span : (a + 1) * span].tolist(), *comp[b * span : (b + 1) * span].tolist()}) == 1:
                continue
            below = len(self.levels[level - 1][0])
            left = range(a * FANOUT, min((a + 1) * FANOUT, below))
            right = range(b * FANOUT, min((b + 1) * FANOUT, below))
            stack += [(level - 1, i, j) for i in left for j in right if i < j or (i == j and level > 1)]
        return comp

    def alike(self, t: Fraction, a: int, b: int) -> bool:
        x, y = self.sets[a], self.sets[b]
        if len(x) > len(y):
            x, y = y, x
        at = np.searchsorted(y, x)
        at[at == len(y)] = 0
        return int((y[at] == x).sum()) >= needed(t, len(x), len(y))


class Pairs:
    """All links between sets in a signature tree: pairs of leaves that dual traversal leaves are verified by their whole overlap.

    A leaf holds NODE sets, and each further level a node for SPAN nodes below, with the OR of their bitmaps,
    the range of their sizes, and the most shingles of a set that fall on a bit which another of its shingles has.

    Sets are compared by what sets them apart from ``base``, the shingles that most of them have: with a
    set's shingles outside and its gaps inside the base as d, the overlap of x and y is
    |base| - gaps(x) - gaps(y) + |d(x) & d(y)|. Near copies have a small d.
    """

    def __init__(self, sets: list[np.ndarray]):
        self.sizes = np.array([len(x) for x in sets])
        own = np.repeat(np.arange(len(sets)), self.sizes)
        every = np.concatenate(sets)
        values, ids = np.unique(every, return_inverse=True)
        times = np.bincount(ids)
        base = np.flatnonzero(2 * times > len(sets))
        self.n_base, self.n_values = len(base), len(values)
        place = np.full(len(values), -1)
        place[base] = np.arange(len(base))
        inside = place[ids] >= 0
        gap = np.ones((len(sets), len(base)), bool)
        gap[own[inside], place[ids[inside]]] = False
        self.gaps = gap.sum(1)
        at, which = np.nonzero(gap)
        outside = ~inside & (times[ids] > 1)
        owner, d = np.concatenate([own[outside], at]), np.concatenate([ids[outside], base[which]])
        order = np.argsort(owner, kind="stable")
        self.d = d[order]
        self.starts = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=len(sets)))])
        # So wide that the union of many sets leaves most bits of a node free.
        bits = min(65_536, max(256, 1 << int(32 * self.sizes.max() - 1).bit_length()))
        bit = (every % np.uint64(bits)).astype(np.int64)
        at = np.arange(0, len(sets), NODE)
        maps = np.zeros((len(at), bits), bool)
        maps[own // NODE, bit] = True
        distinct_bits = np.bincount(np.unique(own * bits + bit) // bits, minlength=len(sets))
        self.levels = [(np.packbits(maps, axis=1).view(np.uint64), np.minimum.reduceat(self.sizes, at), np.maximum.reduceat(self.sizes, at), np.maximum.reduceat(self.sizes - distinct_bits, at))]
        while len(self.levels[-1][0]) > 1:
            maps, low, high, more = self.levels[-1]
            at = np.arange(0, len(maps), SPAN)
            self.levels.append((np.bitwise_or.reduceat(maps, at), np.minimum.reduceat(low, at), np.maximum.reduceat(high, at), np.maximum.reduceat(more, at)))
        #: Pairs of nodes that were looked at, on all levels.
        self.opened = 0

    def meet(self, t: Fraction, level: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Which of these pairs of nodes of a level can hold sets that are linked."""
        maps, low, high, more = self.levels[level]
        n, m = t.numerator, t.denominator
        ok = (n * low[a] <= m * high[b]) & (n * low[b] <= m * high[a])
        some = np.flatnonzero(ok & (a != b))
        for at in range(0, len(some), PAIRS_AT_ONCE):
            x, y = a[some[at : at + PAIRS_AT_ONCE]], b[some[at : at + PAIRS_AT_ONCE]]
            most = np.bitwise_count(maps[x] & maps[y]).sum(1, dtype=np.int64) + np.minimum(more[x], more[y])
            ok[some[at : at + PAIRS_AT_ONCE]] = np.minimum(most, np.minimum(high[x], high[y])) >= needed(t, low[x], low[y])
        self.opened += len(a)
        return ok

    def leaves(self, t: Fraction, split: int | None) -> list[np.ndarray]:
        """For each leaf the leaves from it on that may hold partners, by traversing the tree against itself from the root.

        With ``split`` only pairs of nodes that hold sets of both sides are opened.
        """
        a = b = np.zeros(1, np.int64)
        for level in reversed(range(len(self.levels))):
            if level < len(self.levels) - 1:
                below = len(self.levels[level][0])
                i, j = np.divmod(np.arange(SPAN * SPAN), SPAN)
                a, b = ((x[:, None] * SPAN + y).ravel() for x, y in ((a, i), (b, j)))
                inside = (a <= b) & (b < below)
                a, b = a[inside], b[inside]
            if split is not None:
                width = NODE * SPAN**level
                both = (a * width < split) & ((b + 1) * width > split)
                a, b = a[both], b[both]
            ok = self.meet(t, level, a, b)
            a, b = a[ok], b[ok]
        order = np.lexsort((b, a))
        edges = np.searchsorted(a[order], np.arange(len(self.levels[0][0]) + 1))
        return [b[order][x:y] for x, y in zip(edges[:-1], edges[1:], strict=True)]

    def links(self, t: Fraction, split: int | None = None):
        """(a, partners) for each set a that has partners after it, or from ``split`` on for those before ``split``."""
        flag = np.zeros(self.n_values, np.int32)
        near = self.leaves(t, split)
        for a in range(len(self.sizes) if split is None else split):
            if a % NODE == 0:
                ok = np.zeros(len(self.levels[0][0]), bool)
                ok[near[a // NODE]] = True
                ok = np.repeat(ok, NODE)[: len(self.sizes)]
            first = a + 1 if split is None else split
            turns = np.flatnonzero(np.diff(np.concatenate([[False], ok[first:], [False]]).astype(np.int8))) + first
            mine = self.d[self.starts[a] : self.starts[a + 1]]
            flag[mine] = 1
            found = []
            for u, v in zip(turns[::2], turns[1::2], strict=True):
                sums = np.concatenate([[0], np.cumsum(flag[self.d[self.starts[u] : self.starts[v]]])])
                ends = self.starts[u : v + 1] - self.starts[u]
                overlap = self.n_base - self.gaps[a] - self.gaps[u:v] + sums[ends[1:]] - sums[ends[:-1]]
                found.append(u + np.flatnonzero(overlap >= needed(t, self.sizes[a], self.sizes[u:v])))
            flag[mine] = 0
            partners = np.concatenate([np.zeros(0, np.int64), *found])
            if len(partners):
                yield a, partners


#: Links found: a and b are connected, or n documents are linked with a.
FOUND = "a long, b long, n long"


def _found(a, b, n) -> pa.Table:
    return pa.table({k: pa.array([y for x in v for y in x], pa.int64()) for k, v in (("a", a), ("b", b), ("n", n))})


def _by_task(task: np.ndarray, *order: np.ndarray):
    """The rows of each task, ordered."""
    order = np.lexsort((*order, task))
    edges = np.flatnonzero(np.concatenate([[True], task[order][1:] != task[order][:-1], [True]]))
    return [order[i:j] for i, j in zip(edges[:-1], edges[1:], strict=True)]


def _joined(t: Fraction):
    def join(table: pa.Table) -> pa.Table:
        """Rows (task, node, label, shingles) -> links (a, b) that connect what each task found connected."""
        task, node, label = (table.column(c).to_numpy() for c in ("task", "node", "label"))
        packed = table.column("shingles").to_pylist()
        sizes = np.array([len(s) for s in packed])
        a, b, n = [], [], []
        for rows in _by_task(task, node, sizes):
            rows = rows[np.unique(node[rows], return_index=True)[1]]
            rows = rows[np.argsort(sizes[rows], kind="stable")]
            known = label[rows].copy()
            found = Tree([np.frombuffer(packed[r], np.uint64) for r in rows]).links(t, known.copy())
            new = found != known
            a.append(known[new].tolist())
            b.append(found[new].tolist())
            n.append([None] * int(new.sum()))
        return _found(a, b, n)

    return join


def _counted(t: Fraction):
    def join(table: pa.Table) -> pa.Table:
        """Rows (task, side, node, copies, shingles) -> what is connected, and each node's number of linked documents.

        Side -1: every pair of the task; sides 0 and 1: every pair across.
        """
        task, side, node, copies = (table.column(c).to_numpy() for c in ("task", "side", "node", "copies"))
        packed = table.column("shingles").to_pylist()
        sizes = np.array([len(s) for s in packed])
        a, b, n = [], [], []
        for rows in _by_task(task, sizes, side):
            split = None if side[rows[0]] < 0 else int((side[rows] == 0).sum())
            if len(rows) < 2 or split in (0, len(rows)):
                continue
            comp, weight, linked = np.arange(len(rows)), copies[rows], np.zeros(len(rows), np.int64)
            for x, partners in Pairs([np.frombuffer(packed[r], np.uint64) for r in rows]).links(t, split):
                linked[x] += weight[partners].sum()
                linked[partners] += weight[x]
                met = np.unique(np.append(comp[partners], comp[x]))
                if len(met) > 1:
                    comp[np.isin(comp, met)] = met[0]
            some, joined = np.flatnonzero(linked), np.flatnonzero(comp != np.arange(len(rows)))
            a += [node[rows[joined]].tolist(), node[rows[some]].tolist()]
            b += [node[rows[comp[joined]]].tolist(), [None] * len(some)]
            n += [[None] * len(joined), linked[some].tolist()]
        return _found(a, b, n)

    return join


def _join_tasks(rows: DataFrame, t: Fraction, size: int, join=_joined) -> DataFrame:
    """rows (task, node, ..., shingles), dealt to buckets of tasks."""
    buckets = max(64, -(-size // TASK_BYTES))
    dealt = rows.select(F.pmod(F.xxhash64("task"), F.lit(buckets)).alias("bucket"), F.xxhash64("task").alias("task"), *(c for c in rows.columns if c != "task"))
    return dealt.groupBy("bucket").applyInArrow(join(t), FOUND)


def _every_pair(rows: DataFrame, t: Fraction) -> DataFrame:
    """FOUND of families (node, component, members, bytes, copies, shingles), each pair of sets in one task."""
    blocks = F.greatest(F.ceil(F.col("members") / PAIR_BLOCK), F.ceil(F.col("bytes") / PAIR_BYTES)).cast("int")
    rows = rows.withColumn("blocks", blocks)
    rows = rows.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    size = rows.agg(F.sum(F.octet_length("shingles") * F.col("blocks"))).first()[0] or 0
    met = rows.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    task = F.struct("component", F.least("block", "with").alias("x"), F.greatest("block", "with").alias("y"))
    side = F.when(F.col("block") == F.col("with"), -1).when(F.col("block") < F.col("with"), 0).otherwise(1)
    return _join_tasks(met.select(task.alias("task"), side.alias("side"), "node", "copies", "shingles"), t, size, _counted)


def _sets(table: pa.Table, k: int, key: int) -> tuple[Words, np.ndarray, np.ndarray]:
    words = split_words(*utf8(table.column("text")), fold=True, key=key)
    return (words, *shingle_sets(words, k))


PROFILE = "doc_id long, n_shingles long, mark binary, rare array<long>, shingles binary, times long"


def profile(docs: DataFrame, k: int, t: Fraction) -> tuple[DataFrame, bool]:
    """(doc_id, n_shingles, mark, rare, shingles, times), and whether any row stands for several; mark, rare and shingles only where a partner is possible.

    mark: 128 bits of the whole set; rare: the shingles by which partners are found; times: how many equal rows this is. Rows without a doc_id
    link with nothing and are not dealt, so any number of them, equal or not, make no task large.
    """
    rows, many = gathered(docs.filter("doc_id is not null"))
    dealt, layout = deal(rows, "text", "times")
    num, den = t.numerator, t.denominator

    def send(table: pa.Table) -> pa.Table:
        keys, times = distinct(_sets(table, k, layout.key)[1], layout)
        return pack(table.column("unit")[0].as_py(), keys, np.minimum(times, MANY), layout)

    def judge(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return _profiles([], [], [], [], [], [])
        _, sets, ends = _sets(left, k, layout.key)
        keys, _ = distinct(sets, layout)
        df = answered(right, 0, len(keys))
        texts = df[np.searchsorted(keys, sets >> np.uint64(32 - layout.bits))]
        n, marks, rare, packed = np.diff(ends), [], [], []
        for a, b in zip(ends[:-1], ends[1:], strict=True):
            own, often = sets[a:b], texts[a:b]
            prefix = len(own) - -(-num * len(own) // den) + 1
            alone = int((often == 1).sum())
            if a == b or alone >= prefix:
                marks.append(None), rare.append(None), packed.append(None)
                continue
            order = np.lexsort((own, often))[alone:prefix]
            marks.append(hashlib.blake2b(own.tobytes(), digest_size=16).digest())
            rare.append(own[order].view(np.int64))
            packed.append(own.tobytes())
        return _profiles(left.column("doc_id"), n, marks, rare, packed, left.column("times"))

    def alone(batches):
        for batch in batches:
            for part in slices(batch, "text", UNIT_BYTES):
                n, none = np.diff(_sets(pa.Table.from_batches([part]), k, layout.key)[2]), [None] * part.num_rows
                yield from _profiles(none, n, none, none, none, [1] * part.num_rows).to_batches()

    unknown = docs.filter("doc_id is null").select(F.col("text").cast("string").alias("text")).mapInArrow(alone, PROFILE)
    sent = dealt.groupBy("unit").applyInArrow(send, SENT)
    count = lambda values, starts: np.minimum(np.add.reduceat(values, starts), MANY)
    back = answers(0, sent, count)
    return dealt.groupBy("unit").cogroup(back.groupBy("unit")).applyInArrow(judge, PROFILE).unionAll(unknown), many


def _profiles(ids, n, marks, rare, packed, times) -> pa.Table:
    ids, times = (x if isinstance(x, pa.ChunkedArray) else pa.array(x, pa.int64()) for x in (ids, times))
    return pa.table({"doc_id": ids, "n_shingles": pa.array(n, pa.int64()), "mark": pa.array(marks, pa.binary()), "rare": pa.array(rare, pa.list_(pa.int64())), "shingles": pa.array(packed, pa.binary()), "times": times})


def near_duplicates(docs: DataFrame, k: int = 5, threshold: Fraction = Fraction(4, 5), links: bool = False) -> DataFrame:
    """``(doc_id, n_shingles, component_id)``: one row for each row of ``docs(doc_id, text)``.

    Two documents are linked if the Jaccard similarity of their shingle sets is at least ``threshold``;
    component_id is the smallest doc_id that links reach. Words are separated by ASCII white space and
    compared with A-Z as a-z. Null and empty texts have no shingles and no links. Rows that share a
    doc_id are one document in the graph. A null doc_id has its size and no component. Other columns
    of ``docs`` are not read; an empty table gives an empty result.

    With ``links`` every pair is verified, and ``n_links`` is how many other documents a row's text is
    linked with; a document with several different shingle sets counts once for each. Null where the
    doc_id is null.
    """
    t = Fraction(threshold)
    every, many = profile(docs, k, t)
    every = cut(every)
    known = "mark is not null and doc_id is not null"
    alive = every.filter(known).select("doc_id", "mark", "rare", "shingles")
    total = every.count()
    # Ids of classes are fixed by the checkpoint; a doc_id would not do, as it can have several sets.
    classes = alive.groupBy("mark").agg(F.min("doc_id").alias("first"), F.count("*").alias("n"), F.countDistinct("doc_id").alias("copies"))
    classes = cut(few(classes, total).withColumn("node", F.monotonically_increasing_id()))
    member = attach(alive.select("doc_id", "mark"), classes, ["mark"], "n", total)
    mark = F.when(F.col("mark").isNotNull(), F.xxhash64("mark"))
    texts = every.filter("doc_id is not null").groupBy("doc_id").agg(F.min(mark).alias("least"), F.max(mark).alias("most"), F.count(mark).alias("held"), F.count("*").alias("all"))
    versions = texts.filter("held > 0 AND (least != most OR held < all)").limit(1).count() > 0
    first = member.filter("doc_id = first").select("doc_id", "mark", "node", "copies").dropDuplicates(["doc_id", "mark"])
    reps = cut(alive.join(first, ["doc_id", "mark"]).dropDuplicates(["doc_id", "mark"]).select("node", "rare", "shingles", "copies"))
    n_keys = reps.agg(F.sum(F.size("rare"))).first()[0] or 0
    family = components(meetings(reps.select("node", F.col("rare").alias("keys")), n_keys), total)
    held = family.join(reps.select("node", "shingles", "copies"), "node")
    sized = held.groupBy("component").agg(F.count("*").alias("n"), F.count("*").alias("members"), F.sum(F.octet_length("shingles")).alias("bytes"))
    placed = cut(few(attach(held, sized, ["component"], "n", total), total))
    if links:
        found = cut(few(_every_pair(placed, t), total))
        labels = components(found.filter("n is null"), total)
        linked = found.filter("n is not null").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("linked"))
    else:
        labels = _labels(placed, t, total)
    if versions:  # the classes of a doc_id with several texts are connected by it
        labels = components(labels.select(F.col("node").alias("a"), F.col("component").alias("b")).unionAll(meetings(member.select("node", F.array("doc_id").alias("keys")), total)), total)
    labels = cut(few(labels, total))
    named = labels.join(classes.select("node", "first"), "node")
    least = named.groupBy("component").agg(F.min("first").alias("label"), F.count("*").alias("n"))
    label = attach(named.select("node", "component"), least, ["component"], "n", total).select("node", "label")
    classes = classes.join(label, "node", "left").withColumn("component_id", F.coalesce("label", "first"))
    if links:
        classes = classes.join(linked, "node", "left").withColumn("n_links", F.col("copies") - 1 + F.coalesce("linked", F.lit(0)))
    new = ["component_id", *(["n_links"] if links else [])]
    rest = every.filter(f"NOT ({known})").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"), F.when(F.col("doc_id").isNotNull(), F.lit(0).cast("long")).alias("n_links"), "times")
    rows = attach(every.filter(known).select("doc_id", "n_shingles", "mark", "times"), classes.select("mark", "n", *new), ["mark"], "n", total)
    if versions:  # rows without partners follow the rows that share their doc_id
        own = rows.groupBy(F.col("doc_id").alias("_id")).agg(F.min("component_id").alias("reached"))
        same = rest.filter("doc_id is not null").join(own, F.col("doc_id") == F.col("_id"), "left")
        same = same.select("doc_id", "n_shingles", F.coalesce("reached", "component_id").alias("component_id"), "n_links", "times")
        rest = rest.filter("doc_id is null").unionAll(same)
    names = ["doc_id", "n_shingles", *new, "times"]
    return repeated(rows.select(*names).unionAll(rest.select(*names)), many)


def _labels(placed: DataFrame, t: Fraction, total: int) -> DataFrame:
    """(node, component) of families (node, component, members, shingles), without comparing what is already connected."""
    size = placed.agg(F.sum(F.octet_length("shingles"))).first()[0] or 0
    fits = F.col("members") <= 2 * BLOCK
    links = _join_tasks(placed.filter(fits).select(F.struct("component").alias("task"), "node", F.col("node").alias("label"), "shingles"), t, size).select("a", "b")
    large = placed.filter(~fits).withColumn("blocks", F.ceil(F.col("members") / BLOCK).cast("int"))
    if large.limit(1).count():
        links = links.unionAll(_large(large, t, 2 * size, total).select("a", "b"))
    return components(links, total)


def _large(rows: DataFrame, t: Fraction, size: int, total: int) -> DataFrame:
    """Links of families (node, component, members, blocks, shingles) that are too large for one task."""
    block = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    rows = rows.withColumn("block", block)
    others = F.when(F.col("block") == 0, F.sequence(F.lit(1), F.col("blocks") - 1)).otherwise(F.array("block"))
    pivots = rows.select("component", F.explode(others).alias("with"), "node", "shingles")
    pivots = pivots.select(F.struct("component", "with").alias("task"), "node", F.col("node").alias("label"), "shingles")
    links = cut(few(_join_tasks(pivots, t, size), total))
    label = components(links, total).withColumnRenamed("component", "l")
    rows = rows.join(label, "node", "left").withColumn("label", F.coalesce("l", "node"))
    sizes = rows.groupBy("component", "label").agg(F.count("*").alias("k"))
    most = sizes.groupBy("component").agg(F.max_by("label", F.struct("k", "label")).alias("main"), F.sum("k").alias("n"), F.sum("k").alias("all"), F.max("k").alias("k"))
    rows = cut(attach(rows.drop("copies").select("node", "component", "block", "blocks", "label", "shingles"), most.filter("k < n"), ["component"], "n", total))
    if not rows.filter("label != main").limit(1).count():
        return links
    rest = rows.filter("label != main").withColumn("rows", F.col("all") - F.col("k"))
    deal_to = F.greatest(F.lit(1), F.ceil(F.col("rows") / BLOCK)).cast("int")
    spread = F.pmod(F.xxhash64("node", F.lit(1)), deal_to).cast("int")
    tasks = rest.select("node", "component", "label", "shingles", spread.alias("s"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("b"))
    against = rows.withColumn("rows", F.col("all") - F.col("k")).select("node", "component", "label", "shingles", F.explode(F.sequence(F.lit(0), deal_to - 1)).alias("s"), F.col("block").alias("b"))
    second = tasks.unionByName(against).select(F.struct("component", "b", "s").alias("task"), "node", "label", "shingles")
    return links.unionAll(_join_tasks(second, t, size))
