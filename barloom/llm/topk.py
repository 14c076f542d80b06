"""Exact top-k search by inner product with norm-bucketed retrieval.

Rows are grouped by length into buckets over the whole table. All queries first meet the longest bucket,
which gives each a score that its k-th answer reaches at least. A query then goes only to buckets whose
longest row could still reach it, and rows of a bucket that no query goes to are not moved at all.

Within a cell of a bucket the rows are sorted by length and cut into smaller buckets. For each query and
bucket the smallest score still needed, divided by both lengths, is a local cosine threshold: above 1
the bucket and all shorter ones are skipped; if it is high, a bound from the query's largest coordinates
rules rows out; otherwise rows are ruled out by length alone. What is left is verified by its whole
product.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.llm.common import cut, shuffle_partitions

#: Rows and queries of a cell, at most, and the numbers of buckets by length over the whole table.
ROWS, QUERIES = 50_000, 2_000
BUCKET_ROWS, MOST_BUCKETS = 4_000, 64
#: Fewer rows are not worth a cell of their own, as every cell returns k rows for each query.
CELL_ROWS = 2_000
BUCKET, COORDINATES, STEEP = 256, 8, 0.6
FOUND = "query_id long, vec_id long, score long"
#: Room for rounding when a product of lengths is compared with a score.
SLACK = 1e-9


def best(queries: np.ndarray, query_ids: np.ndarray, rows: np.ndarray, row_ids: np.ndarray, k: int, needed: np.ndarray | None = None) -> list[tuple[int, int, int]]:
    """(query_id, vec_id, score) of the k best rows for each query, of those that reach ``needed``; vectors of integers as float64, exact below 2**53."""
    norms = np.sqrt((rows * rows).sum(1))
    order = np.lexsort((row_ids, -norms))
    rows, row_ids, norms = rows[order], row_ids[order], norms[order]
    lengths = np.sqrt((queries * queries).sum(1))
    top = np.argsort(-np.abs(queries), axis=1, kind="stable")[:, :COORDINATES]
    heads = np.take_along_axis(queries, top, 1)
    tails = np.sqrt(np.maximum((queries * queries).sum(1) - (heads * heads).sum(1), 0))
    scores = [np.zeros(0) for _ in queries]
    found = [np.zeros(0, np.int64) for _ in queries]
    need = np.full(len(queries), -np.inf) if needed is None else needed.copy()
    going = np.ones(len(queries), bool)
    for at in range(0, len(rows), BUCKET):
        part, ids, size = rows[at : at + BUCKET], row_ids[at : at + BUCKET], norms[at : at + BUCKET]
        reach = lengths * size[0] * (1 + 1e-9) + 1e-6
        going &= need <= reach
        if not going.any():
            break
        cosine = np.where(reach > 0, need / np.maximum(reach, 1e-300), -1)
        flat = np.flatnonzero(going & ~(cosine >= STEEP))
        steep = np.flatnonzero(going & (cosine >= STEEP))
        product = part @ queries[flat].T
        for j, q in enumerate(flat):
            keep = lengths[q] * size * (1 + 1e-9) + 1e-6 >= need[q]
            _merge(q, product[keep, j], ids[keep], query_ids, scores, found, need, k)
        for q in steep:
            some = part[:, top[q]]
            rest = np.sqrt(np.maximum(size * size - (some * some).sum(1), 0))
            keep = some @ heads[q] + rest * tails[q] * (1 + 1e-9) + 1e-3 >= need[q]
            if keep.any():
                _merge(q, part[keep] @ queries[q], ids[keep], query_ids, scores, found, need, k)
    return [(int(i), int(v), int(s)) for i, vs, ss in zip(query_ids, found, scores, strict=True) for v, s in zip(vs, ss, strict=True)]


def _merge(q, new, ids, query_ids, scores, found, need, k):
    other = ids != query_ids[q]
    s, v = np.concatenate([scores[q], new[other]]), np.concatenate([found[q], ids[other]])
    order = np.lexsort((v, -s))[:k]
    scores[q], found[q] = s[order], v[order]
    if len(order) == k:
        need[q] = max(need[q], s[order[-1]])


def _cell(k: int):
    def search(table: pa.Table) -> pa.Table:
        ids, asks, needed = (table.column(c).to_numpy() for c in ("vec_id", "asks", "need"))
        lists = table.column("v").combine_chunks()
        values, ends = lists.values.to_numpy(), lists.offsets.to_numpy()
        dims, out = np.diff(ends), []
        for d in np.unique(dims[asks]) if asks.any() else []:
            rows, wanted = np.flatnonzero((dims == d) & ~asks), np.flatnonzero((dims == d) & asks)
            if d and len(rows):
                dense = lambda at: values[ends[at][:, None] + np.arange(d)]  # noqa: B023, E731
                out += best(dense(wanted), ids[wanted], dense(rows), ids[rows], k, needed[wanted])
        return pa.table({c: pa.array([x[i] for x in out], pa.int64()) for i, c in enumerate(("query_id", "vec_id", "score"))})

    return search


def _looked_up(values: dict[int, float], key: Column) -> Column:
    """A number for each bucket, as a column."""
    return F.get(F.array(*(F.lit(values.get(i, 0)) for i in range(max(values, default=0) + 1))), key)


def _search(rows: DataFrame, asked: DataFrame, k: int, sizes: dict[int, int], tasks: int) -> DataFrame:
    """FOUND of ``rows(bucket, vec_id, v)`` and ``asked(bucket, vec_id, v, need)`` that meet in a bucket.

    A bucket is a grid of cells of at most about ROWS rows and QUERIES queries.
    """
    going = {int(r[0]): int(r[1]) for r in asked.groupBy("bucket").count().collect()}
    across = {b: max(1, -(-sizes[b] // ROWS), min(tasks, sizes[b] // CELL_ROWS)) for b in going}
    down = {b: -(-n // QUERIES) for b, n in going.items()}
    if not going:
        return asked.sparkSession.createDataFrame([], FOUND)
    # The number of the row too, so that rows that share a vec_id, or are equal, share no cell by that.
    mine = lambda n: F.pmod(F.xxhash64("vec_id", F.monotonically_increasing_id()), _looked_up(n, F.col("bucket"))).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), _looked_up(n, F.col("bucket")) - 1))
    left = rows.filter(F.col("bucket").isin(*going)).select("bucket", mine(across).alias("i"), each(down).alias("j"), F.lit(False).alias("asks"), "vec_id", "v", F.lit(0.0).alias("need"))
    right = asked.select("bucket", each(across).alias("i"), mine(down).alias("j"), F.lit(True).alias("asks"), "vec_id", "v", "need")
    return left.unionByName(right).groupBy("bucket", "i", "j").applyInArrow(_cell(k), FOUND)


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, scale: int = 256) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: for each query the k rows of largest inner product.

    ``vectors`` and ``queries`` have ``vec_id`` and ``embedding``; components become floor(scale * x).
    A query's own vec_id is no answer to it; ties go to the smaller vec_id; fewer rows give fewer
    answers. Vectors that are null, empty, or hold a null or non-finite component, and rows with a null
    vec_id, take no part; vectors of unlike dimension don't meet. Equal rows of a query count once,
    query rows of one vec_id with different vectors ask together, and repeated rows of ``vectors`` each have their place. A ValueError says if products may reach 2**53,
    from where on they would not be exact. Other columns are not read.
    """
    real = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    whole = F.transform("embedding", lambda x: F.floor(scale * x.cast("double")).cast("double")).alias("v")
    length = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)).alias("length")
    rows = vectors.filter(F.col("vec_id").isNotNull() & real).select("vec_id", whole).select("vec_id", "v", length)
    asked = cut(queries.filter(F.col("vec_id").isNotNull() & real).select("vec_id", whole).dropDuplicates(["vec_id", "v"]).select("vec_id", "v", length))
    lengths = cut(rows.select("length"))
    n_rows, longest = lengths.agg(F.count("*"), F.max("length")).first()
    reach = asked.agg(F.max("length")).first()[0]
    if n_rows and reach is not None and longest * reach >= 2.0**53:
        raise ValueError("inner products may reach 2**53; take a smaller scale")
    buckets = min(MOST_BUCKETS, max(1, n_rows // BUCKET_ROWS))
    edges = sorted({*lengths.approxQuantile("length", [i / buckets for i in range(1, buckets)], 0.5 / buckets)}, reverse=True) if n_rows and buckets > 1 else []
    bucket = F.size(F.filter(F.array(*map(F.lit, edges)), lambda e: F.col("length") < e)) if edges else F.lit(0)
    rows = rows.withColumn("bucket", bucket)
    known = {int(r[0]): (int(r[1]), r[2]) for r in lengths.withColumn("bucket", bucket).groupBy("bucket").agg(F.count("*"), F.max("length")).collect()}
    if not known:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    sizes, first = {b: n for b, (n, _) in known.items()}, min(known)
    tasks = shuffle_partitions(vectors.sparkSession)
    ask = asked.withColumns({"bucket": F.lit(first), "need": F.lit(float("-inf"))})
    found = _best(_search(rows, ask, k, sizes, tasks), k)
    if len(known) > 1:
        found = cut(found)
        need = found.groupBy("query_id").agg(F.when(F.count("*") >= k, F.min("score")).alias("least"))
        need = asked.join(need, F.col("vec_id") == F.col("query_id"), "left").withColumn("need", F.coalesce(F.col("least").cast("double"), F.lit(float("-inf"))))
        others = F.array(*(F.struct(F.lit(b).alias("bucket"), F.lit(m).alias("most")) for b, (_, m) in sorted(known.items()) if b != first))
        can = F.filter(others, lambda o: o["most"] * F.col("length") * (1 + SLACK) + SLACK >= F.col("need"))
        ask = cut(need.select(F.explode(can).alias("o"), "vec_id", "v", "need").select(F.col("o.bucket").alias("bucket"), "vec_id", "v", "need"))
        found = _best(found.select("query_id", "vec_id", "score").unionAll(_search(rows, ask, k, sizes, -(-tasks // len(known)))), k)
    return found


def _best(found: DataFrame, k: int) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", place).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
