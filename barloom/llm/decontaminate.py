"""Benchmark decontamination as a prefix-filtered set join, with DataFrame functions only.

The tokens of a text are its shingles of SHINGLE words. A window of ``span`` consecutive benchmark words
must be contained whole in a document, so of its shingles ordered by rarity in the corpus the first one
alone is a sufficient prefix. Documents are exploded to hashes of shingles and joined with the
prefixes; a match fixes where the window would have to start, must fit the bounds of the document, and
is verified word by word.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barloom.llm.common import cut, folded

#: Windows, and bytes of their words, that are broadcast at a time; a larger benchmark is joined in blocks.
WINDOWS_AT_ONCE, BYTES_AT_ONCE = 200_000, 64_000_000
#: Words of a shingle; a shorter item is one shingle.
SHINGLE = 3
SEPARATORS = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
#: Stands after the shingles of a document, for a row with its size.
END = 0


def words(text: Column) -> Column:
    """Words of the ``folded`` text: runs of letters and digits of ASCII and of bytes beyond it."""
    return F.array_remove(F.split(folded(F.coalesce(text, F.lit(""))), SEPARATORS), "")


def shingles(w: Column, n: int) -> Column:
    """The hash of the n words that begin at each word; of those that are left, near the end."""
    return F.transform(w, lambda x, i: F.xxhash64(x, *(F.get(w, i + k) for k in range(1, n))))


def benchmark_windows(benchmark: DataFrame, span: int) -> DataFrame:
    """(item_id, window): all windows of span words; a shorter item, if it has a word, is one window."""
    items = benchmark.filter("item_id is not null").select("item_id", words(F.col("text")).alias("w")).filter(F.size("w") > 0)
    last = F.greatest(F.lit(1), F.size("w") - span + 1)
    rows = items.select("item_id", "w", F.explode(F.sequence(F.lit(1), last)).alias("at"))
    return rows.select("item_id", F.slice("w", F.col("at"), F.lit(span)).alias("window")).distinct()


def find_contamination(docs: DataFrame, benchmark: DataFrame, span: int = 13, share: tuple[int, int] = (1, 20)) -> DataFrame:
    """One row for each row of ``docs(doc_id, text)``: ``(doc_id, n_words, n_hit, items, contaminated, ident)``.

    n_hit counts words inside any occurrence of a benchmark window, items is the sorted list of
    item_ids with a window that occurs, contaminated means n_hit > 0 and n_hit / n_words >= share, ident
    is ``xxhash64`` of the text, which tells rows of one doc_id apart.
    Null and empty texts have no words; items without words or id take no part. Rows that are equal
    in doc_id and text each have their row. Other columns are not read; empty tables are fine.
    """
    windows = cut(benchmark_windows(benchmark, span).withColumn("id", F.xxhash64("item_id", "window")))
    n, size, shortest = windows.agg(F.count("*"), F.sum(F.octet_length(F.array_join("window", " "))), F.min(F.size("window"))).first()
    blocks = max(1, -(-n // WINDOWS_AT_ONCE), -(-(size or 0) // BYTES_AT_ONCE))
    lengths = list(range(min(SHINGLE, shortest or SHINGLE), SHINGLE + 1))
    docs = docs.select("doc_id", F.xxhash64("text").alias("ident"), words(F.col("text")).alias("w"))
    found = None
    for i in range(blocks):
        block = windows.filter(F.pmod(F.xxhash64("id"), F.lit(blocks)) == i) if blocks > 1 else windows
        hits = _hits(docs, _prefixes(docs, block, lengths), lengths, with_size=i == 0)
        found = hits if found is None else found.unionByName(hits)
    # A word is hit once, however many windows cover it; a row without position holds the size.
    per_word = found.groupBy("doc_id", "ident", "at").agg(F.max("n_words").alias("n_words"), F.max("times").alias("times"), F.collect_set("item_id").alias("items"))
    n_hit, sizes = F.count("at"), F.max("n_words")
    per_doc = per_word.groupBy("doc_id", "ident").agg(sizes.alias("n_words"), n_hit.alias("n_hit"), F.max("times").alias("times"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"))
    hit = (F.col("n_hit") > 0) & (share[1] * F.col("n_hit") >= share[0] * F.col("n_words"))
    rows = per_doc.withColumn("row", F.explode(F.sequence(F.lit(1), F.col("times").cast("int"))))
    return rows.select("doc_id", "n_words", "n_hit", F.array_sort("items").alias("items"), hit.alias("contaminated"), "ident")


def _tokens(docs: DataFrame, lengths: list[int], *columns: str) -> DataFrame:
    """``docs(w)`` with ``tokens``: the hashes of the shingles of each length, one length after the other.

    To be exploded with ``explode_outer``: for ``explode`` Spark would test before that there are any, and
    that test would split the text again for every word.
    """
    return docs.select(*columns, F.concat(*(shingles(F.col("w"), n) for n in lengths)).alias("tokens"))


def _prefixes(docs: DataFrame, windows: DataFrame, lengths: list[int]) -> DataFrame:
    """(token, offset, item_id, window): each window under its rarest shingle, counted over all documents."""
    n = F.least(F.lit(SHINGLE), F.size("window"))
    own = windows.select("item_id", "id", "window", n.alias("n"), F.explode(F.sequence(F.lit(0), F.size("window") - n)).alias("offset"))
    own = own.withColumn("token", F.xxhash64(*(F.when(F.col("n") > k, F.get("window", F.col("offset") + k)) for k in range(SHINGLE))))
    vocabulary = own.select("token").distinct()
    seen = _tokens(docs, lengths).select(F.explode_outer("tokens").alias("token")).join(F.broadcast(vocabulary), "token").groupBy("token").agg(F.count("*").alias("seen"))
    # A token that no document has rules its window out. At most as many as the block's shingles: a few million numbers.
    often = own.join(F.broadcast(seen), "token", "left")
    least = F.min(F.struct(F.coalesce("seen", F.lit(0)).alias("seen"), "token", "offset"))
    first = often.groupBy("item_id", "id", "window").agg(least.alias("p")).filter("p.seen > 0")
    return cut(first.select(F.col("p.token").alias("token"), F.col("p.offset").alias("offset"), "item_id", "window"))


def _hits(docs: DataFrame, prefixes: DataFrame, lengths: list[int], with_size: bool) -> DataFrame:
    """(doc_id, ident, at, n_words, times, item_id): covered positions; at is null in a document's size row."""
    none = {"token": F.lit(END).cast("long"), "offset": F.lit(None).cast("int"), "item_id": F.lit(None).cast(prefixes.schema["item_id"].dataType), "window": F.lit(None).cast(T.ArrayType(T.StringType()))}
    mark = prefixes.sparkSession.range(1).select(*(v.alias(k) for k, v in none.items()))
    probe = F.broadcast(prefixes.unionByName(mark) if with_size else prefixes)
    tokens = _tokens(docs, lengths, "doc_id", "ident", "w").select("doc_id", "ident", "w", F.posexplode_outer(F.concat("tokens", F.array(none["token"]))).alias("pos", "token"))
    start = F.col("pos") % F.greatest(F.size("w"), F.lit(1)) - F.col("offset")
    fits = (start >= 0) & (start + F.size("window") <= F.size("w"))
    exact = F.when(fits, F.slice("w", start + 1, F.size("window")) == F.col("window"))
    at_end = F.col("window").isNull() & (F.col("pos") == len(lengths) * F.size("w"))
    rows = tokens.join(probe, "token").filter(at_end | exact)
    covered = F.when(F.col("window").isNotNull(), F.sequence(start, start + F.size("window") - 1))
    size = F.when(F.col("window").isNull(), F.size("w").cast("long"))
    rows = rows.select("doc_id", "ident", "item_id", size.alias("n_words"), F.explode_outer(covered).alias("at"))
    # Repeated rows meet here: their size rows are counted, their hits are the same.
    per_item = rows.groupBy("doc_id", "ident", "at", "item_id").agg(F.max("n_words").alias("n_words"), F.count("n_words").alias("times"))
    return per_item
