"""Corpus-wide line deduplication with DataFrame functions only.

Every text becomes, once, the array of its lines' key digests, which is written down. Exploded, the
distinct documents of every digest are counted, and only (document, position) of the lines to drop
travels back to the texts, which are put together again by position. Keys in many documents are
broadcast (``attach``), so a line that every document has makes no task large.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import attach, cut, folded

BLANKS = " \t\n\x0b\f\r"


def stripped(line: Column) -> Column:
    """The line without ASCII white space at its ends."""
    # btrim looks at every character of a line; most lines have nothing to strip.
    ends = reduce(lambda a, b: a | b, (f(line, F.lit(c)) for c in BLANKS for f in (F.startswith, F.endswith)))
    return F.when(ends, F.btrim(line, F.lit(BLANKS))).otherwise(line)


def line_keys(lines: Column, min_chars: int) -> Column:
    """A digest for each of an array of lines, null for lines that are too short to be compared."""
    whole = F.transform(lines, stripped)
    return F.transform(whole, lambda x: F.when(F.length(x) >= min_chars, F.unhex(F.md5(folded(x).cast("binary")))))


def drop_repeated_lines(docs: DataFrame, min_chars: int = 10, max_documents: int = 1) -> DataFrame:
    """``docs(doc_id, text, ...)`` with repeated lines dropped, and ``n_lines``, ``n_dropped``.

    A text is split at ``\\n``; a null or empty one is one empty line and its text becomes ''. A line
    whose key has at least ``min_chars`` code points and is found in more than ``max_documents``
    documents stays only in the smallest doc_id that holds it (there each time it occurs). Rows that
    share a doc_id are one document for the count. Rows with a null doc_id are not counted and lose
    nothing. Other columns pass through, also those named n_lines or n_dropped, which are replaced; an
    empty table stays empty.
    """
    text = F.coalesce("text", F.lit(""))
    split = F.split(text, "\n", -1)
    ident = F.xxhash64("text").alias("_text")
    keyed = cut(docs.filter("doc_id is not null").select("doc_id", ident, line_keys(split, min_chars).alias("keys")))
    lines = keyed.select("doc_id", "_text", F.posexplode("keys").alias("at", "key")).filter("key is not null")
    if max_documents == 1:  # two documents at least: the smallest and the largest differ
        found = lines.groupBy("key").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"), F.count("*").alias("n")).filter("first < last")
    else:
        found = lines.groupBy("key", "doc_id").agg(F.count("*").alias("k")).groupBy("key").agg(F.min("doc_id").alias("first"), F.count("*").alias("d"), F.sum("k").alias("n")).filter(F.col("d") > max_documents)
    repeated = cut(found.select("key", "first", "n"))
    total = repeated.agg(F.sum("n")).first()[0] or 0
    gone = attach(lines, repeated, ["key"], "n", total).filter("doc_id != first")
    gone = gone.groupBy("doc_id", "_text").agg(F.collect_set("at").alias("_gone"))
    rest = [c for c in docs.columns if c.lower() not in ("text", "n_lines", "n_dropped")]
    whole = docs.select(*rest, ident, text.alias("_whole"))
    whole = whole.join(gone.withColumnRenamed("doc_id", "_id"), (F.col("doc_id") == F.col("_id")) & whole["_text"].eqNullSafe(gone["_text"]), "left")
    parts = F.split("_whole", "\n", -1)
    out = whole.select(*rest, "_whole", parts.alias("_lines"), F.when(F.size("_gone") > 0, F.col("_gone")).alias("_gone"))
    stay = F.array_except(F.sequence(F.lit(0), F.size("_lines") - 1), "_gone")
    kept = F.when(F.col("_gone").isNull(), F.col("_whole")).otherwise(F.array_join(F.transform(stay, lambda i: F.get("_lines", i)), "\n"))
    out = out.select(*rest, kept.alias("text"), F.size("_lines").cast("long").alias("n_lines"), F.coalesce(F.size("_gone"), F.lit(0)).cast("long").alias("n_dropped"))
    named = [c for c in docs.columns if c.lower() not in ("n_lines", "n_dropped")]
    return out.select(*named, "n_lines", "n_dropped")
