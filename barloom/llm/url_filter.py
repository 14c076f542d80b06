"""Allow and block rules for URLs, looked up in sorted arrays of digests that workers map into memory.

A list is sorted by the 64-bit xxhash of its keys and cut in blocks. Each block is one file in the shared
folder: digests, then the ends, actions and bytes of the full keys. Spark hands the files to every
executor, where all workers map the same pages. A URL asks for the keys that could fit it (the ends of its
host, each with as much of its path as some rule has; the words of its host). Their digests are looked up by
binary search, a batch at a time, and an entry counts only if its full key is equal.
"""

from __future__ import annotations

from functools import lru_cache, reduce
from uuid import uuid4

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.llm.common import shared_folder

#: Keys of one block; with keys of 100 bytes, the driver holds about 500 MB while it writes one.
BLOCK_KEYS = 2_000_000
#: Before a word of a host; no host and so no rule begins with it.
WORD = "#"
ACTIONS = ("allow", "block")
# Words of hosts that are blocked where no rule fits.
BLOCKED_WORDS = ("ads", "adult", "bet", "bets", "betting", "casino", "escort", "gambling", "pills", "poker", "porn", "sex", "slots", "spam", "viagra", "warez", "xxx")


def lower_ascii(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; path: then up to ``?``, ``#`` or the end."""
    rest = F.when(F.locate("://", url) > 0, F.substr(url, F.locate("://", url) + 3)).otherwise(F.lit(""))
    part = lambda i: F.regexp_extract(F.coalesce(rest, F.lit("")), "^([^/?#]*)([^?#]*)", i)
    return lower_ascii(part(1)), part(2)


def split_rules(rules: DataFrame) -> DataFrame:
    """``rules(pattern, action)`` as ``(key, action, labels, length)``; what has no host is left out.

    A pattern is a host and, from its first ``/`` on, the start of a path. A pattern given both ways blocks.
    """
    host, path = lower_ascii(F.substring_index("pattern", "/", 1)), F.regexp_extract("pattern", "(?s)^[^/]*(/.*)$", 1)
    rows = rules.select(host.alias("host"), path.alias("path"), "action").filter("host != ''")
    return rows.groupBy(F.concat("host", "path").alias("key"), F.size(F.split("host", "[.]")).alias("labels"), F.length("path").alias("length")).agg(F.max("action").alias("action"))


def _file(digests: list[int], actions: list[int], keys: list[bytes]) -> bytes:
    ends = np.cumsum([0, *map(len, keys)])
    return b"".join((np.array([len(keys)], np.int64).tobytes(), np.array(digests, np.int64).tobytes(), ends.astype(np.int64).tobytes(), np.array(actions, np.int8).tobytes(), *keys))


def publish(spark: SparkSession, entries: DataFrame, block_keys: int = BLOCK_KEYS) -> list[str]:
    """Write ``entries(key, action)`` with distinct keys as blocks and hand them to all executors; the blocks' names.

    The driver reads the sorted list partition by partition and holds one block at a time.
    """
    folder, names = shared_folder(spark), []
    path = spark._jvm.org.apache.hadoop.fs.Path

    def write(block: list) -> None:
        name = f"urls-{uuid4().hex}.bin"
        at = path(folder, name)
        out = at.getFileSystem(spark._jsc.hadoopConfiguration()).create(at)
        data = _file(*map(list, zip(*block, strict=True)))
        for i in range(0, len(data), 1 << 22):
            out.write(bytearray(data[i : i + (1 << 22)]))
        out.close()
        spark.sparkContext.addFile(at.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(at).toString())
        names.append(name)

    block = []
    ordered = entries.select(F.xxhash64("key").alias("digest"), (F.col("action") == "block").cast("int").alias("action"), F.encode("key", "UTF-8").alias("key")).orderBy("digest", "key")
    for row in ordered.toLocalIterator():
        block.append((row.digest, row.action + 1, bytes(row.key)))
        if len(block) == block_keys:
            write(block)
            block = []
    if block:
        write(block)
    return names


@lru_cache(maxsize=64)
def _mapped(name: str) -> tuple[np.ndarray, np.ndarray, pa.LargeBinaryArray]:
    """(digests, actions, keys) of a block, all parts of one mapped file."""
    whole = np.memmap(SparkFiles.get(name), np.uint8, "r")
    n = int(whole[:8].view(np.int64)[0])
    digests, ends, actions, keys = whole[8 : 8 + 8 * n], whole[8 + 8 * n : 16 + 16 * n], whole[16 + 16 * n : 16 + 17 * n], whole[16 + 17 * n :]
    return digests.view(np.int64), actions, pa.LargeBinaryArray.from_buffers(pa.large_binary(), n, [None, pa.py_buffer(ends), pa.py_buffer(keys)])


def probe(digests: np.ndarray, keys: pa.Array, block: tuple[np.ndarray, np.ndarray, pa.LargeBinaryArray]) -> np.ndarray:
    """For each key: 0 if the block has no such key, or else 1 (allow) or 2 (block)."""
    held, actions, full = block
    out = np.zeros(len(digests), np.int8)
    at, live = np.searchsorted(held, digests), np.arange(len(digests))
    while len(live):  # again only for keys that share their digest with another
        live = live[at[live] < len(held)]
        live = live[held[at[live]] == digests[live]]
        if not len(live):
            break
        equal = pc.equal(full.take(pa.array(at[live])), keys.take(pa.array(live)).cast(pa.large_binary())).to_numpy(zero_copy_only=False)
        out[live[equal]] = actions[at[live[equal]]]
        live = live[~equal]
        at[live] += 1
    return out


def _looked_up(digests: Column, keys: Column, name: str) -> Column:
    @F.arrow_udf("array<tinyint>")
    def find(digests: pa.Array, keys: pa.Array) -> pa.Array:
        flat, asked = digests.flatten(), keys.flatten()
        found = probe(flat.to_numpy(zero_copy_only=False), asked, _mapped(name)) if len(flat) else np.zeros(0, np.int8)
        ends = pa.array(np.cumsum([0, *pc.list_value_length(digests).to_numpy(zero_copy_only=False)]), pa.int32())
        return pa.ListArray.from_arrays(ends, pa.array(found, pa.int8()))

    return find(digests, keys)


def judge_urls(pages: DataFrame, rules: DataFrame, words: tuple[str, ...] = BLOCKED_WORDS, block_keys: int = BLOCK_KEYS) -> DataFrame:
    """``pages(url, ...)`` with ``host``, ``path``, ``rule``, ``listed`` and ``verdict``.

    ``rules(pattern, action)``, action allow or block: a pattern like ``example.org/fr/`` fits its host and all
    subdomains where the path starts with the pattern's, at any character. The longest pattern wins, then the
    one with the longer host. Where none fits, a URL with one of ``words`` between the dots and hyphens of its
    host is blocked and ``listed`` has that word; all else is allowed. A null URL or one without ``://`` has an
    empty host and path, no rule fits it, and it is allowed. Rows are judged one by one, so repeated rows are no
    matter. Other columns pass through, of the names above all but url are replaced; an empty table stays
    empty, and an empty list of rules fits nothing. A URL asks for as many keys as rules have different pairs of
    labels and path lengths.
    """
    spark = pages.sparkSession
    ruled = split_rules(rules)
    shapes = [(r.labels, r.length) for r in ruled.select("labels", "length").distinct().orderBy("labels", "length").collect()]
    listed = spark.createDataFrame([(WORD + w.lower(), "block") for w in sorted({*words})], "key string, action string")
    names = publish(spark, ruled.select("key", "action").unionAll(listed), block_keys)

    host, path = host_and_path(F.col("url"))
    rest = [c for c in pages.columns if c.lower() not in ("host", "path", "rule", "listed", "verdict")]
    rows = pages.select(*rest, host.alias("host"), path.alias("path"))
    # Where the host has fewer labels than a rule, the whole host is asked for, which is no such rule's.
    tail = lambda labels: F.call_function("substring_index", F.col("host"), F.lit("."), -labels)
    fitting = F.array(*(F.struct(F.lit(a).alias("labels"), F.lit(b).alias("length")) for a, b in shapes)) if shapes else F.array().cast("array<struct<labels:int,length:int>>")
    asked = F.transform(F.filter(fitting, lambda s: s["length"] <= F.length("path")), lambda s: F.concat(tail(s["labels"]), F.left("path", s["length"])))
    spoken = F.transform(F.array_distinct(F.array_remove(F.split("host", "[.-]"), "")), lambda w: F.concat(F.lit(WORD), w))
    rows = rows.withColumn("_keys", F.when(F.col("host") == "", F.array().cast("array<string>")).otherwise(F.concat(asked, spoken)))
    rows = rows.withColumn("_digests", F.transform("_keys", lambda k: F.xxhash64(k)))
    found = [_looked_up(F.col("_digests"), F.col("_keys"), n) for n in names]
    rows = rows.withColumn("_found", reduce(lambda a, b: F.zip_with(a, b, lambda x, y: F.greatest(x, y)), found) if found else F.transform("_keys", lambda k: F.lit(0)))
    hits = F.filter(F.zip_with("_keys", "_found", lambda k, a: F.struct(F.length(k).alias("length"), F.length(F.substring_index(k, "/", 1)).alias("host"), k.alias("key"), a.alias("action"))), lambda h: h["action"] > 0)
    best = F.array_max(F.filter("_hits", lambda h: ~F.startswith(h["key"], F.lit(WORD))))
    word = F.array_max(F.filter("_hits", lambda h: F.startswith(h["key"], F.lit(WORD))))
    rows = rows.withColumn("_hits", hits).withColumns({"_best": best, "_word": word})
    action = F.coalesce(F.col("_best.action"), F.col("_word.action"), F.lit(1))
    return rows.select(*rest, "host", "path", F.col("_best.key").alias("rule"), F.when(F.col("_best").isNull(), F.substring("_word.key", 2, 1_000_000)).alias("listed"), F.when(action == 2, "block").otherwise("allow").alias("verdict"))
