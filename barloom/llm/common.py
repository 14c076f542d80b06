"""Helpers that several operators of this package share."""

from __future__ import annotations

import atexit
import shutil
import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A key with fewer rows than this is joined by shuffling.
HOT_ROWS = 100
#: At most this many hot keys are broadcast, whatever the size of the input.
HOT_KEYS = 50_000


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder, which all executors share.

    It is the cluster's ``spark.checkpoint.dir``; where none is set, a session in one process gets a
    temporary one, and on a cluster that is an error, as its executors share no local folder.
    """
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if not shared and not (sc.master == "local" or sc.master.startswith("local[")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        if not shared:
            shared = tempfile.mkdtemp(prefix="barloom-checkpoint-")
            atexit.register(shutil.rmtree, shared, ignore_errors=True)
        sc.setCheckpointDir(shared)
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared folder and cut its lineage."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def folded(text: Column) -> Column:
    """A text that two texts share exactly if they are equal with A-Z as a-z.

    The bytes beyond ASCII are read as Latin-1 before lower-casing. That changes leading bytes of two-byte
    characters alone and to values of their own, as the number of bytes that follow them stays. So ASCII
    characters stay what they are but for A-Z, and no character beyond ASCII becomes one.
    """
    return F.lower(F.when(F.octet_length(text) == F.length(text), text).otherwise(F.decode(text.cast("binary"), "ISO-8859-1")))


def attach(rows: DataFrame, table: DataFrame, keys: list[str], count: str, total: int, how: str = "inner") -> DataFrame:
    """Inner or left join of ``rows`` with ``table``, which has one row for each key and the key's number of rows in ``count``.

    Keys with many rows are broadcast: of those there are at most ``total / limit`` <= HOT_KEYS. All
    other keys have too few rows to make a task large, and are shuffled.
    """
    limit = max(HOT_ROWS, total // HOT_KEYS)
    hot = table.filter(F.col(count) >= limit).drop(count)
    cold = table.filter(F.col(count) < limit).drop(count)
    same = [F.col(f"r.{k}").eqNullSafe(F.col(f"t.{k}")) for k in keys]
    rows, names = rows.alias("r"), [F.col(f"r.{c}") for c in rows.columns]
    names += [F.col(f"t.{c}") for c in table.columns if c not in (*keys, count)]
    few = rows.join(F.broadcast(hot.alias("t")), same, "left_anti").alias("r")
    return rows.join(F.broadcast(hot.alias("t")), same).select(*names).unionAll(few.join(cold.alias("t"), same, how).select(*names))
