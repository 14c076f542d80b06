"""Cleaning of a document corpus, stage by stage; each stage's rows are written and read again by the next.

quality   drop documents that the quality classifier rejects
lines     drop lines that other documents have too
near      keep one document of each group of near duplicates
benchmark drop documents that hold benchmark passages
encode    byte-level BPE ids of what is left, decoded again

Every stage takes (spark, docs, sf_dir) and all but the last return the columns of documents. Null texts count as
empty and stay what they are until ``lines`` makes them empty; repeated rows stay repeated; other columns are left
out; an empty table stays empty.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.llm import byte_bpe
from barloom.llm.common import cut
from barloom.llm.decontaminate import find_contamination
from barloom.llm.jaccard import near_duplicates
from barloom.llm.line_dedup import drop_repeated_lines
from barloom.llm.quality import fit, sample, score

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


def _whole(docs: DataFrame) -> DataFrame:
    """The columns of documents, with n_chars of the text as it now is."""
    return docs.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score 0.5 or more; learned from labelled rows whose crc32(doc_id) mod 3 is not 1."""
    kept_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").filter(~kept_out).select("doc_id", F.col("quality").alias("label"))
    model = fit(*sample(docs, labels, 1_500))
    return _whole(score(docs.select(*COLUMNS), model).filter("score >= 0.5"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every text without the lines that a smaller doc_id has; documents stay, also those that are left empty."""
    return _whole(drop_repeated_lines(docs))


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest doc_id of each group of near duplicates, with all its rows, and rows without doc_id, which are in no group.

    The join has no aggregation above it, so Spark can split a doc_id that many rows share.
    """
    first = near_duplicates(docs).filter("doc_id = component_id").select("doc_id").distinct()
    stay = docs.filter("doc_id IS NOT NULL").join(first, "doc_id", "left_semi")
    return _whole(stay.select(*docs.columns).unionAll(docs.filter("doc_id IS NULL")))


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows of which less than a twentieth of the words lies in benchmark windows, each judged by its own text."""
    found = find_contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    bad = found.filter("contaminated").select(F.col("doc_id").alias("_id"), "ident").distinct()
    rows = docs.select(*COLUMNS, F.xxhash64("text").alias("_ident"))
    return _whole(rows.join(bad, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_ident") == F.col("ident")), "left_anti"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids, decoded_text) of the documents that are left."""
    ids = byte_bpe.encode(docs.select("doc_id", "text"), RANKS, public_tokenizers.PATTERN)
    decoded = byte_bpe.decode(ids.select("doc_id", "ids"), RANKS)
    return decoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", F.decode("decoded", "UTF-8").alias("decoded_text"))


STAGES = [("quality", quality), ("lines", lines), ("near", near), ("benchmark", benchmark), ("encode", encode)]
#: The classifier and the tokenizer have no SQL twin.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = cut(docs)
    return docs
