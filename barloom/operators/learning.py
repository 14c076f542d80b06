"""What strategies that passed have in common: weights of rules and timeframes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The stored strategies that are learned from.
RECENT = 50
#: Risk-reward of a strategy that states none, and of an empty memory.
NEUTRAL = 2.0
MEMORY = "keywords map<string,double>, timeframes map<string,double>, rr_focus double, version double"


def recent(strategies: DataFrame, order: str = "stored_at", n: int = RECENT) -> DataFrame:
    """The n strategies stored last; ties by id."""
    return strategies.orderBy(F.desc(order), F.desc("strategy_id")).limit(n)


def rule_weights(strategies: DataFrame) -> DataFrame:
    """(keyword, weight): the share of each entry rule among all entry rules, to 4 digits."""
    return _shares(strategies.select(F.explode("entry_rules").alias("keyword")), "keyword")


def timeframe_weights(strategies: DataFrame) -> DataFrame:
    """(timeframe, weight): the share of each timeframe, to 4 digits."""
    return _shares(strategies.select("timeframe"), "timeframe")


def _shares(rows: DataFrame, name: str) -> DataFrame:
    counts = rows.groupBy(name).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    return counts.join(F.broadcast(total)).select(name, F.round(F.col("n") / F.col("total"), 4).alias("weight"))  # total: one row


def mean_risk_reward(strategies: DataFrame) -> DataFrame:
    return strategies.agg(F.round(F.avg(F.coalesce("risk_reward", F.lit(NEUTRAL))), 2).alias("rr_focus"))


def memory(strategies: DataFrame) -> DataFrame:
    """One row with the two weight maps and the mean risk-reward of the recent strategies."""
    as_map = lambda df, key, name: df.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(key, "weight")))).alias(name))
    own = recent(strategies)
    out = as_map(rule_weights(own), "keyword", "keywords").join(F.broadcast(as_map(timeframe_weights(own), "timeframe", "timeframes")))
    return out.join(F.broadcast(mean_risk_reward(own))).withColumn("version", F.lit(1.0))


def read_memory(spark: SparkSession, path: str) -> DataFrame:
    """The stored memory, or an empty one that weighs all alike."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    if folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        return spark.read.schema(MEMORY).json(path)
    return spark.range(1).select(F.create_map().cast("map<string,double>").alias("keywords"), F.create_map().cast("map<string,double>").alias("timeframes"), F.lit(NEUTRAL).alias("rr_focus"), F.lit(1.0).alias("version"))


def write_memory(row: DataFrame, path: str) -> None:
    row.write.mode("overwrite").json(path)


def weighed(choices: DataFrame, weights: DataFrame, key: str, name: str) -> DataFrame:
    """Adds ``weight``: 1 + 2 x the learned weight of the choice's ``key``, or 1 where none was learned."""
    known = weights.select(F.col(name).alias("_key"), F.col("weight").alias("_w"))
    return choices.join(known, F.col(key) == F.col("_key"), "left").withColumn("weight", 1 + 2 * F.coalesce("_w", F.lit(0.0))).drop("_key", "_w")

