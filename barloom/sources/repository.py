"""The store of strategies that passed: JSON rows, deduplicated by a fingerprint of their rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

STRATEGY = (
    "struct<id:string,name:string,entry_rules:array<string>,exit_rules:array<string>,stop_loss_logic:string,take_profit_logic:string,risk_reward:double,"
    "timeframe:string,market:string,ema_fast:int,ema_slow:int,use_vwap:boolean,use_rsi:boolean,created_at:string>"
)
PERIOD = "struct<total_pnl:double,total_pnl_percent:double,win_rate:double,max_drawdown:double,max_drawdown_percent:double,expectancy:double,profit_factor:double,total_trades:int,equity_curve:array<double>>"
RESULT = f"struct<period_results:map<string,{PERIOD}>,all_periods_profitable:boolean,worst_drawdown:double,avg_win_rate:double,avg_expectancy:double,avg_profit_factor:double,total_trades_per_year:int>"
STORED = f"hash string, stored_at string, strategy {STRATEGY}, backtest_result {RESULT}"
#: Figures of a result that a reader fills in when they are missing.
DEFAULTS = {"all_periods_profitable": False, "worst_drawdown": 0.0, "avg_win_rate": 0.0, "avg_expectancy": 0.0, "avg_profit_factor": 0.0, "total_trades_per_year": 0}


def fingerprint(entry: str | Column = "entry_rules", leave: str | Column = "exit_rules") -> Column:
    """12 hex digits that entry and exit rules, in order, decide; the same in every process."""
    none = F.array().cast("array<string>")
    entry, leave = (F.coalesce(F.col(c) if isinstance(c, str) else c, none) for c in (entry, leave))
    return F.left(F.sha2(F.array_join(F.concat(entry, leave), "|"), 256), F.lit(12))


def encode(strategies: DataFrame, results: DataFrame, overall: DataFrame, stored_at: Column) -> DataFrame:
    """Rows of the store: hash, stored_at, and nested strategy and result with string keys for windows; trades are left out."""
    by_period = results.groupBy("strategy_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col("period_days").cast("string"), _struct(PERIOD))))).alias("period_results"))
    whole = overall.join(by_period, "strategy_id").select("strategy_id", _struct(RESULT).alias("backtest_result"))
    rows = strategies.withColumn("id", F.col("strategy_id"))
    rows = rows.select("strategy_id", fingerprint().alias("hash"), stored_at.alias("stored_at"), _struct(STRATEGY, rows.columns).alias("strategy"))
    return rows.join(whole, "strategy_id").drop("strategy_id")


def _struct(ddl: str, have: list[str] | None = None) -> Column:
    """The columns that a struct type names; those outside ``have`` are null."""
    fields = _fields(ddl)
    return F.struct(*((F.col(n) if have is None or n in have else F.lit(None)).cast(t).alias(n) for n, t in fields))


def _fields(ddl: str) -> list[tuple[str, str]]:
    from pyspark.sql.types import StructType

    return [(f.name, f.dataType.simpleString()) for f in StructType.fromDDL(f"s {ddl}")["s"].dataType]


def to_json(rows: DataFrame) -> DataFrame:
    """The store's rows as JSON documents."""
    return rows.select("hash", F.to_json(F.struct("hash", "stored_at", "strategy", "backtest_result")).alias("document"))


def from_json(documents: DataFrame) -> DataFrame:
    """Documents as rows again; missing figures become their defaults, windows are not restored, an unreadable document gives none."""
    rows = documents.select(F.from_json("document", STORED).alias("d")).filter("d.hash IS NOT NULL").select("d.*")
    filled = {k: F.coalesce(F.col(f"backtest_result.{k}"), F.lit(v)).alias(k) for k, v in DEFAULTS.items()}
    empty = F.lit(None).cast(f"map<string,{PERIOD}>").alias("period_results")
    return rows.withColumn("backtest_result", F.struct(empty, *filled.values()))


def read(spark: SparkSession, path: str) -> DataFrame:
    """All stored rows; a path that does not exist is an empty store."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        return spark.createDataFrame([], STORED)
    return spark.read.schema(STORED).json(path, mode="PERMISSIVE").filter("hash IS NOT NULL")


def new_rows(stored: DataFrame, rows: DataFrame) -> DataFrame:
    """``rows`` whose hash is not stored yet, the earliest of each hash."""
    first = rows.groupBy("hash").agg(F.min_by(F.struct(*rows.columns), F.coalesce("stored_at", F.lit(""))).alias("r")).select("r.*")
    return first.join(stored.select("hash"), "hash", "left_anti").select(*rows.columns)


def append(spark: SparkSession, path: str, rows: DataFrame) -> None:
    """Adds the rows that are new; files written before are not touched."""
    new_rows(read(spark, path), rows).write.mode("append").json(path)


def latest(rows: DataFrame, n: int = 10) -> DataFrame:
    """The n rows stored last; a missing time sorts before all others."""
    return rows.orderBy(F.desc(F.coalesce("stored_at", F.lit(""))), "hash").limit(n)


def export(spark: SparkSession, path: str, to: str) -> None:
    """A copy of all rows as JSON at another path."""
    read(spark, path).write.mode("overwrite").json(to)


def clear(spark: SparkSession, path: str) -> None:
    spark.createDataFrame([], STORED).write.mode("overwrite").json(path)
