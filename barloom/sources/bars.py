"""Bars: from event tables, candle payloads and files, and the look-back windows over them."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Minutes of the timeframes; others count as 5.
MINUTES = {"1m": 1, "5m": 5, "15m": 15, "30m": 30, "1h": 60, "1d": 1440}
DEFAULT_MINUTES = 5
PERIODS = (30, 60, 180, 365)
BAR_COLUMNS = ("market", "timeframe", "ts", "open", "high", "low", "close", "volume")
CSV = T.StructType([T.StructField("datetime", T.TimestampType()), *(T.StructField(c, T.DoubleType()) for c in ("open", "high", "low", "close", "volume"))])
PAYLOAD = "struct<s:string,candles:array<array<double>>>"


def minutes(timeframe: Column) -> Column:
    """Minutes of a timeframe; unknown ones count as 5."""
    known = F.create_map(*(F.lit(x) for pair in MINUTES.items() for x in pair))
    return F.coalesce(F.element_at(known, timeframe), F.lit(DEFAULT_MINUTES))


def aggregate_bars(ticks: DataFrame, timeframe: str) -> DataFrame:
    """Bars of ``ticks(market, ts, tie, price, volume)``; buckets without ticks have none.

    Ticks without price or time are left out; ticks of one instant are ordered by ``tie``.
    """
    at = F.struct("ts", "tie")
    size = f"{MINUTES.get(timeframe, DEFAULT_MINUTES)} minutes"
    bars = ticks.filter("price IS NOT NULL AND ts IS NOT NULL").groupBy("market", F.window("ts", size).alias("w")).agg(
        F.min_by("price", at).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", at).alias("close"), F.sum("volume").alias("volume"),
    )
    return bars.select("market", F.lit(timeframe).alias("timeframe"), F.col("w.start").alias("ts"), "open", "high", "low", "close", F.coalesce("volume", F.lit(0.0)).alias("volume"))


def event_ticks(events: DataFrame) -> DataFrame:
    """The events table as ticks: market is the event type, volume the number k of props. Times without zone are taken in the session's."""
    return events.select(F.col("event_type").alias("market"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("tie"), F.col("value").alias("price"), F.get_json_object("props", "$.k").cast("double").alias("volume"))


def order_ticks(orders: DataFrame) -> DataFrame:
    """The orders table as ticks: market is the priority, each order one unit of volume."""
    return orders.select(F.col("o_orderpriority").alias("market"), F.col("o_orderdate").cast("timestamp").alias("ts"), F.col("o_orderkey").alias("tie"), F.col("o_totalprice").alias("price"), F.lit(1.0).alias("volume"))


def lineitem_ticks(lineitem: DataFrame) -> DataFrame:
    """Line items as ticks: market is the return flag, price the extended price, volume the quantity."""
    tie = F.col("l_orderkey") * 8 + F.col("l_linenumber")
    return lineitem.select(F.col("l_returnflag").alias("market"), F.col("l_shipdate").cast("timestamp").alias("ts"), tie.alias("tie"), F.col("l_extendedprice").alias("price"), F.col("l_quantity").alias("volume"))


def bars_from_events(events: DataFrame, timeframe: str = "1h") -> DataFrame:
    return aggregate_bars(event_ticks(events), timeframe)


def decode_candles(payloads: DataFrame) -> DataFrame:
    """Raw rows of ``payloads(market, timeframe, seq, payload)`` as bars with the order of arrival.

    payload is a JSON text ``{"s": "ok", "candles": [[epoch, o, h, l, c, v], ...]}``; a status other
    than ok or an unreadable text gives no rows.
    """
    rows = payloads.select("market", "timeframe", "seq", F.from_json("payload", PAYLOAD).alias("p")).filter("p.s = 'ok'")
    rows = rows.select("market", "timeframe", "seq", F.posexplode("p.candles").alias("at", "c"))
    return rows.select("market", "timeframe", "seq", "at", F.timestamp_seconds(F.get("c", F.lit(0)).cast("long")).alias("ts"), *(F.get("c", F.lit(i)).alias(n) for i, n in enumerate(("open", "high", "low", "close", "volume"), 1)))


def first_per_timestamp(rows: DataFrame, *order: str) -> DataFrame:
    """The first row of each (market, timeframe, ts) by ``order``, as bars in the fixed column order."""
    least = F.min_by(F.struct("open", "high", "low", "close", "volume"), F.struct(*order))
    return rows.groupBy("market", "timeframe", "ts").agg(least.alias("b")).select("market", "timeframe", "ts", "b.*")


def sorted_bars(bars: DataFrame) -> DataFrame:
    """Bars in the fixed column order, ordered by time within each series."""
    return bars.select(*BAR_COLUMNS).orderBy("market", "timeframe", "ts")


def read_csv(spark: SparkSession, path: str, market: str, timeframe: str) -> DataFrame:
    """Bars of one header CSV ``datetime,open,high,low,close,volume``; unreadable rows are an error."""
    rows = spark.read.schema(CSV).csv(path, header=True, mode="FAILFAST")
    return rows.select(F.lit(market).alias("market"), F.lit(timeframe).alias("timeframe"), F.col("datetime").alias("ts"), "open", "high", "low", "close", "volume")


def csv_path(root: str, market: str, timeframe: str) -> str:
    return f"{root}/{market.replace(':', '_')}_{timeframe}.csv"


def read_bars(spark: SparkSession, path: str) -> DataFrame:
    """Bars written by ``write_bars``; filters on market and timeframe prune folders."""
    return spark.read.parquet(path).select(*BAR_COLUMNS)


def write_bars(bars: DataFrame, path: str) -> None:
    """Overwrites the (market, timeframe) folders that ``bars`` has and leaves others alone.

    Tasks take ranges of time, so a long series is written by many, each a file of its own.
    """
    bars.select(*BAR_COLUMNS).repartitionByRange("market", "timeframe", "ts").sortWithinPartitions("market", "timeframe", "ts").write.option("partitionOverwriteMode", "dynamic").partitionBy("market", "timeframe").mode("overwrite").parquet(path)


def lookback(bars: DataFrame, as_of: datetime | Column, days: int) -> DataFrame:
    """Bars later than ``as_of`` - days; strictly later, and none at all is an empty frame."""
    return bars.filter(F.col("ts") > _before(as_of, days))


def with_periods(bars: DataFrame, as_of: datetime | Column, periods: tuple[int, ...] = PERIODS) -> DataFrame:
    """Each bar once for every look-back window it lies in, as ``period_days``.

    The widest window is a plain filter, which reaches the scan; the fan-out itself needs no join.
    """
    fits = F.filter(F.array(*map(F.lit, periods)), lambda d: F.col("ts") > _as_column(as_of) - F.make_dt_interval(days=d))
    return lookback(bars, as_of, max(periods)).withColumn("period_days", F.explode(fits))


def _as_column(as_of: datetime | Column) -> Column:
    return as_of if isinstance(as_of, Column) else F.lit(as_of)


def _before(as_of: datetime | Column, days: int) -> Column:
    return _as_column(as_of) - F.make_dt_interval(days=F.lit(days))


def end_of(bars: DataFrame) -> datetime | None:
    """One microsecond after the last bar, as the instant to look back from."""
    row = bars.agg(F.max("ts") + F.expr("INTERVAL '0 0:00:00.000001' DAY TO SECOND")).first()
    return row[0]
