"""Streams: ticks to bars, and the research cycle over whatever bars are new."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from barloom.sources.bars import aggregate_bars


def bars_stream(ticks: DataFrame, timeframe: str = "5m", late: str = "10 minutes") -> DataFrame:
    """Bars of a stream of ``ticks(market, ts, tie, price, volume)``; ticks later than the watermark are dropped."""
    return aggregate_bars(ticks.withWatermark("ts", late), timeframe)


def start_bars(ticks: DataFrame, path: str, checkpoint: str, timeframe: str = "5m", late: str = "10 minutes") -> StreamingQuery:
    """Writes each bar once, when the watermark passes its end; a restart goes on from ``checkpoint``."""
    return bars_stream(ticks, timeframe, late).writeStream.outputMode("append").format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path)


def start_cycle(spark: SparkSession, path: str, schema: str, checkpoint: str, cycle: Callable[[DataFrame, int], None], every: str | None = None) -> StreamingQuery:
    """Runs ``cycle(new bars, batch)`` over bars as they arrive in ``path``: once for all there are, or again every interval."""
    new = spark.readStream.schema(schema).parquet(path)
    trigger = {"processingTime": every} if every else {"availableNow": True}
    return new.writeStream.foreachBatch(cycle).option("checkpointLocation", checkpoint).trigger(**trigger).start()

