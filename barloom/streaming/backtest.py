"""A backtest that goes on with every batch of new bars, and gives the trades of one run over all of them.

Between batches three small tables stand for all bars seen: the last bars of each series with their indicators
and recurrences, from which detectors and averages go on; the highs and lows of its first bars; and for each
strategy and series when it is free again, or its open position. Batch n reads what batch n - 1 left
and writes under its own number, so a batch that is run again after a failure gives the same.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from barloom.functions.columns import with_bar_idx
from barloom.functions.lineage import cut
from barloom.operators.detectors import FIRST_BARS, reach_of
from barloom.operators.indicators import with_indicators
from barloom.operators.rules import TOKEN_REACH, detectors_of, entries
from barloom.operators.trades import TRADE_KEYS, as_trades, entry_of, positions, with_levels
from barloom.sources.bars import BAR_COLUMNS

SERIES = ("market", "timeframe", "period_days")
MARK = "struct<at:int,ts:timestamp,price:double>"
OPEN = f"strategy_id string, market string, timeframe string, period_days int, free int, direction string, stop double, target double, entry {MARK}"


@dataclass(frozen=True)
class State:
    """``tail``: the last bars of each series; ``held``: for each strategy and series that has entered, its open position or else the bar on which it is free again."""

    tail: DataFrame
    held: DataFrame


@dataclass(frozen=True)
class Setup:
    """What all batches share: strategies, their distinct rules and pairs of averages, and the zone of the exchange."""

    strategies: DataFrame
    rules: tuple[str, ...]
    emas: tuple[tuple[int, int], ...]
    zone: str = "Asia/Kolkata"

    @property
    def averages(self) -> tuple[int, ...]:
        return tuple(sorted({p for pair in self.emas for p in pair}))

    @property
    def reach(self) -> int:
        """Bars of a tail: as many as any rule looks back, and those that seed an average."""
        return max(reach_of(detectors_of(list(self.rules))), TOKEN_REACH, FIRST_BARS, *self.averages) + 1


def advance(setup: Setup, bars: DataFrame, state: State | None) -> tuple[DataFrame, State]:
    """(positions closed on new bars, state after them) from ``bars`` in the fixed column order.

    A bar that is not later than the last one seen of its series is left out, so bars of a series must come in
    order of batches; within a batch any order will do. Positions leave by stop and target only.
    """
    keys = list(SERIES)
    new = bars.select(*BAR_COLUMNS).withColumn("period_days", F.lit(0)).filter("ts IS NOT NULL")
    if not state:
        rows = with_bar_idx(new.dropDuplicates([*keys, "ts"]))
    else:
        last = state.tail.groupBy(*keys).agg(F.max("bar_idx").alias("_known"), F.max("ts").alias("_seen"))
        fresh = new.dropDuplicates([*keys, "ts"]).join(last, keys, "left").filter("_seen IS NULL OR ts > _seen")
        fresh = with_bar_idx(fresh).withColumn("bar_idx", F.col("bar_idx") + F.coalesce("_known", F.lit(-1)) + 1)
        rows = state.tail.join(last, keys).unionByName(fresh, allowMissingColumns=True).drop("_seen")
    first = lambda c: F.when(F.col("bar_idx") < FIRST_BARS, F.col(c))
    seen = {"_first_high": F.max(first("high")), "_first_low": F.min(first("low"))}
    if state:
        seen = {"_first_high": F.greatest(seen["_first_high"], F.max("_first_high")), "_first_low": F.least(seen["_first_low"], F.min("_first_low"))}
    bounds = rows.groupBy(*keys).agg(*(c.alias(n) for n, c in seen.items()), F.max("bar_idx").alias("_last"))
    rows = rows.drop("_first_high", "_first_low").join(bounds, keys)
    ready = with_indicators(rows, setup.averages, keep=True)
    ready = cut(ready if state else ready.withColumn("_known", F.lit(None).cast("int")))

    tail = ready.filter(F.col("bar_idx") > F.col("_last") - setup.reach).drop("_known", "_last")
    current = F.coalesce(F.col("bar_idx") > F.col("_known"), F.lit(True))
    signals = entry_of(with_levels(entries(ready, setup.strategies, list(setup.rules), list(setup.emas), setup.zone)))
    signals = signals.join(ready.filter(current).select(*keys, "bar_idx"), [*keys, "bar_idx"], "left_semi")
    signals = signals.select(*TRADE_KEYS, "bar_idx", "direction", "stop", "target", "entry")
    if state:
        free = state.held.select(*TRADE_KEYS, "free")
        signals = signals.join(free, list(TRADE_KEYS), "left").filter("free IS NULL OR bar_idx >= free").drop("free")
        known = ready.groupBy(*keys).agg(F.coalesce(F.max("_known"), F.lit(0)).alias("bar_idx"))
        carried = state.held.filter("entry IS NOT NULL").join(known, keys).select(*signals.columns)
        # An open position comes before all new signals and is looked for after the last bar seen.
        signals = carried.unionByName(signals)
    taken = cut(positions(ready.filter(current | (F.col("bar_idx") == F.col("_known"))), signals))

    after = taken.groupBy(*TRADE_KEYS).agg(F.max(F.col("exit.at") + 1).alias("free"), F.max(F.when(F.col("exit").isNull(), F.struct("entry", "direction", "stop", "target"))).alias("_open"))
    after = after.select(*TRADE_KEYS, F.when(F.col("_open").isNull(), F.col("free")).alias("free"), *(F.col(f"_open.{c}").alias(c) for c in ("direction", "stop", "target", "entry")))
    if state:
        after = after.unionByName(state.held.join(after, list(TRADE_KEYS), "left_anti"))
    return taken.filter("exit IS NOT NULL"), State(tail, after)


def marked(state: State) -> DataFrame:
    """Open positions as trades that leave at the last close of their series, as a run over all bars reports them."""
    keys = list(SERIES)
    last = state.tail.groupBy(*keys).agg(F.max_by(F.struct(F.col("bar_idx").alias("at"), "ts", F.col("close").alias("price")), "bar_idx").alias("last"))
    open_ = state.held.filter("entry IS NOT NULL").join(last, keys)
    return as_trades(open_.withColumn("exit", F.lit(None).cast(MARK)))


def read_state(spark: SparkSession, path: str, batch: int) -> State | None:
    """What a batch left; null before the first."""
    if batch < 0:
        return None
    return State(spark.read.parquet(f"{path}/state/{batch}/tail"), spark.read.parquet(f"{path}/state/{batch}/held"))


def start_backtest(bars: DataFrame, setup: Setup, path: str, checkpoint: str, every: str | None = None) -> StreamingQuery:
    """Backtests a stream of bars: trades go to ``path/trades/batch=n`` when they are closed, the state to ``path/state/n``.

    Once for all there are, or again every interval; a restart goes on from ``checkpoint`` and the last state. States
    before the last but one are never read again.
    """

    def step(new: DataFrame, batch: int) -> None:
        spark = new.sparkSession
        closed, state = advance(setup, cut(new), read_state(spark, path, batch - 1))
        state.tail.write.mode("overwrite").parquet(f"{path}/state/{batch}/tail")
        state.held.write.mode("overwrite").parquet(f"{path}/state/{batch}/held")
        as_trades(closed).write.mode("overwrite").parquet(f"{path}/trades/batch={batch}")

    trigger = {"processingTime": every} if every else {"availableNow": True}
    return bars.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(**trigger).start()
