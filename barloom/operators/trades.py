"""From entries to trades: stop and target prices, the exit of every signal, and one position at a time.

Both steps run inside the JVM and spread one long series over many tasks:

* Exits. The bars of a series are cut into blocks of 128 and these into groups of 128 blocks; each block
  keeps its bars and the extremes of the later blocks of its group and of the later groups. A signal looks for
  the first bar, else block, else group, that reaches one of its levels, and only signals that are not
  done in their own block are sent on to the block (by way of the group) that they found.
* One position at a time. From a signal the next one is the first after its exit. The signals of a strategy are
  cut into segments; each segment works out, for all of its signals, when one that starts there is free
  beyond the segment. Only the moments at which some signal of another segment becomes free inside a segment can be
  arrivals there, so a walk from segment to segment over these few finds which arrivals are real, and each
  segment then picks its trades on its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.functions.columns import series_keys
from barloom.functions.lineage import cut

WARM_UP = 50
TRADE_KEYS = ("strategy_id", "market", "timeframe", "period_days")
#: Bars of a block, blocks of a group, and bars of a segment of signals.
BLOCK, GROUP, SEGMENT = 128, 128, 256
#: When a signal that never leaves is free again.
NEVER = 2**31 - 1
COLUMNS = ("entry_idx", "exit_idx", "entry_time", "exit_time", "direction", "entry_price", "exit_price")


def stop_distance(logic: Column, close: Column, high: Column, low: Column, atr: Column) -> Column:
    """Distance of the stop from the entry by the text of the stop rule; the first phrase that it holds decides."""
    by_atr = lambda n: F.coalesce(n * atr, 0.01 * close)
    has = lambda phrase: F.contains(F.lower(logic), F.lit(phrase))
    return (
        F.when(has("1.5x_atr"), by_atr(1.5)).when(has("2x_atr"), by_atr(2.0)).when(has("0.5pct"), 0.005 * close).when(has("1pct"), 0.01 * close)
        .when(has("entry_candle_stop"), F.greatest(F.abs(close - low), F.abs(high - close))).otherwise(by_atr(1.5))
    )


def with_levels(entries: DataFrame) -> DataFrame:
    """Adds stop and target prices: the stop distance against, and its multiple by risk_reward with, the direction."""
    away = stop_distance(F.col("stop_loss_logic"), F.col("close"), F.col("high"), F.col("low"), F.col("atr_14"))
    side = F.when(F.col("direction") == "LONG", 1).otherwise(-1)
    return entries.withColumn("stop", F.col("close") - side * away).withColumn("target", F.col("close") + side * away * F.col("risk_reward"))


def extremes(bars: DataFrame, exits: str | None = None, block: int = BLOCK, group: int = GROUP) -> tuple[DataFrame, DataFrame]:
    """(blocks, groups) of the bars of each series.

    blocks: ``_block``, ``_bars`` (its bars in order), ``_blocks`` (the extremes of the later blocks of its group),
    ``_groups`` (those of the later groups of the series) and ``_last`` (the last bar of the series).
    groups: ``_group`` and ``_blocks``, the extremes of all its blocks. Extremes are the highest high, the
    lowest low and the signal exits that hold anywhere in it. The blocks are written down.
    """
    keys = series_keys(bars)
    leaves = F.col(exits) if exits else F.array().cast("array<string>")
    bar = F.struct(F.col("bar_idx").alias("at"), F.col("high").alias("hi"), F.col("low").alias("lo"), leaves.alias("leaves"), "ts", "close")
    own = bars.select(*keys, F.floor(F.col("bar_idx") / block).cast("int").alias("_block"), bar.alias("b"), F.col("b.hi").alias("hi"), F.col("b.lo").alias("lo"))
    found = lambda rows: F.array_distinct(F.flatten(F.transform(rows, lambda x: x["leaves"])))
    blocks = own.groupBy(*keys, "_block").agg(F.sort_array(F.collect_list("b")).alias("_bars"), F.max("hi").alias("hi"), F.min("lo").alias("lo"))
    blocks = cut(blocks.withColumns({"leaves": found("_bars"), "_group": F.floor(F.col("_block") / group).cast("int"), "_last": F.element_at("_bars", -1)}))
    one = F.struct(F.col("_block").alias("at"), "hi", "lo", "leaves")
    groups = blocks.groupBy(*keys, "_group").agg(F.sort_array(F.collect_list(one)).alias("_blocks"), F.max("hi").alias("hi"), F.min("lo").alias("lo"), F.max_by("_last", "_block").alias("_last"))
    many = F.struct(F.col("_group").alias("at"), "hi", "lo", found("_blocks").alias("leaves"))
    series = groups.groupBy(*keys).agg(F.sort_array(F.collect_list(many)).alias("_groups"), F.max_by("_last", "_group").alias("_last"))
    later = lambda rows, at: F.filter(rows, lambda x: x["at"] > F.col(at))
    rows = blocks.drop("_last").join(groups.select(*keys, "_group", "_blocks"), [*keys, "_group"]).join(series, keys)
    return rows.select(*keys, "_block", "_bars", later("_blocks", "_block").alias("_blocks"), later("_groups", "_group").alias("_groups"), "_last"), groups.select(*keys, "_group", "_blocks")


def _reached(x: Column) -> Column:
    """Whether a bar, block or group reaches a level of the signal, or holds an exit that it names."""
    touched = (x["lo"] <= F.col("_below")) | (x["hi"] >= F.col("_above"))
    return F.coalesce(touched, F.lit(False)) | F.arrays_overlap(x["leaves"], F.col("_names"))


def _first(rows: str | Column, after: Column | None = None) -> Column:
    """The first that is reached, of those after a position."""
    keep = (lambda x: _reached(x)) if after is None else (lambda x: (x["at"] > after) & _reached(x))
    return F.get(F.filter(rows, keep), F.lit(0))


def with_exits(bars: DataFrame, entries: DataFrame, exits: str | None = None, block: int = BLOCK, group: int = GROUP) -> DataFrame:
    """``entries`` with ``_exit``: the first later bar that touches stop or target or holds a signal exit, as (at, ts, price).

    Null where there is none; ``_last`` is then the last bar of the series. The stop counts before the target, and
    both before a signal exit, which leaves at the close. ``exits`` names a column of ``bars`` with the signal
    exits that hold at a bar (``signal_exits``); of these, those in ``exit_rules`` count.
    """
    keys = series_keys(bars)
    blocks, groups = extremes(bars, exits, block, group)
    long = F.col("direction") == "LONG"
    names = F.transform("exit_rules", lambda n: F.concat_ws("/", n, F.col("direction"))) if exits else F.array().cast("array<string>")
    asked = entries.withColumns({"_below": F.when(long, F.col("stop")).otherwise(F.col("target")), "_above": F.when(long, F.col("target")).otherwise(F.col("stop")), "_names": names})
    left = F.struct(
        F.col("_hit.at").alias("at"), F.col("_hit.ts").alias("ts"),
        F.when(F.when(long, F.col("_hit.lo") <= F.col("stop")).otherwise(F.col("_hit.hi") >= F.col("stop")), F.col("stop"))
        .when(F.when(long, F.col("_hit.hi") >= F.col("target")).otherwise(F.col("_hit.lo") <= F.col("target")), F.col("target")).otherwise(F.col("_hit.close")).alias("price"),
    )
    hit = F.when(F.col("_hit").isNotNull(), left).alias("_exit")
    kept = [*asked.columns, "_last"]

    at_home = asked.withColumn("_block", F.floor(F.col("bar_idx") / block).cast("int")).join(blocks, [*keys, "_block"])
    at_home = at_home.withColumn("_hit", _first("_bars", F.col("bar_idx")))
    none = F.col("_hit").isNull()
    at_home = at_home.withColumn("_to", F.when(none, _first("_blocks")["at"])).withColumn("_far", F.when(none & F.col("_to").isNull(), _first("_groups")["at"]))
    at_home = cut(at_home.select(*kept, hit, "_to", "_far"))
    done = at_home.filter("_to IS NULL AND _far IS NULL").select(*kept, "_exit")
    far = at_home.filter("_far IS NOT NULL").drop("_to", "_exit").withColumnRenamed("_far", "_group").join(groups, [*keys, "_group"])
    far = far.select(*kept, _first("_blocks")["at"].alias("_block"))
    near = at_home.filter("_to IS NOT NULL").select(*kept, F.col("_to").alias("_block"))
    moved = near.unionByName(far).join(blocks.select(*keys, "_block", "_bars"), [*keys, "_block"]).withColumn("_hit", _first("_bars"))
    return done.unionByName(moved.select(*kept, hit)).drop("_below", "_above", "_names")


def _free_after(signals: Column | str, start: Column) -> Column:
    """When a walk over sorted signals that begins at bar ``start`` is free beyond all of them."""
    return F.aggregate(signals, start, lambda free, s: F.when(s["at"] >= free, s["free"]).otherwise(free))


def _taken(signals: str, start: Column, kind: str) -> Column:
    """The signals that such a walk takes."""
    nothing = F.struct(start.alias("free"), F.array().cast(kind).alias("taken"))
    return F.aggregate(signals, nothing, lambda acc, s: F.when(s["at"] >= acc["free"], F.struct(s["free"].alias("free"), F.concat(acc["taken"], F.array(s)).alias("taken"))).otherwise(acc))["taken"]


def one_at_a_time(signals: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """The signals that one position at a time enters, in each (strategy, series).

    ``signals`` has the TRADE_KEYS, ``at`` (the bar of entry), ``free`` (the first bar on which another entry may
    follow) and whatever else a trade needs, in the column ``trade``. The first signal is entered, then always the
    first one that is free.
    """
    keys = list(TRADE_KEYS)
    rows = signals.groupBy(*keys, F.floor(F.col("at") / segment).cast("int").alias("_seg")).agg(F.sort_array(F.collect_list(F.struct("at", "free", "trade"))).alias("_s"))
    rows = rows.withColumn("_out", F.array_distinct(F.transform("_s", lambda s: _free_after("_s", s["free"]))))
    rows = cut(rows)
    kind = dict(rows.dtypes)["_s"]
    if (rows.agg(F.max("_seg")).first()[0] or 0) == 0:
        return rows.select(*keys, F.inline(_taken("_s", F.lit(0), kind)))

    # The moments at which signals of other segments become free inside a segment, and where a walk from there ends up.
    inside = rows.select(*keys, F.explode("_out").alias("_in")).filter(F.col("_in") < NEVER).withColumn("_seg", F.floor(F.col("_in") / segment).cast("int"))
    inside = inside.groupBy(*keys, "_seg").agg(F.collect_set("_in").alias("_in"))
    rows = rows.join(inside, [*keys, "_seg"], "left")
    way = F.transform(F.coalesce("_in", F.array().cast("array<int>")), lambda f: F.struct(f.alias("at"), _free_after("_s", f).alias("to")))
    start = F.element_at("_s", 1)["at"]
    step = F.struct("_seg", start.alias("first"), _free_after("_s", start).alias("to"), way.alias("way"))
    steps = rows.select(*keys, step.alias("step")).groupBy(*keys).agg(F.sort_array(F.collect_list("step")).alias("steps"))
    # The walk: into every segment with the moment it is free, if that comes before the segment's end.
    none = F.struct(F.lit(0).alias("free"), F.array().cast("array<struct<_seg:int,_from:int>>").alias("path"))

    def walk(acc: Column, s: Column) -> Column:
        to = F.when(acc["free"] <= s["first"], s["to"]).otherwise(F.get(F.filter(s["way"], lambda w: w["at"] == acc["free"]), F.lit(0))["to"])
        entered = F.struct(to.alias("free"), F.concat(acc["path"], F.array(F.struct(s["_seg"].alias("_seg"), acc["free"].alias("_from")))).alias("path"))
        return F.when(acc["free"] < (s["_seg"] + 1) * segment, entered).otherwise(acc)

    path = steps.select(*keys, F.inline(F.aggregate("steps", none, walk)["path"]))
    return rows.drop("_in").join(path, [*keys, "_seg"]).select(*keys, F.inline(_taken("_s", F.col("_from"), kind)))


def positions(bars: DataFrame, signals: DataFrame, exits: str | None = None, block: int = BLOCK, group: int = GROUP, segment: int = SEGMENT) -> DataFrame:
    """The signals that one position at a time enters, with ``exit`` (null while open) and ``last``, the last bar of the series, as (at, ts, price).

    ``signals`` has strategy_id, the series keys, direction, stop, target, ``bar_idx``, after which an exit is looked
    for, and ``entry``, whatever is known of the entry. ``exits`` names a column of ``bars`` with the signal exits that
    hold at a bar; those in ``exit_rules`` of a signal count.
    """
    series = series_keys(bars)
    # Both sides may stem from one frame; aliases tell their columns apart.
    named = lambda df, *columns: df.select(*(F.col(c).alias(c) for c in columns))
    bars = named(bars, *series, "bar_idx", "ts", "high", "low", "close", *([exits] if exits else []))
    signals = named(signals, "strategy_id", *series, "bar_idx", "direction", "stop", "target", "entry", *(["exit_rules"] if exits else []))
    found = with_exits(bars, signals, exits, block, group)
    last = F.struct(F.col("_last.at").alias("at"), F.col("_last.ts").alias("ts"), F.col("_last.close").alias("price"))
    free = F.when(F.col("_exit").isNull(), F.lit(NEVER)).otherwise(F.col("_exit.at") + 1)
    trade = F.struct("direction", "stop", "target", "entry", F.col("_exit").alias("exit"), last.alias("last"))
    taken = one_at_a_time(found.select(*TRADE_KEYS, F.col("bar_idx").alias("at"), free.alias("free"), trade.alias("trade")), segment)
    return taken.select(*TRADE_KEYS, "trade.*")


def entry_of(signals: DataFrame) -> DataFrame:
    """Signals after the warm-up with ``entry``, the bar, time and price of an entry at their close."""
    return signals.filter(F.col("bar_idx") >= WARM_UP).withColumn("entry", F.struct(F.col("bar_idx").alias("at"), "ts", F.col("close").alias("price")))


def as_trades(taken: DataFrame) -> DataFrame:
    """Positions as trades; one that is open leaves at the last close."""
    end = F.coalesce("exit", "last")
    values = (F.col("entry.at"), end["at"], F.col("entry.ts"), end["ts"], F.col("direction"), F.col("entry.price"), end["price"])
    return with_pnl(taken.select(*TRADE_KEYS, *(v.alias(c) for c, v in zip(COLUMNS, values, strict=True))))


def scan_trades(bars: DataFrame, entries: DataFrame, exits: str | None = None, block: int = BLOCK, group: int = GROUP, segment: int = SEGMENT) -> DataFrame:
    """Trades of ``entries`` (with stop and target) over ``bars``, both with bar_idx and the series keys.

    One position at a time for each strategy and series, entered at the close of a signal bar after the warm-up
    and tested from the next bar on; no entry on the bar of an exit; a position open at the end leaves at the
    last close. ``exits``: see ``positions``.
    """
    return as_trades(positions(bars, entry_of(entries), exits, block, group, segment))


def with_pnl(trades: DataFrame) -> DataFrame:
    """Adds pnl and pnl_percent of the entry price, 0 where that is 0."""
    gain = F.when(F.col("direction") == "LONG", F.col("exit_price") - F.col("entry_price")).otherwise(F.col("entry_price") - F.col("exit_price"))
    return trades.withColumn("pnl", gain).withColumn("pnl_percent", F.coalesce(F.try_divide("pnl", "entry_price"), F.lit(0.0)) * 100)

