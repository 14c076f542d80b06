"""The research cycle as one plan: bars, windows, indicators, rules, trades, metrics, screen."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.functions.columns import with_bar_idx
from barloom.functions.lineage import cut
from barloom.operators.detectors import steady, with_fired
from barloom.operators.indicators import with_indicators
from barloom.operators.metrics import period_metrics
from barloom.operators.rules import detectors_of, entries, validate, with_signal_exits, with_unknown
from barloom.operators.screen import Limits, screen
from barloom.operators.trades import scan_trades, with_levels
from barloom.sources.bars import PERIODS, end_of, lookback, with_periods


def numbered(bars: DataFrame, periods: tuple[int, ...] = PERIODS, as_of: datetime | None = None, fired: list[str] | None = None) -> DataFrame:
    """Bars of every look-back window with their position. The bars are written down first, as several passes read them.

    ``fired`` names steady detectors, which are worked out on the bars of the widest window, each bar once, before it is
    copied to the windows that it lies in; see ``with_fired``.
    """
    bars = cut(bars)
    as_of = as_of or end_of(bars)
    if fired and as_of:
        bars = with_fired(with_bar_idx(lookback(bars, as_of, max(periods))), fired)
    elif fired:
        bars = bars.limit(0).withColumn("_fired", F.array().cast("array<bigint>"))
    windows = with_periods(bars, as_of, periods) if as_of else bars.selectExpr("*", "30 AS period_days").limit(0)
    return with_bar_idx(windows)


def prepared(bars: DataFrame, periods: tuple[int, ...] = PERIODS, as_of: datetime | None = None, emas: tuple[int, ...] = (9, 13, 21, 34)) -> DataFrame:
    """Bars of every look-back window with their position and indicators."""
    return with_indicators(numbered(bars, periods, as_of), emas)


def backtest(bars: DataFrame, strategies: DataFrame, rules: list[str], emas: list[tuple[int, int]], periods: tuple[int, ...] = PERIODS, as_of: datetime | None = None, zone: str = "Asia/Kolkata", compat: bool = False, exits: bool = False) -> DataFrame:
    """Trades of all strategies in all windows at once. ``rules`` are the distinct entry rules, ``emas`` the pairs of averages, that the strategies use.

    ``exits`` lets positions leave by the signal exits of their exit rules too. A strategy with a rule that
    is not in ``rules`` or unknown has no trades and stops no other.
    """
    fired = [] if compat else steady(detectors_of(rules))
    series = numbered(bars, periods, as_of, fired)
    ready = with_indicators(series, tuple(sorted({p for pair in emas for p in pair})))
    signals = with_levels(entries(ready, strategies, rules, emas, zone, compat, fired))
    if not exits:  # the scan itself needs no indicators
        return scan_trades(series, signals)
    return scan_with_exits(ready, signals, emas, zone)


def scan_with_exits(ready: DataFrame, signals: DataFrame, emas: list[tuple[int, int]], zone: str) -> DataFrame:
    """Trades that may also leave by signal exits; as these depend on a strategy's pair of averages, their names carry it."""
    names = F.transform("exit_rules", lambda n: F.concat_ws(":", F.col("pair"), n))
    return scan_trades(with_signal_exits(ready, emas, zone), signals.withColumn("exit_rules", names), "leaves")


def run_cycle(bars: DataFrame, strategies: DataFrame, rules: list[str], emas: list[tuple[int, int]], periods: tuple[int, ...] = PERIODS, as_of: datetime | None = None, limits: Limits | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(validated strategies, period results, screened strategies) of one research cycle.

    A sound strategy whose rules cannot all be evaluated is marked by ``unknown`` and left out.
    """
    checked = with_unknown(validate(strategies), rules)
    good = checked.filter("valid AND size(unknown) = 0")
    results = period_metrics(backtest(bars, good, rules, emas, periods, as_of), good, periods)
    return checked, results, screen(results, limits)
