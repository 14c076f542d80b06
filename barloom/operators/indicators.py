"""Indicator columns: plain window frames, and recurrences by blocked scans.

A recurrence e[i] = q e[i-1] + z[i] is not a window function. Cut into blocks of B bars, e is a running
sum inside a block, scaled by powers of q, plus what the blocks before carry over; of those only the
last few matter, as q**B is tiny, unless q is 1, which makes e a running sum over the series. So a recurrence
is three window aggregations, of which those over all bars are partitioned by series and block or piece, and
one runs over the ends of blocks. What looks a few bars back works in pieces of a series.

A frame may begin anywhere in a series if it has a column ``_known``, the ``bar_idx`` of its last bar
whose recurrences are known; these then go on from there.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.columns import at_home, in_order, in_pieces, series_keys, typical_price, with_bar_idx

BLOCK = 128


@dataclass(frozen=True)
class Recurrence:
    """``name`` = the mean of ``value`` over bars first..seed at bar ``seed``, then q name[-1] + gain value."""

    name: str
    value: Column
    q: float
    first: int
    seed: int

    @property
    def gain(self) -> float:
        return 1 - self.q if self.q < 1 else 1.0


def block_size(recurrences: list[Recurrence]) -> int:
    """Bars of a block: powers of no q leave the range of doubles in it, and it holds all seeds."""
    most = min((int(250 / -math.log10(r.q)) for r in recurrences if 0 < r.q < 1), default=BLOCK)
    size = max(min(BLOCK, most), max(r.seed for r in recurrences) + 1)
    if size > most:
        raise ValueError("a long and a very short recurrence need scans of their own")
    return size


def smooth(bars: DataFrame, recurrences: list[Recurrence], size: int | None = None) -> DataFrame:
    """Adds a column for each recurrence; null before its seed. ``bars`` has ``bar_idx``, each bar once, or also ``_block``, blocks of ``size`` bars."""
    keys, size = series_keys(bars), size or block_size(recurrences)
    i, known = F.col("bar_idx"), "_known" in bars.columns
    rows = bars if "_block" in bars.columns else bars.withColumn("_block", F.floor(i / size).cast("int"))
    inside = Window.partitionBy(*keys, "_block").orderBy("bar_idx")
    terms = {}
    for r in recurrences:
        later = r.gain * (F.coalesce(r.value, F.lit(0.0)) if r.q == 1 else r.value)
        start = F.avg(r.value).over(inside.rowsBetween(r.first - r.seed, 0)) if r.seed else later
        term = F.when(i == r.seed, start).when(i > r.seed, later).otherwise(F.lit(0.0))
        if known:
            goes_on = F.when(i < F.col("_known"), F.lit(0.0)).when(i == F.col("_known"), F.coalesce(r.name, F.lit(0.0))).otherwise(later)
            term = F.when(F.col("_known") >= r.seed, goes_on).otherwise(term)
        terms[f"_z_{r.name}"] = term
    rows = rows.withColumns(terms).withColumn("_j", (i % size).cast("int"))
    so_far = inside.rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({f"_s_{r.name}": F.sum(F.col(f"_z_{r.name}") * F.pow(F.lit(r.q), -F.col("_j"))).over(so_far) for r in recurrences})
    ends = rows.groupBy(*keys, "_block").agg(F.max("_j").alias("_m"), *(F.max_by(f"_s_{r.name}", "_j").alias(f"_s_{r.name}") for r in recurrences))
    by_block = Window.partitionBy(*keys).orderBy("_block")  # one row for each block
    carried = {}
    for r in recurrences:
        end = F.col(f"_s_{r.name}") * F.pow(F.lit(r.q), F.col("_m"))  # of all blocks but the last, _m is size - 1
        if r.q == 1:
            carried[f"_c_{r.name}"] = F.coalesce(F.sum(end).over(by_block.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
            continue
        whole = r.q**size
        reach = max(1, math.ceil(45 / -math.log(whole)))
        before = F.collect_list(end).over(by_block.rowsBetween(-reach, -1))
        carried[f"_c_{r.name}"] = F.aggregate(before, F.lit(0.0), _fold(whole))
    ends = ends.select(*keys, "_block", *(c.alias(n) for n, c in carried.items()))
    rows = rows.join(ends, [*keys, "_block"])
    found = {}
    for r in recurrences:
        value = F.when(i >= r.seed, F.pow(F.lit(r.q), F.col("_j")) * (F.lit(r.q) * F.col(f"_c_{r.name}") + F.col(f"_s_{r.name}")))
        found[r.name] = F.when(i < F.col("_known"), F.col(r.name)).otherwise(value) if known else value
    return rows.select(*(c for c in bars.columns if c not in found), *(c.alias(n) for n, c in found.items()))


def _fold(factor: float):
    return lambda acc, x: acc * factor + x


def running(name: str, value: Column) -> Recurrence:
    """The sum of ``value`` over the bars so far; a null adds nothing."""
    return Recurrence(name, value, 1.0, 0, 0)


def ema_of(period: int, value: str = "close", name: str | None = None) -> Recurrence:
    return Recurrence(name or f"ema_{period}", F.col(value), (period - 1) / (period + 1), 0, period - 1)


def with_ema(bars: DataFrame, *periods: int) -> DataFrame:
    """Exponential averages of the close, seeded with the mean of the first ``period`` closes."""
    return smooth(bars, [ema_of(p) for p in periods])


def with_sma(bars: DataFrame, period: int, value: str = "close", name: str | None = None) -> DataFrame:
    """Mean of the last ``period`` values; null before there are as many."""
    rows = in_pieces(bars, period)
    mean = F.avg(value).over(in_order(rows).rowsBetween(-(period - 1), 0))
    return at_home(rows.withColumn(name or f"sma_{period}", F.when(F.col("bar_idx") >= period - 1, mean)))


def rsi_of(period: int) -> list[Recurrence]:
    """Averages of gains and losses; these are columns of ``with_changes``."""
    q = (period - 1) / period
    return [Recurrence("_up", F.col("_gain"), q, 1, period), Recurrence("_down", F.col("_loss"), q, 1, period)]


def atr_of(period: int) -> Recurrence:
    return Recurrence("_range", F.col("_tr"), (period - 1) / period, 0, period - 1)


def with_changes(bars: DataFrame, size: int) -> DataFrame:
    """Adds gain, loss and true range of each bar, whether another bar follows, and its ``_block``."""
    rows = in_pieces(bars, 1, 1, size)
    w = in_order(rows)
    change = F.col("close") - F.lag("close").over(w)
    rows = rows.withColumns({"_gain": F.greatest(change, F.lit(0.0)), "_loss": F.greatest(-change, F.lit(0.0)), "_tr": true_range(rows), "_more": F.lead("bar_idx").over(w).isNotNull(), "_block": F.col("_piece")})
    return at_home(rows, size)


def rsi_value() -> Column:
    strength = 100 - 100 / (1 + F.col("_up") / F.nullif(F.col("_down"), F.lit(0.0)))
    return F.when(F.col("_up").isNotNull(), F.when(F.col("_down") == 0, F.lit(100.0)).otherwise(strength))


def atr_value(period: int) -> Column:
    return F.when((F.col("bar_idx") >= period) | F.col("_more"), F.col("_range"))


def with_rsi(bars: DataFrame, period: int = 14) -> DataFrame:
    """Wilder's relative strength; 100 where there was no loss."""
    size = block_size(rsi_of(period))
    rows = smooth(with_changes(bars, size), rsi_of(period), size)
    return rows.withColumn(f"rsi_{period}", rsi_value()).select(*bars.columns, f"rsi_{period}")


def true_range(bars: DataFrame) -> Column:
    """The largest of high - low and the distances of both from the previous close; the first bar's is its range."""
    before = F.lag("close").over(in_order(bars))
    return F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - before), F.abs(F.col("low") - before))


def with_atr(bars: DataFrame, period: int = 14) -> DataFrame:
    """Wilder's average true range; null in a series of at most ``period`` bars."""
    size = block_size([atr_of(period)])
    rows = smooth(with_changes(bars, size), [atr_of(period)], size)
    return rows.withColumn(f"atr_{period}", atr_value(period)).select(*bars.columns, f"atr_{period}")


def vwap_of() -> list[Recurrence]:
    """Sums of volume and of volume times typical price."""
    return [running("_volume", F.col("volume")), running("_turnover", typical_price() * F.col("volume"))]


def vwap_value() -> Column:
    return F.when(F.col("_volume") > 0, F.col("_turnover") / F.col("_volume"))


def with_vwap(bars: DataFrame, session_zone: str | None = None) -> DataFrame:
    """Volume-weighted average price from the start of the series, or of each day in ``session_zone``; null while no volume."""
    if session_zone:
        day = F.to_date(F.from_utc_timestamp("ts", session_zone))
        w = Window.partitionBy(*series_keys(bars), day).orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
        volume = F.sum("volume").over(w)
        return bars.withColumn("vwap", F.when(volume > 0, F.sum(typical_price() * F.col("volume")).over(w) / volume))
    return smooth(bars, vwap_of()).withColumn("vwap", vwap_value()).select(*(c for c in bars.columns if c != "vwap"), "vwap")


def bands_of() -> list[Recurrence]:
    """Number, sum and sum of squares of the distances of close and vwap."""
    away = F.col("close") - F.col("vwap")
    return [running("_away_n", F.when(away.isNotNull(), 1.0)), running("_away", away), running("_away_2", away * away)]


def bands_value(width: float = 2.0) -> dict[str, Column]:
    n = F.nullif(F.col("_away_n"), F.lit(0.0))
    variance = F.col("_away_2") / n - F.pow(F.col("_away") / n, 2)
    # What is left of a variance of zero after rounding is none.
    variance = F.when(variance > 1e-12 * F.col("_away_2") / n, variance).otherwise(F.lit(0.0))
    spread = F.when(F.col("bar_idx") == 0, F.lit(0.0)).otherwise(F.coalesce(F.sqrt(variance), F.lit(0.0)))
    return {"vwap_upper": F.col("vwap") + width * spread, "vwap_lower": F.col("vwap") - width * spread}


def with_vwap_bands(bars: DataFrame, width: float = 2.0) -> DataFrame:
    """Bands of ``width`` population deviations of (close - vwap) so far around ``vwap``; of the first bar 0."""
    return smooth(bars, bands_of()).withColumns(bands_value(width)).select(*(c for c in bars.columns if c not in ("vwap_upper", "vwap_lower")), "vwap_upper", "vwap_lower")


def with_indicators(bars: DataFrame, emas: tuple[int, ...] = (9, 13, 21, 34), rsi: int | None = 14, atr: int | None = 14, vwap: bool = True, keep: bool = False) -> DataFrame:
    """The bundle that strategies use. Columns that nothing reads later are pruned by the optimizer.

    ``keep`` leaves the columns of the recurrences, from which a later frame of the series can go on.
    """
    rows = bars if "bar_idx" in bars.columns else with_bar_idx(bars)
    first = [*map(ema_of, emas), *(rsi_of(rsi) if rsi else []), *([atr_of(atr)] if atr else []), *(vwap_of() if vwap else [])]
    found = {**({f"rsi_{rsi}": rsi_value()} if rsi else {}), **({f"atr_{atr}": atr_value(atr)} if atr else {}), **({"vwap": vwap_value()} if vwap else {})}
    second = bands_of() if vwap else []
    kept = [c for c in rows.columns if c not in (*found, *(r.name for r in (*first, *second)), "vwap_upper", "vwap_lower")]
    if first:  # one scan for all
        size = block_size([*first, *second])
        rows = smooth(with_changes(rows, size), first, size).withColumns(found)
    if vwap:
        rows = smooth(rows, second, size).withColumns(bands_value())
    states = [r.name for r in (*first, *second) if r.name.startswith("_") and keep]
    return rows.select(*kept, *(f"ema_{p}" for p in emas), *found, *(("vwap_upper", "vwap_lower") if vwap else ()), *states)
