"""Bar-pattern detectors: one boolean column per pattern, each an expression over earlier bars.

``detector(name, ...)`` registers a function of ``Bars`` that returns a Column; users add their own the
same way. Every detector is null-free: false before bar ``min_i`` (the true reach, so nothing is ever
read from before the series) and wherever a comparison meets a null. None reads a later bar.

Where bullish and bearish are mirror images, one function serves both: on ``Bars(mirrored=True)`` the
prices are negated and high and low change places, so a low is a high, up is down, and above is below.
Thresholds that are a share of a price are written with ``share``, which keeps its sign.

``array_detector(reach, ...)`` registers a function of numpy arrays instead, for what no expression can say. All such
detectors of a call run in one pass over the pieces of a series, and mix freely with the others.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StructField, StructType

from barloom.functions.columns import PRICES, at_home, in_order, in_pieces, series_keys, with_bar_idx

Rule = Callable[["Bars"], Column]
#: Bars from the start of a series whose range a detector asks for.
FIRST_BARS = 60


def any_of(conditions) -> Column:
    return reduce(lambda a, b: a | b, (F.coalesce(c, F.lit(False)) for c in conditions))


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then(value)`` with the value worked out once, however often it is used."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


class Bars:
    """Expressions over a bar and the bars before it; ``k`` counts back from the current bar (0)."""

    def __init__(self, frame: DataFrame, mirrored: bool = False):
        self.w, self.mirrored = in_order(frame), mirrored

    # Columns of a bar.
    @property
    def sign(self) -> int:
        return -1 if self.mirrored else 1

    @property
    def o(self) -> Column:
        return self.sign * F.col("open")

    @property
    def c(self) -> Column:
        return self.sign * F.col("close")

    @property
    def h(self) -> Column:
        return -F.col("low") if self.mirrored else F.col("high")

    @property
    def l(self) -> Column:  # noqa: E743
        return -F.col("high") if self.mirrored else F.col("low")

    @property
    def i(self) -> Column:
        return F.col("bar_idx")

    @property
    def body(self) -> Column:
        return F.abs(F.col("close") - F.col("open"))

    @property
    def rng(self) -> Column:
        return F.col("high") - F.col("low")

    @property
    def top(self) -> Column:
        return F.greatest(self.o, self.c)

    @property
    def bottom(self) -> Column:
        return F.least(self.o, self.c)

    @property
    def upper(self) -> Column:
        return self.h - self.top

    @property
    def lower(self) -> Column:
        return self.bottom - self.l

    @property
    def up(self) -> Column:
        return self.c > self.o

    @property
    def down(self) -> Column:
        return self.c < self.o

    # Of the bar before, as columns of this one; these may stand inside another window.
    @property
    def close_before(self) -> Column:
        return self.sign * F.col("_close_1")

    @property
    def low_before(self) -> Column:
        return -F.col("_high_1") if self.mirrored else F.col("_low_1")

    # Of the first bars of the series.
    @property
    def first_high(self) -> Column:
        return -F.col("_first_low") if self.mirrored else F.col("_first_high")

    # Other bars.
    def back(self, value: Column, k: int) -> Column:
        return F.lag(value, k).over(self.w) if k else value

    def over(self, value: Column, a: int, b: int) -> Column:
        """An aggregate over bars a..b, both relative to the current one."""
        return value.over(self.w.rowsBetween(a, b))

    def low(self, a: int, b: int) -> Column:
        return self.over(F.min(self.l), a, b)

    def high(self, a: int, b: int) -> Column:
        return self.over(F.max(self.h), a, b)

    def mean(self, value: Column, a: int, b: int) -> Column:
        return self.over(F.avg(value), a, b)

    def std(self, value: Column, a: int, b: int) -> Column:
        return self.over(F.stddev_pop(value), a, b)

    def share(self, price: Column, part: float) -> Column:
        """``part`` of a price's size, as a distance."""
        return F.abs(price) * part

    def window(self, n: int, **columns: Column) -> Column:
        """The n bars before the current one, oldest first, as an array of structs that also hold bar_idx as ``i``."""
        return self.over(F.collect_list(F.struct(self.i.alias("i"), *(c.alias(k) for k, c in columns.items()))), -n, -1)


@dataclass(frozen=True)
class Detector:
    rule: Rule
    min_i: int
    kind: str
    mirrored: bool = False
    #: How many bars back the rule looks: ``min_i``, or more where it also fires with fewer.
    reach: int = 0

    def column(self, frame: DataFrame) -> Column:
        bars = Bars(frame, self.mirrored)
        return F.coalesce(F.when(bars.i >= self.min_i, self.rule(bars)), F.lit(False))


#: All detectors by name, without the prefix ``detect_`` of the rules that ask for them.
DETECTORS: dict[str, Detector] = {}
#: Kinds by what a detector needs: earlier bars, extremes, means and deviations, some earlier bar, counts, positions of extremes, arrays.
KINDS = ("lag", "minmax", "avg_std", "exists", "count", "argmin", "array")


def detector(kind: str, min_i: int, *names: str, reach: int | None = None):
    """Registers a function under one name, or under a bullish and its mirrored bearish name.

    ``reach`` is how many bars back it looks if that is more than ``min_i``.
    """

    def register(rule: Rule) -> Rule:
        for name, mirrored in zip(names, (False, True), strict=False):
            DETECTORS[name] = Detector(rule, min_i, kind, mirrored, max(min_i, reach or 0))
        return rule

    return register


#: Kind of the detectors that are functions of numpy arrays.
ARRAYS = "python"


def array_detector(reach: int, *names: str):
    """Registers ``rule(bars)`` under one name, or under a bullish and its mirrored bearish name.

    ``bars`` holds numpy arrays of consecutive bars, oldest first: open, high, low, close and volume as doubles (NaN
    where null), ts, and bar_idx. The result is a boolean array, one for each bar. A bar's value may depend on
    it and up to ``reach`` bars before it: a long series comes in pieces with that many bars before each, and
    bars whose number is below ``reach`` are false whatever the rule says.
    """
    return detector(ARRAYS, reach, *names)


def _arrays_of(table, mirrored: bool) -> dict:
    """The columns of a piece as numpy arrays; mirrored prices are negated, and high and low change places."""
    import pyarrow.compute as pc

    own = {c: pc.fill_null(table[c].cast("double"), float("nan")).to_numpy() for c in PRICES}
    if mirrored:
        own |= {"open": -own["open"], "close": -own["close"], "high": -own["low"], "low": -own["high"]}
    return own | {"ts": table["ts"].to_numpy(), "bar_idx": table["bar_idx"].to_numpy()}


def _with_arrays(rows: DataFrame, names: list[str]) -> DataFrame:
    """Adds the array detectors to bars in pieces; a piece is a group of bounded size."""
    found = {n: DETECTORS[n] for n in names}

    def run(table):
        import numpy as np
        import pyarrow as pa

        table = table.sort_by("bar_idx")
        late = table["bar_idx"].to_numpy()
        for name, d in found.items():
            fired = np.asarray(d.rule(_arrays_of(table, d.mirrored)))
            if fired.dtype != bool or fired.shape != late.shape:
                raise TypeError(f"detector {name} must give {late.size} booleans, not {fired.dtype} of shape {fired.shape}")
            table = table.append_column(f"detect_{name}", pa.array(fired & (late >= d.min_i)))
        return table

    schema = StructType([*rows.schema.fields, *(StructField(f"detect_{n}", BooleanType()) for n in names)])
    return rows.groupBy(*series_keys(rows)).applyInArrow(run, schema)


def pair(name: str) -> tuple[str, str]:
    return f"{name}_bullish", f"{name}_bearish"


def reach_of(names: list[str]) -> int:
    """How many bars back these detectors look at most; one of them is asked of the bar before too."""
    return max((DETECTORS[n].reach for n in names), default=0) + 1


def with_first_bars(bars: DataFrame) -> DataFrame:
    """Adds the highest high and lowest low of the first FIRST_BARS bars of each series, as far as they are there."""
    keys = [k for k in series_keys(bars) if k != "_piece"]
    first = bars.filter(F.col("bar_idx") < FIRST_BARS).groupBy(*keys).agg(F.max("high").alias("_first_high"), F.min("low").alias("_first_low"))
    same = [F.col(f"b.{k}").eqNullSafe(F.col(f"f.{k}")) for k in keys]
    return bars.alias("b").join(first.alias("f"), same, "left").select("b.*", "f._first_high", "f._first_low")


def with_detectors(bars: DataFrame, names: list[str], batch: int = 40, piece: int | None = None) -> DataFrame:
    """Adds ``detect_<name>`` columns in batches, so that no generated method grows too large.

    Bars are worked on in pieces, each with as many bars before it as the detectors look back, unless they
    are in pieces already.
    """
    rows = bars if "bar_idx" in bars.columns else with_bar_idx(bars)
    kept = [*rows.columns, *(f"detect_{n}" for n in names)]
    if "_first_high" not in rows.columns and {*pair("defining_range")} & {*names}:
        rows = with_first_bars(rows)
    whole = "_piece" not in rows.columns
    if whole:
        rows = in_pieces(rows, reach_of(names), size=piece)
    arrays = [n for n in names if DETECTORS[n].kind == ARRAYS]
    if arrays:
        rows = _with_arrays(rows, arrays)
    names = [n for n in names if n not in arrays]
    b = Bars(rows)
    rows = rows.withColumns({"_close_1": b.back(F.col("close"), 1), "_low_1": b.back(F.col("low"), 1), "_high_1": b.back(F.col("high"), 1), "_body_5": b.mean(b.body, -5, -1)})
    for at in range(0, len(names), batch):
        rows = rows.withColumns({f"detect_{n}": DETECTORS[n].column(rows) for n in names[at : at + batch]})
    return (at_home(rows, piece) if whole else rows).select(*kept)


#: Detectors that ask for a bar's place in its series or for the first bars of that, so they differ between windows of one series.
PLACED = (*pair("quarterly_shift"), *pair("macro_cycle"), *pair("defining_range"))
#: Bits of a word of ``_fired`` that are used.
WORD = 60


def steady(names: list[str]) -> list[str]:
    """Those of the detectors that depend only on a bar and the ``min_i`` bars before it, whatever window of the series holds them."""
    return [n for n in names if n not in PLACED and DETECTORS[n].kind != ARRAYS and DETECTORS[n].reach == DETECTORS[n].min_i]


def with_fired(bars: DataFrame, names: list[str], piece: int | None = None) -> DataFrame:
    """Adds ``_fired``, which of the steady detectors ``names`` hold at a bar, a bit each in an array of words.

    Worked out once on a series, it holds in every window of it: ``fired_in`` leaves out the bars that have
    too few before them there.
    """
    rows = with_detectors(bars, names, piece=piece)
    bits = [F.shiftleft(F.col(f"detect_{n}").cast("long"), k % WORD) for k, n in enumerate(names)]
    words = [reduce(lambda a, b: a.bitwiseOR(b), bits[at : at + WORD]) for at in range(0, len(bits), WORD)]
    return rows.withColumn("_fired", F.array(*words)).drop(*(f"detect_{n}" for n in names))


def fired_in(rows: DataFrame, names: list[str]) -> DataFrame:
    """``detect_<name>`` columns of a window's bars from their ``_fired``, which ``with_fired`` made of the same names, and ``bar_idx``."""
    bit = lambda k: F.get("_fired", F.lit(k // WORD)).bitwiseAND(F.lit(1 << k % WORD)) != 0
    return rows.withColumns({f"detect_{n}": bit(k) & (F.col("bar_idx") >= DETECTORS[n].min_i) for k, n in enumerate(names)})


# --- Earlier bars at fixed distances -------------------------------------------------------------


@detector("lag", 1, "bullish_engulfing", "bearish_engulfing")
def _engulfing(b):
    return b.back(b.down, 1) & b.up & (b.o < b.back(b.c, 1)) & (b.c > b.back(b.o, 1))


@detector("lag", 1, "inside_bar")
def _inside(b):
    return (b.h < b.back(b.h, 1)) & (b.l > b.back(b.l, 1))


@detector("lag", 2, "morning_star")
def _morning_star(b):
    half = b.back((b.o + b.c) / 2, 2)
    return b.back(b.down, 2) & (b.back(b.body, 1) <= 0.6 * b.back(b.body, 2)) & b.up & (b.c > half)


@detector("lag", 0, "bullish_pin_bar")
def _pin_bar(b):
    return (b.lower >= 2 * b.body) & (b.upper <= b.body) & (b.rng > 0)


@detector("lag", 2, "bullish_imbalance", "bearish_imbalance")
def _imbalance(b):
    return b.l - b.back(b.h, 2) > b.share(b.c, 0.0002)


@detector("lag", 1, "bullish_order_block", "bearish_order_block")
def _order_block(b):
    return b.back(b.down, 1) & b.up & (b.body > 2 * b.back(b.body, 1))


@detector("lag", 1, *pair("rejection_block_v1"))
def _rejection_v1(b):
    return (b.back(b.rng, 1) != 0) & (b.back(b.lower, 1) > 0.5 * b.back(b.rng, 1)) & b.up


@detector("lag", 1, "volume_imbalance_v1_bullish", "volume_imbalance_v1_bearish")
def _volume_imbalance_v1(b):
    return F.abs(b.o - b.back(b.c, 1)) > 0


@detector("lag", 3, *pair("propulsion_block"))
def _propulsion_block(b):
    return b.back(b.up, 1) & b.back(b.up, 2) & (b.back(b.o, 1) > b.back((b.o + b.c) / 2, 2))


@detector("lag", 3, "balanced_price_range")
def _balanced_range(b):
    top, bottom = F.least(b.back(b.h, 2), b.back(b.h, 1)), F.greatest(b.back(b.l, 2), b.back(b.l, 1))
    return b.back(b.up, 2) & b.back(b.down, 1) & (top > bottom) & b.c.between(bottom, top)


@detector("lag", 2, "silver_bullet_bullish", reach=3)
def _silver_bullet_up(b):
    low, high = F.coalesce(b.back(b.h, 3), F.lit(0.0)), b.back(b.l, 1)
    return (high > low) & (b.l <= high) & (b.c >= low)


@detector("lag", 3, "silver_bullet_bearish")
def _silver_bullet_down(b):
    high, low = b.back(b.l, 3), b.back(b.h, 1)
    return (low < high) & (b.h >= low) & (b.c <= high)


@detector("lag", 10, *pair("reclaimed_block"))
def _reclaimed_block(b):
    level = b.back(b.h, 5)
    return (b.back(b.c, 2) > level) & (b.l <= level) & (level <= b.c)


@detector("lag", 5, *pair("order_flow_entry"))
def _order_flow(b):
    last = F.coalesce(*(F.when(b.back(b.down, k), b.back(b.l, k)) for k in (1, 2, 3)))
    return (b.l > last) & b.up


@detector("lag", 1, *pair("quarterly_shift"))
def _quarterly_shift(b):
    return (b.i % 24 == 0) & (b.c > b.back(b.c, 1))


@detector("lag", 30, "power_of_3_swing_bullish")
def _power_of_3_up(b):
    return (b.c < b.back(b.o, 30)) & (b.c > b.back(b.c, 1)) & b.back(b.down, 1)


@detector("lag", 30, "power_of_3_swing_bearish")
def _power_of_3_down(b):
    return (b.c > b.back(b.o, 30)) & (b.c < b.back(b.c, 1))


@detector("lag", 2, *pair("institutional_swing_point"))
def _swing_point(b):
    return (b.back(b.l, 1) < b.back(b.l, 2)) & (b.back(b.l, 1) < b.l)


@detector("lag", 0, *pair("macro_cycle"))
def _macro_cycle(b):
    return (b.i % 60).between(50, 59)


@detector("lag", 4, *pair("liquidity_run"))
def _liquidity_run(b):
    return (b.back(b.l, 1) < b.back(b.l, 2)) & (b.back(b.l, 2) < b.back(b.l, 3)) & (b.l > b.back(b.l, 1))


@detector("lag", 3, *pair("stops_hunt"))
def _stops_hunt(b):
    return (b.l < b.back(b.l, 2)) & (b.c > b.back(b.l, 2)) & b.up


@detector("lag", 10, *pair("fractal_expansion"))
def _fractal_expansion(b):
    peak = b.back(b.h, 5)
    return (peak > b.back(b.h, 6)) & (peak > b.back(b.h, 4)) & (b.c > peak) & (b.back(b.c, 1) <= peak)


@detector("lag", 50, *pair("daily_open_rejection"))
def _daily_open(b):
    return (b.l <= b.back(b.o, 50)) & (b.c > b.back(b.o, 50)) & b.up


@detector("lag", 10, *pair("swing_failure_pattern"))
def _swing_failure(b):
    pit = b.back(b.l, 5)
    return (pit < b.back(b.l, 6)) & (pit < b.back(b.l, 4)) & (b.l < pit) & (b.c > pit)


@detector("lag", 0, "psychological_level_rejection_bullish")
def _level_up(b):
    level = F.floor(b.c.cast("bigint") / 50) * 50
    return (b.l < level) & (b.c > level)


@detector("lag", 0, "psychological_level_rejection_bearish")
def _level_down(b):
    level = F.floor(b.c.cast("bigint") / 50) * 50 + 50
    return (b.h > level) & (b.c < level)


@detector("lag", 10, *pair("trendline_liquidity_build"))
def _trendline(b):
    two, four = b.back(b.l, 2), b.back(b.l, 4)
    return (b.l > two) & (two > four) & (F.abs((b.l - two) - (two - four)) < b.share(b.l, 0.0005))


@detector("lag", 5, *pair("decoupled_ob"))
def _decoupled(b):
    return b.back(b.up, 3) & (b.l < b.back(b.l, 3)) & (b.c > b.back(b.l, 3))


@detector("lag", 2, *pair("propulsion_candle"))
def _propulsion_candle(b):
    half = b.back(b.o + 0.5 * (b.c - b.o), 1)
    return b.back(b.up, 1) & (half < b.o) & (b.o < b.back(b.c, 1)) & b.up


@detector("lag", 10, *pair("balanced_price_range"))
def _balanced_pair(b):
    inner = b.back(b.o + 0.5 * b.body, 1)
    return b.back(b.up, 1) & b.back(b.down, 2) & (b.back(b.c, 1) > b.back(b.o, 2)) & (b.back(b.o, 1) < b.back(b.c, 2)) & (b.l < inner) & (b.c > b.l)


@detector("lag", 2, *pair("three_candle_reversal"))
def _three_candles(b):
    return b.back(b.down, 2) & (b.back(b.body, 1) < b.back(b.body, 2)) & b.up & (b.c > b.back(b.o, 2))


# --- Extremes of earlier bars --------------------------------------------------------------------


@detector("minmax", 20, "breakout_up", "breakout_down")
def _breakout(b):
    return b.c > b.high(-20, -1)


@detector("minmax", 20, "liquidity_sweep_low", "liquidity_sweep_high")
@detector("minmax", 20, *pair("turtle_soup_v1"))
def _sweep(b):
    return (b.l < b.low(-20, -1)) & (b.c > b.low(-20, -1))


@detector("minmax", 10, *pair("inducement_v1"))
def _inducement_v1(b):
    return (b.l < b.low(-10, -1)) & (b.c > b.low(-10, -1))


@detector("minmax", 50, "discount_zone", "premium_zone")
def _discount(b):
    return b.c < (b.high(-50, -1) + b.low(-50, -1)) / 2


@detector("minmax", 10, *pair("choch"))
def _choch(b):
    return (b.back(b.c, 1) < b.high(-5, -1)) & (b.c > b.high(-5, -1))


@detector("minmax", 10, *pair("mitigation_block"))
def _mitigation(b):
    base = b.back(b.l, 2)
    return (base > b.back(b.l, 5)) & (b.back(b.c, 1) > b.high(-5, -3)) & (b.l <= base + b.share(base, 0.001)) & (b.c > base)


@detector("minmax", 15, *pair("amd"))
def _amd(b):
    start = b.back(b.o, 15)
    return (b.low(-15, -1) < start - b.share(start, 0.002)) & (b.c > start)


@detector("minmax", 25, *pair("turtle_soup"))
def _turtle_soup(b):
    return (b.l < b.low(-21, -2)) & (b.c > b.low(-21, -2))


@detector("minmax", 10, *pair("opening_gap_reclaim"))
def _gap_reclaim(b):
    return (b.over(F.min(b.c), -5, -1) < b.back(b.o, 10)) & (b.c > b.back(b.o, 10))


@detector("minmax", 20, "range_rotation_bullish")
def _rotation_up(b):
    low, high = b.low(-20, -1), b.high(-20, -1)
    return (F.try_divide(b.c - low, high - low) < 0.10) & (b.c > b.back(b.c, 1))


@detector("minmax", 20, "range_rotation_bearish")
def _rotation_down(b):
    low, high = b.low(-20, -1), b.high(-20, -1)
    return (F.try_divide(b.c - low, high - low) > 0.90) & (b.c < b.back(b.c, 1))


@detector("minmax", 30, *pair("standard_deviation_projection"))
def _projection(b):
    low, high = b.low(-30, -11), b.high(-30, -11)
    return (high != low) & (b.l <= low - (high - low)) & (b.c > b.back(b.c, 1))


@detector("minmax", 15, *pair("smt_divergence"))
def _smt(b):
    return (b.l < b.low(-10, -2)) & b.up


@detector("minmax", 50, *pair("equilibrium_reclaimed"))
def _equilibrium(b):
    middle = (b.high(-50, -1) + b.low(-50, -1)) / 2
    return (b.back(b.c, 1) < middle) & (b.c > middle)


@detector("minmax", 61, *pair("initial_balance_breakout"))
def _initial_balance(b):
    return (b.c > b.high(-60, -1)) & (b.back(b.c, 1) <= b.high(-60, -1))


@detector("minmax", 31, *pair("opening_range_breakout"))
def _opening_range(b):
    return (b.c > b.high(-30, -1)) & (b.back(b.c, 1) <= b.high(-30, -1))


@detector("minmax", 200, *pair("pwh_pwl_sweep"))
def _week_sweep(b):
    return b.l < b.low(-200, -11)


@detector("minmax", 75, *pair("pdh_pdl_sweep"))
def _day_sweep(b):
    return b.l < b.low(-75, -11)


@detector("minmax", 20, *pair("failed_auction"))
def _failed_auction(b):
    return (b.l < b.low(-20, -6)) & (b.body < 0.3 * b.back(b.rng, 14))


@detector("minmax", 20, *pair("amd_setup"))
def _amd_setup(b):
    return (b.l < b.low(-15, -2)) & (b.c > b.low(-15, -2))


@detector("minmax", 20, *pair("ote_entry"))
def _ote_entry(b):
    low, high = b.low(-20, -6), b.high(-20, -6)
    depth = high - low
    return (depth > 0) & b.c.between(low + (1 - 0.79) * depth, low + (1 - 0.62) * depth) & (b.c > b.l)


@detector("minmax", 70, *pair("defining_range"))
def _defining_range(b):
    return (b.c > b.first_high) & (b.back(b.c, 1) <= b.first_high)


@detector("minmax", 60, *pair("cpr_range"))
def _cpr_range(b):
    high, low, close = b.high(-60, -11), b.low(-60, -11), b.back(b.c, 11)
    pivot, bottom = (high + low + close) / 3, (high + low) / 2
    top = 2 * pivot - bottom
    return (b.l <= F.greatest(bottom, top)) & (b.c > F.least(bottom, top)) & (b.c > b.back(b.c, 1))


@detector("minmax", 5, "poor_high_low_bullish", "poor_high_low_bearish")
def _poor_high(b):
    return (b.h >= b.high(-5, -1)) & (F.try_divide(b.upper, b.body) < 0.05)


@detector("minmax", 20, *pair("tails"))
def _tails(b):
    return (b.l <= b.low(-20, -1)) & (b.lower > 2 * b.body) & (b.lower > 0)


@detector("minmax", 20, "wyckoff_spring_bullish", "wyckoff_upthrust_bearish")
def _spring(b):
    floor = b.low(-20, -6)
    return ((b.back(b.l, 1) < floor) | (b.l < floor)) & (b.c > floor) & (b.c > b.back(b.c, 1))


@detector("minmax", 15, "wyckoff_lps_bullish")
def _lps(b):
    level = b.high(-15, -6)
    return (b.back(b.c, 3) > level) & b.l.between(0.998 * level, 1.01 * level) & (b.c > b.back(b.c, 1))


@detector("minmax", 15, "wyckoff_lpsy_bearish")
def _lpsy(b):
    level = b.low(-15, -6)
    return (b.back(b.c, 3) < level) & b.h.between(0.99 * level, 1.002 * level) & (b.c < b.back(b.c, 1))


# --- Means and deviations ------------------------------------------------------------------------


@detector("avg_std", 20, "volatility_squeeze")
def _squeeze(b):
    return b.rng < 0.5 * b.mean(b.rng, -20, -1)


@detector("avg_std", 20, *pair("snap_back"))
def _snap_back(b):
    middle = b.mean(b.c, -20, -1)
    return (b.c < middle - b.share(middle, 0.005)) & (b.c > b.back(b.c, 1))


@detector("avg_std", 15, *pair("momentum_impulse"))
def _impulse(b):
    return (b.body > 2 * b.mean(b.rng, -14, -1)) & b.up


@detector("avg_std", 15, "compression_liquidity_bullish", "compression_liquidity_bearish")
def _compression(b):
    return (b.h < b.back(b.h, 5)) & (b.mean(b.rng, -5, -1) < 0.7 * b.mean(b.rng, -15, -11))


@detector("avg_std", 15, *pair("master_pattern"))
def _master(b):
    return (b.std(b.c, -3, -1) > 2 * b.std(b.c, -15, -4)) & (b.c > b.back(b.c, 3))


@detector("avg_std", 15, *pair("judas_swing"))
def _judas(b):
    return (b.back(b.o - b.c, 1) > 2 * b.std(b.c, -10, -3)) & b.up & (b.c > b.back(b.o, 1))


@detector("avg_std", 50, *pair("value_area"))
def _value_area(b):
    level = b.mean(b.c, -50, -1) - 0.7 * b.std(b.c, -50, -1)
    return (b.l <= level) & (b.c > level)


@detector("avg_std", 30, *pair("dist_accum"))
def _accumulation(b):
    floor = b.low(-30, -3)
    return (b.std(b.c, -10, -3) < b.std(b.c, -30, -11)) & (b.back(b.l, 1) < floor) & (b.c > b.back(b.c, 1)) & (b.c > floor)


@detector("avg_std", 10, "wyckoff_sos_bullish", "wyckoff_sow_bearish")
def _strength(b):
    return (b.c - b.o > 2 * b.mean(b.body, -10, -2)) & (b.c > b.back(b.h, 1))


@detector("avg_std", 10, *pair("effort_vs_result"))
def _effort(b):
    return (b.rng > 2 * b.mean(b.rng, -10, -2)) & (b.body < 0.3 * b.rng) & (b.c > b.l + 0.6 * b.rng)


@detector("avg_std", 10, *pair("stopping_volume"))
def _stopping(b):
    return (b.back(b.o - b.c, 1) > 2 * b.mean(b.rng, -10, -3)) & (b.rng < 0.5 * b.back(b.rng, 1)) & (b.l >= b.back(b.l, 1)) & b.up


@detector("avg_std", 10, "vsa_no_supply_bullish", "vsa_no_demand_bearish")
def _no_supply(b):
    return b.down & (b.rng < 0.7 * b.mean(b.rng, -3, -1)) & (b.l <= b.low(-10, -1))


@detector("avg_std", 10, "vsa_shakeout_bullish", "vsa_shakeout_bearish")
def _shakeout(b):
    return (b.rng > 1.5 * b.mean(b.rng, -5, -2)) & (b.l < b.low(-10, -3)) & (b.c > b.l + 0.7 * b.rng)


@detector("avg_std", 20, "selling_climax_bullish", "buying_climax_bearish")
def _climax(b):
    return (b.back(b.c, 1) < b.mean(b.c, -20, -2)) & (b.rng > 2.5 * b.mean(b.rng, -10, -2)) & (b.lower > 0.4 * b.rng)


# --- Some earlier bar ----------------------------------------------------------------------------


def _broken_block(b, reach: int) -> Column:
    """A down bar k back whose high was passed since by a thousandth, and which the current bar tests from above."""
    return any_of(
        b.back(b.down, k) & (b.high(-(k - 1), -1) > b.back(b.h + b.share(b.h, 0.001), k)) & (b.l <= b.back(b.h, k)) & (b.c >= b.back(b.o, k))
        for k in range(2, reach)  # between the last bar and this one lies none that could pass it
    )


@detector("exists", 10, "bullish_breaker", "bearish_breaker")
def _breaker(b):
    return _broken_block(b, 10)


@detector("exists", 15, *pair("mitigation_block_v1"))
def _mitigation_v1(b):
    return _broken_block(b, 15)


@detector("exists", 10, *pair("unicorn_model"))
def _unicorn(b):
    return _broken_block(b, 10) & any_of(b.back(b.l, k) > b.back(b.h, k + 2) for k in (1, 2, 3))


@detector("exists", 5, *pair("inverted_fvg"))
def _inverted_gap(b):
    fall = lambda k: b.back(b.c < b.o - b.share(b.o, 0.002), k)
    return any_of(fall(k) & (b.c > b.back(b.h, k)) & (b.l <= b.back(b.h + b.share(b.h, 0.001), k)) for k in range(1, 5))


@detector("exists", 9, *pair("rejection_block"))
def _rejection(b):
    long_wick = lambda k: b.back(b.lower > 1.5 * b.body, k)
    return any_of(long_wick(k) & (b.back(b.l, k) < b.l) & (b.l < b.back(b.bottom, k)) & (b.c > b.l) for k in range(1, 10))


def _usual_body(b, k: int) -> Column:
    return b.mean(b.body, -k - 5, -k - 1)


@detector("exists", 10, *pair("liquidity_void"))
def _liquidity_void(b):
    return any_of(b.back(b.up, k) & (b.back(b.body, k) > 3 * _usual_body(b, k)) & (b.back(b.o, k) < b.l) & (b.l < b.back(b.c, k)) for k in range(1, 6))


@detector("exists", 10, *pair("volume_imbalance"))
def _volume_imbalance(b):
    low, high = (lambda k: b.back(b.bottom, k)), (lambda k: b.back(b.top, k + 1))
    return any_of((low(k) > high(k)) & (b.l <= (low(k) + high(k)) / 2) & (b.c > b.l) for k in range(1, 10))


@detector("exists", 5, "mean_threshold_retest_bullish")
def _threshold_up(b):
    middle = lambda k: b.back((b.h + b.l) / 2, k)
    return any_of(b.back(b.up & (b.rng != 0), k) & (b.l <= middle(k)) & (middle(k) <= b.c) for k in range(1, 5))


@detector("exists", 5, "mean_threshold_retest_bearish")
def _threshold_down(b):
    middle = lambda k: b.back((b.h + b.l) / 2, k)
    return any_of(b.back(b.down, k) & (b.c <= middle(k)) & (middle(k) <= b.h) for k in range(1, 5))


@detector("exists", 4, *pair("wick_consequent_encroachment"))
def _wick_half(b):
    return any_of(b.back((b.rng > 0) & (b.lower > 0.4 * b.rng), k) & (b.l <= b.back(b.l + 0.5 * b.lower, k)) for k in range(1, 5))


@detector("exists", 9, *pair("sponsor_candle"))
def _sponsor(b):
    return any_of(b.back(b.up, k) & (b.back(b.body, k) > 2.5 * _usual_body(b, k)) & (b.l <= b.back(b.h, k)) & (b.c >= b.back(b.l, k)) for k in range(1, 5))


@detector("exists", 10, "partial_void_fill_bullish")
def _void_fill_up(b):
    middle = lambda k: b.back((b.o + b.c) / 2, k)
    return any_of(b.back(b.up, k) & (b.back(b.c - b.o, k) > 2 * b.mean(b.rng, -k - 5, -k - 1)) & (b.l <= middle(k)) & (middle(k) <= b.c) for k in range(1, 6))


@detector("exists", 10, "partial_void_fill_bearish")
def _void_fill_down(b):
    middle = lambda k: b.back((b.o + b.c) / 2, k)
    return any_of(b.back(b.down, k) & (b.c <= middle(k)) & (middle(k) <= b.h) for k in range(1, 6))


@detector("exists", 11, *pair("inverse_fvg"))
def _inverse_gap(b):
    def one(k):
        top, bottom = b.back(b.l, k + 2), b.back(b.h, k)
        return (top > bottom) & (b.over(F.max(b.c), -(k - 1), -1) > top) & (b.l <= top) & (b.c >= bottom) & (b.c > b.back(b.c, 1))

    return any_of(one(k) for k in range(2, 10))


@detector("exists", 14, *pair("single_prints"))
def _single_prints(b):
    run = lambda k: b.back(b.c - b.o, k)
    return any_of((run(k) > 0) & (run(k) > 3 * _usual_body(b, k)) & (b.l <= b.back(b.c, k)) & (b.c >= b.back(b.o, k)) & b.up for k in range(2, 10))


# --- Counts --------------------------------------------------------------------------------------


def _count(conditions) -> Column:
    return reduce(lambda a, c: a + F.coalesce(c, F.lit(False)).cast("int"), conditions, F.lit(0))


@detector("count", 20, *pair("engineered_liquidity"))
def _engineered(b):
    near = ((b.l < b.back(b.l, k)) & (b.back(b.l, k) < b.l + b.share(b.l, 0.001)) for k in range(1, 20))
    return (_count(near) >= 2) & (b.c > b.l)


@detector("count", 10, *pair("composite_operator"))
def _composite(b):
    near = (F.abs(b.back(b.l, k) - b.l) < b.share(b.l, 0.0005) for k in range(1, 10))
    return (_count(near) >= 2) & (b.c > b.back(b.c, 1))


# --- Positions of extremes -----------------------------------------------------------------------


def _first_low(b, a: int, z: int) -> Column:
    """Bar number of the first lowest low in bars a..z."""
    return b.over(F.min(F.struct(b.l.alias("v"), b.i.alias("i"))), a, z)["i"]


def _highest_since(b, n: int, start: Column) -> Column:
    """The highest high of bars start.. up to the last one, within the last n."""
    later = F.filter(b.window(n, h=b.h), lambda x: x["i"] >= start)
    return F.array_max(F.transform(later, lambda x: x["h"]))


@detector("argmin", 20, "market_structure_shift_bullish", "market_structure_shift_bearish")
def _structure_shift(b):
    pit = _first_low(b, -20, -1)
    return (pit <= b.i - 3) & (b.c > _highest_since(b, 20, pit))


@detector("argmin", 20, "optimal_trade_entry_long", "optimal_trade_entry_short")
def _optimal_entry(b):
    pit, high = _first_low(b, -20, -1), _highest_since(b, 20, _first_low(b, -20, -1))
    depth = high - b.low(-20, -1)
    far = high - 0.786 * depth
    return (pit <= b.i - 2) & (depth != 0) & (b.l >= far - b.share(far, 0.001)) & (b.l <= high - 0.618 * depth) & (b.c > b.l)


# --- Arrays of earlier bars ----------------------------------------------------------------------


@detector("array", 10, *pair("inducement"))
def _inducement(b):
    pits = (F.when((b.back(b.l, k) < b.back(b.l, k + 1)) & (b.back(b.l, k) < b.back(b.l, k - 1)), b.back(b.l, k)) for k in (5, 4, 3, 2))
    pit = F.coalesce(*pits)
    return (b.l < pit) & (b.c > pit)


@detector("array", 50, "nwog_bullish", "nwog_bearish")
def _weekly_gap(b):
    before = b.close_before
    gap = F.struct(F.greatest(b.o, before).alias("top"), F.least(b.o, before).alias("bottom"), (F.abs(b.o - before) > b.share(before, 0.0005)).alias("real"))
    gaps = b.over(F.collect_list(gap), -49, -1)
    return F.exists(gaps, lambda g: g["real"] & (b.l <= g["top"]) & (b.h >= g["bottom"])) & (b.c > b.l)


@detector("array", 24, *pair("volume_void"))
def _volume_void(b):
    rise = b.c - b.o
    run = F.struct((rise > 3 * F.col("_body_5")).alias("real"), (b.o + 0.5 * rise).alias("half"))
    runs = b.over(F.collect_list(run), -19, -1)
    return F.exists(runs, lambda r: r["real"] & (b.l <= r["half"]) & (r["half"] <= b.c))


def _least(array: Column, value: str, latest: bool = False) -> Column:
    """Struct (v, n, i) of the smallest ``value``: the first of equal ones, or the latest."""
    return F.array_min(F.transform(array, lambda x: F.struct(x[value].alias("v"), ((-1 if latest else 1) * x["i"]).alias("n"), x["i"].alias("i"))))


def _span(array: Column, start: Column, stop: Column) -> Column:
    """The bars start <= i < stop of an array of bars."""
    return F.filter(array, lambda x: (x["i"] >= start) & (x["i"] < stop))


@detector("array", 20, *pair("dragon_pattern"), reach=29)
def _dragon(b):
    bars = b.window(29, l=b.l, neg=-b.c)

    def judge(right, hump, left):
        ratio = F.try_divide(right["v"], left["v"])
        return (ratio > 0.98) & (ratio < 1.02) & (b.c > -hump["v"])

    pit = lambda start, stop, value, latest=False: _least(_span(bars, start, stop), value, latest)
    return let(
        pit(b.i - 9, b.i, "l", True),
        lambda right: let(pit(right["i"] - 10, right["i"], "neg"), lambda hump: let(pit(hump["i"] - 10, hump["i"], "l"), lambda left: judge(right, hump, left))),
    )


@detector("array", 25, *pair("quasimodo_pattern"), reach=37)
def _quasimodo(b):
    # Whether a low is a strict local one shows a bar later, so each bar carries its predecessors along.
    flagged = F.struct(b.i.alias("i"), b.l.alias("l"), b.h.alias("h"), b.low_before.alias("before"))
    bars = b.over(F.collect_list(flagged), -36, -1)
    after = F.transform(bars, lambda x, k: F.struct(x["i"].alias("i"), x["l"].alias("l"), x["h"].alias("h"), x["before"].alias("before"), F.get(bars, k + 1)["l"].alias("after")))
    peak = lambda every, start, stop: F.array_max(F.transform(_span(every, start, stop), lambda x: x["h"]))

    def judge(every, low, dips):
        dip = F.element_at(dips, -1)
        higher = peak(every, low["i"] + 1, b.i) > peak(every, dip["i"], low["i"])
        return F.when(F.size(dips) > 0, higher & (F.abs(b.l - dip["l"]) < b.share(dip["l"], 0.001)))

    dips_of = lambda every, low: F.filter(_span(every, low["i"] - 10, low["i"]), lambda x: (x["l"] < x["before"]) & (x["l"] < x["after"]) & (x["l"] > low["v"]))
    return let(after, lambda every: let(_least(_span(every, b.i - 25, b.i - 5), "l"), lambda low: let(dips_of(every, low), lambda dips: judge(every, low, dips))))


@detector("array", 15, *pair("triple_tap"))
def _triple_tap(b):
    pit = lambda k: (b.back(b.l, k) < b.back(b.l, k + 1)) & (b.back(b.l, k) < b.back(b.l, k - 1))
    second = F.coalesce(*(F.when(pit(k), F.lit(k)) for k in (5, 4, 3)))
    return any_of((second == k) & any_of(pit(j) for j in range(k + 3, k + 6)) for k in (3, 4, 5))


def _point_of_control(b) -> Column:
    """The left edge of the fullest of 20 equal bins over the last 100 closes, the first if tied."""
    closes = b.over(F.collect_list(F.col("close")), -100, -1)
    range_ = F.struct(F.array_min(closes).alias("low"), ((F.array_max(closes) - F.array_min(closes)) / 20).alias("width"))

    def edge(r):
        bins = F.transform(closes, lambda x: F.least(F.floor(F.try_divide(x - r["low"], r["width"])), F.lit(19)).cast("int"))
        # Sorted bins stand in runs: the fullest bin is the start of the longest run, the first of equal ones.
        runs = F.aggregate(
            F.array_sort(bins), F.struct(*(F.lit(v).alias(k) for k, v in (("bin", -1), ("n", 0), ("best", -1), ("most", 0)))),
            lambda acc, x: let(F.when(acc["bin"] == x, acc["n"] + 1).otherwise(F.lit(1)), lambda n: F.struct(x.alias("bin"), n.alias("n"), F.when(n > acc["most"], x).otherwise(acc["best"]).alias("best"), F.greatest(n, acc["most"]).alias("most"))),
            lambda acc: acc["best"],
        )
        fullest = runs
        return F.when(r["width"] == 0, r["low"]).otherwise(r["low"] + fullest * r["width"])

    return let(range_, edge)


@detector("array", 100, "poc_level_rejection_bullish")
def _control_up(b):
    level = _point_of_control(b)
    return (b.l <= level) & (b.c > level) & (b.c > b.back(b.c, 1))


@detector("array", 100, "poc_level_rejection_bearish")
def _control_down(b):
    level = _point_of_control(b)
    return (b.h >= level) & (b.c < level) & (b.c < b.back(b.c, 1))


@detector("lag", 0, "kill_zone")
def _kill_zone(b):
    return in_kill_zone("Asia/Kolkata")


def in_kill_zone(zone: str) -> Column:
    """Whether the exchange's clock stands between 09:15 and 11:00 or between 13:30 and 15:00, ends included."""
    clock = F.date_format(F.from_utc_timestamp("ts", zone), "HH:mm:ss")
    return clock.between("09:15:00", "11:00:00") | clock.between("13:30:00", "15:00:00")
